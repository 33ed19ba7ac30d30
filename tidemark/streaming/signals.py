"""Values that tell when they change, and values computed from them: what a driver program hangs on a live query.

A Calculated notes which signals its function reads and runs it again, when next asked, after one of them has changed.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

_reading = threading.local()


class Signal:
    def __init__(self, value: object = None):
        self._value, self._watchers, self._changed = value, [], threading.Condition()

    def get(self) -> object:
        """The value; a Calculated that is being computed depends on it from here on."""
        reader = getattr(_reading, "now", None)
        if reader is not None:
            reader._depend(self)
        return self.peek()

    def peek(self) -> object:
        """The value, without a dependency."""
        return self._value

    def take(self, use: Callable[[object], object]) -> object:
        return use(self.get())

    def set(self, value: object) -> None:
        with self._changed:
            self._value = value
            self._changed.notify_all()
        self._tell()

    def _tell(self) -> None:
        for watcher in list(self._watchers):
            watcher(self)

    def subscribe(self, watcher: Callable[[object], None]) -> Callable[[], None]:
        """Calls watcher with each new value; the function returned ends that."""
        call = lambda s: watcher(s.peek())
        self._watchers.append(call)
        return lambda: self._watchers.remove(call) if call in self._watchers else None

    def wait(self, wanted: Callable[[object], bool], timeout: float | None = None) -> bool:
        """Blocks until the value is as wanted; False after timeout seconds."""
        with self._changed:
            return self._changed.wait_for(lambda: wanted(self.peek()), timeout)

    def map(self, use: Callable[[object], object]) -> Calculated:
        return Calculated(lambda: use(self.get()))


class Calculated(Signal):
    def __init__(self, compute: Callable[[], object]):
        super().__init__()
        self.compute, self._stale, self._on = compute, True, []

    def _depend(self, on: Signal) -> None:
        if all(x is not on for x in self._on):
            self._on.append(on)
            on._watchers.append(self._invalidate)

    def _invalidate(self, _: Signal) -> None:
        if not self._stale:
            self._stale = True
            with self._changed:
                self._changed.notify_all()
            self._tell()

    def peek(self) -> object:
        if self._stale:
            for on in self._on:  # dependencies are found anew
                on._watchers.remove(self._invalidate)
            self._on = []
            outer, _reading.now = getattr(_reading, "now", None), self
            try:
                self._value = self.compute()
            finally:
                _reading.now = outer
            self._stale = False
        return self._value

    def set(self, value: object) -> None:
        raise TypeError("a calculated value is not set")
