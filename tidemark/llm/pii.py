"""Operator 8, personal data behind disguises: an offset-preserving deobfuscation.

Two transducers rewrite a text, each keeping for every written character the source characters that it came from. The
first works on characters: homoglyphs, full-width and other compatible forms and foreign digits become ASCII, invisible characters
vanish.
The second works on words: "(at)", "[dot]" and spaced "at ... dot ..." become @ and dots, runs of spelled digits become
digits. The detectors run over the plain text and over the rewritten one, and spans of the latter are mapped back.

The plain text's spans (base) always stay. A mapped span is added if a rewriting lies in it, no letter or digit
touches it, and it does not lie wholly in a span of its kind; it may reach beyond base spans that it overlaps, which
are often parts of the same identifier.

Detectors, leftmost and non-overlapping of each kind, failing matches dropped without a retry:
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
  card   [0-9]([\\x20-]?[0-9])+, 16 to 19 digits, Luhn
  phone  \\+[0-9][\\x20().0-9-]+[0-9], 8 to 15 digits
They are written so that no text makes them run longer than in proportion to its length.

Defined results: null is the empty text and has no spans; offsets are code points, ends exclusive; repeated rows
repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, sliced, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The address around each @ in turn: the characters before it as far back as the last address, the domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Spans of all kinds, by kind as in KINDS, then start."""
    found: list[Span] = []
    if "@" in text:
        found += (("email", a, b) for a, b in emails(text))
    if _DIGITS.search(text):
        if "." in text:
            found += (("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups())))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += (("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15)
    return found


# Letters of other scripts that look like ASCII ones, and marks that look like @ . + -
HOMOGLYPHS = dict(zip(
    "АВЕЅІЈКМНОРСТХУаеіјорсухѕԁɡһӏԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοριυνɑ․。｡‐‑‒–—−﹫＠",
    "ABESIJKMHOPCTXYaeijopcyxsdghlqwABEZHIKMNOPTYXaopiuva...------@@", strict=True))
# Characters without a width.
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _plain(c: str) -> str:
    """What the character transducer writes for one character."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if 0xFF01 <= ord(c) <= 0xFF5E:  # full-width forms stand in ASCII's order
        return chr(ord(c) - 0xFEE0)
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    like = unicodedata.normalize("NFKC", c)  # mathematical, circled and raised letters and digits, ligatures
    return like if like.isascii() and like.isalnum() else c


_FOREIGN = re.compile("[^\x00-\x7f]")
_DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
#: What follows a spaced "at": a name, and a dot in one of its forms.
_HOST = r"(?=[A-Za-z0-9-]++(?:\s++(?:dot|\.)\s++[A-Za-z0-9-]|\s*+[\[({<]\s*+dot|\.[A-Za-z0-9-]))"
_WORDS = re.compile(
    rf"(?P<at>(?<!\s)\s*+[\[({{<]\s*+at\s*+[\])}}>]\s*+)|(?P<dot>(?<!\s)\s*+[\[({{<]\s*+(?:dot|point)\s*+[\])}}>]\s*+)"
    rf"|(?P<spaced>(?<=[A-Za-z0-9._%+-])\s++(?:at|@)\s++{_HOST})"
    rf"|(?P<near>(?<=[A-Za-z0-9])\s++dot\s++(?=[A-Za-z0-9]))"
    rf"|(?P<digits>(?:\bplus[\s-]+)?\b{_DIGIT_WORD}(?:[\s,-]+(?:{_DIGIT_WORD}\b|[0-9]+))+)",
    re.I,
)
#: Spaced full stops after such a name, which are rewritten with its "at" alone: elsewhere they end sentences.
_STOPS = re.compile(r"[A-Za-z0-9-]+(?:\s+\.\s+[A-Za-z0-9-]+)+")
_STOP = re.compile(r"\s+\.\s+")
#: One of these stands in every text that the word transducer changes.
_HINT = re.compile(rf"[\[({{<]\s*(?:at|dot|point)\s*[\])}}>]|\s(?:dot\s|(?:at|@)\s+{_HOST})|\b{_DIGIT_WORD}[\s,-]+(?:{_DIGIT_WORD}|[0-9])", re.I)
_TOKEN = re.compile(rf"plus|{_DIGIT_WORD}|[0-9]+", re.I)


class Rewritten:
    """A text with, for each character, the source range that it stands for, and whether it was changed."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def replace(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """edits: ascending (start, end, pieces); a piece is a text and the range of this text that it stands for."""
        if not edits:
            return
        texts, starts, ends, changes, at = [], [], [], [], 0

        def keep(a: int, b: int) -> None:
            texts.append(self.text[a:b])
            starts.append(self.start[a:b])
            ends.append(self.end[a:b])
            changes.append(self.changed[a:b])

        for a, b, pieces in edits:
            keep(at, a)
            for new, low, high in pieces:
                texts.append(new)
                starts.append(np.full(len(new), self.start[low]))
                ends.append(np.full(len(new), self.end[high - 1]))
                changes.append(np.ones(len(new), bool))
            at = b
        keep(at, len(self.text))
        self.text = "".join(texts)
        self.start, self.end, self.changed = np.concatenate(starts), np.concatenate(ends), np.concatenate(changes)


def deobfuscate(text: str) -> Rewritten:
    out = Rewritten(text)
    if not text.isascii():
        out.replace([(m.start(), m.end(), [(new, m.start(), m.end())]) for m in _FOREIGN.finditer(text) if (new := _plain(m[0])) != m[0]])
    if _HINT.search(out.text):
        edits = []
        for m in _WORDS.finditer(out.text):
            a, b = m.span()
            if m["digits"] is None:
                edits.append((a, b, [("@" if m["at"] or m["spaced"] else ".", a, b)]))
                if m["spaced"] and (host := _STOPS.match(out.text, b)):
                    edits += ((*t.span(), [(".", *t.span())]) for t in _STOP.finditer(out.text, b, host.end()))
            else:
                pieces = []
                for t in _TOKEN.finditer(m["digits"]):
                    word = t[0].lower()
                    pieces.append(("+" if word == "plus" else SPELLED.get(word, t[0]), a + t.start(), a + t.end()))
                edits.append((a, b, pieces))
        out.replace(sorted(edits))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by kind, then start."""
    text = text or ""
    base = detect(text)
    seen = deobfuscate(text)
    if not seen.changed.any() and len(seen.text) == len(text):
        return base, base
    every = list(base)
    # spans of a kind come in ascending order, so one that holds a new one begins last before it, or reaches farthest
    starts = {k: [x for kind, x, _ in base if kind == k] for k in KINDS}
    ends = {k: [y for kind, _, y in base if kind == k] for k in KINDS}
    reach = dict.fromkeys(KINDS, 0)
    for kind, a, b in detect(seen.text):
        start, end = int(seen.start[a]), int(seen.end[b - 1])
        within = seen.changed[a:b].any() or (seen.start[a + 1 : b] != seen.end[a : b - 1]).any()  # a vanished character lies in it
        edged = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
        before = bisect_right(starts[kind], start) - 1
        if within and not edged and end > reach[kind] and not (before >= 0 and ends[kind][before] >= end):
            every.append((kind, start, end))
            reach[kind] = end
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, base and spans (kind, start, end)."""
    ready(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_dicts = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in sliced(batches):
            made = [find(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_dicts(x) for x, _ in made], kind), pa.array([as_dicts(y) for _, y in made], kind)], ["doc_id", "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id bigint, base {SPANS}, spans {SPANS}")


def told(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
