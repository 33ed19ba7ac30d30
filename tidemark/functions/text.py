"""Edits of a text at a place, as column expressions. Places count code points from 0; a place beyond the end is the
end, and a deletion stops there. A null text or argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | int | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def overwrite(text: Column, at: Column | int, count: Column | int, new: Column | str) -> Column:
    """count code points from at on give way to new."""
    known = _col(at).isNotNull() & _col(count).isNotNull()  # greatest passes over nulls
    at, count = F.greatest(_col(at), F.lit(0)), F.greatest(_col(count), F.lit(0))
    return F.when(known, F.concat(F.substring(text, F.lit(1), at), _col(new), F.substring(text, at + count + 1, F.length(text))))


def insert(text: Column, at: Column | int, new: Column | str) -> Column:
    return overwrite(text, at, 0, new)


def delete(text: Column, at: Column | int, count: Column | int) -> Column:
    return overwrite(text, at, count, "")
