"""Operator 3, quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): the pairwise interactions of all
features in time linear in their number. Words are hashed into a fixed table with damped counts; structure statistics
(case, symbols, repetition, lines, lengths) and metadata fall into bins, one feature each.

The machine is fitted on the driver on at most max_rows labelled rows (a documented bound; rows are taken by a hash of
their id, so the sample is even and repeatable); all rows are scored, whole texts, with the broadcast machine (fixed
size: 2**BITS x (RANK + 1) floats).

Defined results: null and empty texts are texts without words and get a score; a null or new metadata value is a
feature of its own; repeated rows get equal scores; without any labelled row every score is 0.5. An empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD_BYTES, ready, sliced, table

BITS, RANK, MAX_ROWS = 15, 6, 6000
CUT = 0.3

_UPPER, _LOWER, _DIGIT, _BLANK, _LINE, _BAR, _MARK, _HIGH = range(8)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[32, 9]], _CLASS[10], _CLASS[124] = _BLANK, _LINE, _BAR
_SHARES = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


def structure(text: str, words: list[bytes], counts: Counter) -> list[str]:
    """Names of the bins that a text falls into."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=8)
    size, n = max(1, len(raw)), max(1, len(words))
    letters = max(1, kinds[_UPPER] + kinds[_LOWER] + kinds[_HIGH])
    lines = text.split("\n")
    shares = {
        "upper": kinds[_UPPER] / letters, "digit": kinds[_DIGIT] / size, "mark": kinds[_MARK] / size, "bar": kinds[_BAR] / size, "blank": kinds[_BLANK] / size,
        "distinct": len(counts) / n, "again": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "top": max(counts.values(), default=0) / n,
        "lines": len(set(lines)) / len(lines), "per_line": min(1.0, n / len(lines) / 200), "word": min(1.0, sum(map(len, words)) / n / 20),
    }
    found = [f"{name}:{int(np.searchsorted(_SHARES, share))}" for name, share in shares.items()]
    return [*found, f"words:{len(words).bit_length()}", f"empty:{not words}"]


def features(text: str | None, metadata: list[tuple[str, object]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a row's features, places ascending and distinct."""
    text = text or ""
    words = WORD_BYTES.findall(text.encode().translate(LOWER))
    counts = Counter(words)
    top = 1 << BITS
    names = [f"#{x}" for x in structure(text, words, counts)] + [f"={name}:{value}" for name, value in metadata]
    crc = zlib.crc32
    place = np.fromiter((crc(w) % top for w in counts), np.int64, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    value /= max(1e-9, float(np.sqrt((value**2).sum())))
    place = np.concatenate((place, np.array([crc(x.encode()) % top for x in names], np.int64)))
    value = np.concatenate((value, np.full(len(names), 0.5)))
    places, spot = np.unique(place, return_inverse=True)
    return places, np.bincount(spot, value, len(places))


class Machine:
    def __init__(self, seed: int = 7):
        self.bias = 0.0
        self.linear = np.zeros(1 << BITS)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (1 << BITS, RANK))

    def margin(self, place: np.ndarray, value: np.ndarray) -> float:
        parts = self.factors[place] * value[:, None]
        return self.bias + float(self.linear[place] @ value) + 0.5 * float((parts.sum(axis=0) ** 2).sum() - (parts**2).sum())

    def score(self, place: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(place, value), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> Machine:
        """AdaGrad on the log loss; the sums of a mini-batch are made by row."""
        rng = np.random.default_rng(seed)
        seen_w, seen_v, seen_b = np.full(1 << BITS, 1e-8), np.full((1 << BITS, RANK), 1e-8), 1e-8
        share = (labels.sum() + 1) / (len(labels) + 2)
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                place = np.concatenate([rows[k][0] for k in some])
                value = np.concatenate([rows[k][1] for k in some])
                row = np.repeat(np.arange(len(some)), [len(rows[k][0]) for k in some])
                parts = self.factors[place] * value[:, None]
                sums = np.column_stack([np.bincount(row, parts[:, f], len(some)) for f in range(RANK)])
                squares = np.bincount(row, (parts**2).sum(axis=1), len(some))
                margin = self.bias + np.bincount(row, self.linear[place] * value, len(some)) + 0.5 * ((sums**2).sum(axis=1) - squares)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) / len(some)
                touched, spot = np.unique(place, return_inverse=True)
                step = error[row] * value
                g = np.bincount(spot, step, len(touched)) + decay * self.linear[touched]
                seen_w[touched] += g**2
                self.linear[touched] -= rate * g / np.sqrt(seen_w[touched])
                for f in range(RANK):
                    g = np.bincount(spot, step * (sums[row, f] - parts[:, f]), len(touched)) + decay * self.factors[touched, f]
                    seen_v[touched, f] += g**2
                    self.factors[touched, f] -= rate * 0.3 * g / np.sqrt(seen_v[touched, f])
                g = float(error.sum())
                seen_b += g**2
                self.bias -= rate * g / float(np.sqrt(seen_b))
        return self


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), max_rows: int = MAX_ROWS) -> Machine | None:
    """A machine from at most max_rows rows of labels (their features reach the driver, nothing else); None without rows."""
    spark = docs.sparkSession
    ready(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id_")).agg(F.max(F.col(label_col).cast("int")).alias("label_"))
    sample = known.orderBy(F.xxhash64("id_"), "id_").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, label, texts, *more = (c.to_pylist() for c in batch.columns)
            made = [features(t, list(zip(metadata, [m[k] for m in more], strict=True))) for k, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array([p.astype("<i4").tobytes() for p, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())], ["id", "label", "place", "value"])

    # the sample is bounded by max_rows pairs of numbers; where ids repeat, the first rows in an order are taken
    chosen = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text"), *(F.col(m).cast("string").alias(f"m{k}_") for k, m in enumerate(metadata))).join(F.broadcast(sample), "id_")
    rows = chosen.select("id_", "label_", "text", *(f"m{k}_" for k in range(len(metadata)))).mapInArrow(run, "id bigint, label int, place binary, value binary").orderBy("id", "place", "value").limit(4 * max_rows).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["id"], bytes(r["place"]), bytes(r["value"])))
    return Machine().fit([(np.frombuffer(r["place"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64)) for r in rows], np.array([r["label"] for r in rows], np.float64))


def score(docs: DataFrame, machine: Machine | None, *, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, score."""
    spark = docs.sparkSession
    ready(spark)
    held = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            _, texts, *more = (c.to_pylist() for c in batch.columns)
            made = [0.5 if held.value is None else held.value.score(*features(t, list(zip(metadata, [m[k] for m in more], strict=True)))) for k, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(m).cast("string").alias(f"m{k}_") for k, m in enumerate(metadata)))
    return slim.mapInArrow(run, "doc_id bigint, score double")


def fold(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(-1))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("size_bin", F.expr("length(bin(coalesce(n_chars, -1)))"))
    labels = table(spark, sf_dir, "labels").where(fold() != 0)
    machine = train(docs, labels, metadata=("size_bin",))
    scored = score(docs, machine, metadata=("size_bin",))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
