"""Operator 9, media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

A payload is stored as the samples of an 8-bit mono WAV file, in a binary column of a written table; features come
from the bytes read back. Frames of FRAME samples, half overlapping, are transformed under a Hann window; in each
band the strongest bin is a peak, and every peak is paired with the same frame's next band and with the next frame's
peak of its band. A pair is stored as one number, time code first: frame << 24 | bin << 14 | other bin << 4 | pair.
A file's pairs, ascending, are an array column of a written table of fingerprints.

Defined results: a null or empty text has an empty payload, padded to one unit; silence still has peaks (the lowest
bin of a band wins ties); repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ready, sliced, table

UNIT, FILL, RATE, FRAME = 576, 255, 8000, 576
BANDS = ((1, 24), (24, 72), (72, 144), (144, 289))


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes([FILL]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setparams((1, 1, RATE, len(payload), "NONE", "not compressed"))
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as file:
        if (file.getnchannels(), file.getsampwidth()) != (1, 1):
            raise ValueError("not an 8-bit mono file")
        return file.readframes(file.getnframes())


def landmarks(samples: bytes, at_once: int = 2048) -> np.ndarray:
    """Time-coded peak pairs, ascending."""
    signal = np.frombuffer(samples, np.uint8)
    hop = FRAME // 2
    count = max(1, (len(signal) - FRAME) // hop + 1)
    window = np.hanning(FRAME)
    peaks = np.empty((count, len(BANDS)), np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::hop]
    for at in range(0, count, at_once):
        some = (frames[at : at + at_once].astype(np.float64) - 128) * window
        power = np.round(np.abs(np.fft.rfft(some, axis=1)), 6)
        for b, (low, high) in enumerate(BANDS):
            peaks[at : at + len(some), b] = low + power[:, low:high].argmax(axis=1)
    time = np.arange(count, dtype=np.int64)[:, None] << 24
    same = time | peaks[:, :-1] << 14 | peaks[:, 1:] << 4 | np.arange(len(BANDS) - 1)
    next_ = time[:-1] | peaks[:-1] << 14 | peaks[1:] << 4 | (8 + np.arange(len(BANDS)))
    return np.sort(np.concatenate((same.ravel(), next_.ravel())))


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes doc_id, n_bytes, media (WAV bytes) of each row and returns the written table."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([to_wav(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary"), "media")


def describe(media: DataFrame) -> DataFrame:
    """Of a media table, from its bytes: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, landmarks."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("landmarks", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            doc_ids, sizes, files = (c.to_pylist() for c in batch.columns)
            rows = []
            for doc, size, file in zip(doc_ids, sizes, files, strict=True):
                data = from_wav(file)
                rows.append((doc, size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(file), hashlib.sha256(file).hexdigest(), landmarks(data)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, landmarks array<bigint>")


def fingerprints(docs: DataFrame, **columns) -> DataFrame:
    """Stores the media of docs, then what describe() reads from them, and returns the written table."""
    return materialize(describe(store(docs, **columns)), "fingerprints")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumn("feature", F.concat(F.size("landmarks").cast("string"), F.lit(":"), F.sha2(F.array_join("landmarks", ","), 256)))
