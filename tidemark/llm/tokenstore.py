"""Operator 10, token-id output as a content-addressed store.

Each text is encoded, an end id appended. A rolling hash over the ids cuts a document's stream into chunks; a chunk's
name is the BLAKE2b digest of its bytes. Under one root folder lie three written tables (binary columns in Parquet,
committed by Spark's writer, so a lost executor leaves no half-written file):

  chunks    digest, payload: each distinct chunk once; payload is little-endian unsigned ids, 2 bytes each if every
            id of the tokenizer fits, else 4
  recipes   in ascending order of documents: shard, line, doc_id, start within the shard, n_tokens, digests (16 bytes
            each), sizes (ids of each chunk, 4 bytes each), root (Merkle root over the digests)
  manifest  of each shard of recipes: its documents, ids, and the Merkle root over its documents' roots

Reading back takes chunks and recipes from these files, checks every payload against its name, every recipe
against its root and every shard against the manifest, and gets a document's CRC from its chunks' CRCs, shifted by
what follows them: payloads never move to their documents. `reconstruct` returns the ids themselves, with the same
checks of the recipes and chunks it reads. What is missing or does not agree is an error.

Defined results: a null or empty text is the end id alone; repeated rows are documents of their own; a null doc_id
sorts first; equal order values keep rows together, in the order of their contents; an empty table gives empty files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, fresh_path, ready, sliced, table

DIGEST = 16
END_ID = 1
#: Ids that the rolling hash covers; a cut is where its upper bits under MASK are 0.
ROLL, MASK, LEAST, MOST = 16, 255, 64, 2048
#: Texts whose pieces are looked up together, documents cut together, pieces given to the library at once: a worker's memory.
TOGETHER, CUT_TOGETHER, NEW_TOGETHER = 2000, 250, 2000
PRIME = np.uint64(0x9E3779B97F4A7C15)
_LONE_MARK = re.compile(r"(?<=[a-z])([,.])(?=[ \n])")
#: Marks but the apostrophe, which can begin a word's ending for the tokenizer.
_LAST_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[a-z].)[!-&(-/:-@\[-`{-~]*(?=[ \n])")
#: Small letters of Latin-1 and the blank that ends a piece.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+ ")
#: LOWER, and line ends as blanks.
_LOWER_BLANKS = LOWER[:10] + b" " + LOWER[11:]
_IS_LETTER = np.isin(np.arange(256), np.arange(97, 123))
_IS_MARK = np.array([b in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" for b in range(256)])


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over leaves; an odd last node rises as it is. No leaf: the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


class MerkleStream:
    """The same root from leaves one by one, holding a node for each level."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        self.peaks.append((0, leaf))
        while len(self.peaks) > 1 and self.peaks[-1][0] == self.peaks[-2][0]:
            height, right = self.peaks.pop()
            self.peaks[-1] = (height + 1, digest(b"\x01" + self.peaks[-1][1] + right))

    def root(self) -> bytes:
        if not self.peaks:
            return digest(b"")
        node = self.peaks[-1][1]
        for _, left in self.peaks[-2::-1]:
            node = digest(b"\x01" + left + node)
        return node


# The normaliser and the pattern of the tokenizers whose texts may be parted at blanks and marks.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def parts_at_blanks(path: str) -> bool:
    """Whether a tokenizer file lower-cases, drops blanks and parts letters, digits and marks as Encoder.pieces has it."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    bytewise = len(steps) == 2 and {k: steps[1].get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    special = all(t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told.get("added_tokens") or ())
    return told.get("normalizer") == _NORMALIZER and steps[0] == _SPLIT and bytewise and special and not told.get("truncation") and not told["model"].get("dropout")


class Encoder:
    """Ids of texts as little-endian unsigned bytes: 4 for an id, or, packed, `width`. A tokenizer that splits at white
    space and never joins across it has pieces between blanks and line ends encoded once and then looked up; for any
    other one whole texts are encoded. Pieces are held in a young and an old table: a full young one becomes the old
    one, from which a piece that is met again returns.

    A plain word (small Latin letters that normalising leaves as they are) is one word to the tokenizer too. Plain words
    are encoded many at a time without its normaliser and pattern, and parted at the ids that end a word."""

    def __init__(self, path: str, held: int = 150_000):
        from tokenizers import Tokenizer

        self.library, self.held, self.young, self.old = Tokenizer.from_file(path), held, {}, {}
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.piecewise = parts_at_blanks(path)
        self.plain, self.ends = self._plain_library(path) if self.piecewise else None, None
        if self.plain:
            vocabulary = self.library.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for word, k in vocabulary.items() if word.endswith(self.plain.model.end_of_word_suffix)]] = True

    @staticmethod
    def _plain_library(path: str):
        """The tokenizer without its normaliser and pattern, if its ids mark where words end; else none."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        made = Tokenizer.from_file(path)
        if not getattr(made.model, "end_of_word_suffix", None):
            return None
        made.normalizer = normalizers.Sequence([])
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return made

    @staticmethod
    def pieces(texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The pieces of texts, each with one blank after it, and the number of pieces up to the end of each text. Blanks
        and line ends part pieces; so does a letter before the marks that end a piece. The tokenizer lower-cases all but
        its special tokens, so A-Z are lower-cased first where none can stand; where one can, only a lone comma or full
        stop is parted, beforehand, and nothing else."""
        raw = [(t if "<|" not in t else _LONE_MARK.sub(r" \g<0>", t).replace("\n", " ")).encode() for t in texts]
        odd = [k for k, t in enumerate(texts) if "<|" in t]
        line = b" ".join([*raw, b""])
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        given = np.frombuffer(line.translate(_LOWER_BLANKS), np.uint8)
        mark = _IS_MARK[given]  # the last byte is a blank
        edge = np.flatnonzero(mark[1:] != mark[:-1]) + 1
        edge = np.append(0, edge) if mark[0] else edge
        first, after = edge[::2], edge[1::2]
        parted = first[_IS_LETTER[given[first - 1]] & (given[after] == 32)]
        if odd:
            given = given.copy()
            inside = np.zeros(len(raw), bool)
            inside[odd] = True
            parted = parted[~inside[np.searchsorted(ends, parted, "right")]]
            for k in odd:
                given[ends[k] - 1 - len(raw[k]) : ends[k] - 1] = np.frombuffer(raw[k], np.uint8)
        blanks = np.flatnonzero(given == 32)
        counts = np.searchsorted(blanks, ends) + np.searchsorted(parted, ends)
        bytes_ = np.insert(given, parted, 32)
        offsets = np.append(0, np.flatnonzero(bytes_ == 32) + 1)
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)]), counts

    def _learn(self, new: list[bytes]) -> None:
        plain = [w for w in new if _PLAIN.fullmatch(w)] if self.plain else []
        for at in range(0, len(plain), NEW_TOGETHER):
            some = plain[at : at + NEW_TOGETHER]
            ids = np.array(self.plain.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(ends) != len(some):
                raise ValueError("the tokenizer's ids do not mark the ends of words")
            raw, ends = ids.astype(self.kind).tobytes(), ends.tolist()
            self.young.update((w, raw[a:b]) for w, a, b in zip(some, [0, *ends], ends))
        rest = [w for w in new if w not in self.young] if plain else new
        for at in range(0, len(rest), NEW_TOGETHER):
            some = rest[at : at + NEW_TOGETHER]
            self.young.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(some, self.library.encode_batch_fast([w[:-1].decode() for w in some], add_special_tokens=False), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [np.frombuffer(x, self.kind).astype("<u4").tobytes() for x in self.packed(texts)]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        if not self.piecewise:
            return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if not texts:
            return []
        pieces, counts = self.pieces([t or "" for t in texts])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        bounds = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1].tolist()
        data = (distinct.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        words = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        if len(self.young) > self.held:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        ids = list(map(young.get, words))
        absent, new = [k for k, x in enumerate(ids) if x is None], []
        for k in absent:
            if (known := old.get(words[k])) is None:
                new.append(words[k])
            else:
                young[words[k]] = known
        self._learn(new)
        for k in absent:
            ids[k] = young[words[k]]
        found = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset + np.append(0, counts)].tolist()
        data = memoryview(found.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


def cuts(ids: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document; ids: of all documents, starts: of each, and the end. A boundary depends on
    the ROLL ids before it alone, so that equal passages of different documents fall into equal chunks."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * PRIME
    mixed ^= mixed >> np.uint64(29)
    rolled, span = mixed, 1
    while span < ROLL:  # the sum over twice as many ids, from two sums
        further = rolled.copy()
        further[span:] += rolled[: max(0, len(ids) - span)] * np.uint64(pow(0xD6E8FEB86659FD93, span, 1 << 64))
        rolled, span = further, 2 * span
    good = np.flatnonzero(((rolled >> np.uint64(40)) & np.uint64(MASK)) == 0) + 1
    bounds = np.searchsorted(good, starts)
    made = []
    for a, b, low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends, last = [], a
        for at in good[low:high].tolist():
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at - last >= LEAST and at < b:
                ends.append(at)
                last = at
        while b - last > MOST:
            last += MOST
            ends.append(last)
        made.append([*ends, b])
    return made


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder in a worker: the pieces known from one task serve the next. The library stays on the task's core, unless
    a user has said otherwise: its threads' heaps would stay with the worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def encode_partition(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """In: doc_id, ord (order values), text. Out: kind 0, a recipe, or kind 1, a chunk that this task has not given yet."""
    encoder, given = encoder_of(path), set()
    fields = [("kind", pa.int32()), ("digest", pa.binary()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("ord1", pa.int64()), ("ord2", pa.int64()), ("n_tokens", pa.int64()), ("sizes", pa.binary()), ("root", pa.binary())]
    schema = pa.schema(fields)
    end = np.array([END_ID], encoder.kind).tobytes()
    for batch in sliced(batches, TOGETHER):
        doc_ids, ord1, ord2, texts = (batch.column(k).to_pylist() for k in range(4))
        streams = encoder.packed(texts)
        for low in range(0, len(streams), CUT_TOGETHER):
            some = [x + end for x in streams[low : low + CUT_TOGETHER]]
            starts = np.concatenate(([0], np.cumsum([len(x) // encoder.width for x in some])))
            packed = b"".join(some)
            rows = []
            for k, ends in enumerate(cuts(np.frombuffer(packed, encoder.kind), starts)):
                doc, names, last = low + k, [], int(starts[k])
                sizes = np.diff([last, *ends]).astype("<u4").tobytes()
                for stop in ends:
                    payload = packed[last * encoder.width : stop * encoder.width]
                    name, last = digest(payload), stop
                    names.append(name)
                    if name not in given:
                        if len(given) > 100_000:
                            given.clear()
                        given.add(name)
                        rows.append((1, name, payload, None, None, None, None, None, None))
                own = digest(repr((doc_ids[doc], ord1[doc], ord2[doc])).encode())  # deals recipes out evenly
                rows.append((0, own, b"".join(names), doc_ids[doc], ord1[doc], ord2[doc], int(starts[k + 1] - starts[k]), sizes, merkle(names)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    pa.default_memory_pool().release_unused()  # a worker idles beside the stages that follow


def number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds shard (this task's place in the order), line and the ids of the shard's lines before."""
    shard, line, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        before = start + np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), pa.array(np.arange(line, line + len(n))), pa.array(before.astype(np.int64)), *batch.columns], ["shard", "line", "start", *batch.schema.names])
        line, start = line + len(n), start + int(n.sum())


def _names(root: bytes, digests: bytes, sizes: bytes, n_tokens: int) -> list[bytes]:
    """The chunks that a recipe names, checked against its root; sizes against their number and sum."""
    names = [digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)]
    if merkle(names) != root:
        raise ValueError("a recipe does not match its root")
    if len(sizes) != 4 * len(names) or int(np.frombuffer(sizes, "<u4").sum(dtype=np.int64)) != n_tokens:
        raise ValueError("a recipe's sizes do not match its ids")
    return names


def _manifest(recipes: DataFrame) -> DataFrame:
    """shard, documents, ids, root of each shard, from its recipes in the order of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, documents, ids = None, MerkleStream(), 0, 0
        names = ["shard", "documents", "ids", "root"]
        give = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([documents], pa.int64()), pa.array([ids], pa.int64()), pa.array([tree.root()], pa.binary())], names)
        for batch in batches:
            for shard, line, start, n, root, digests, sizes in zip(*(batch.column(c).to_pylist() for c in ("shard", "line", "start", "n_tokens", "root", "digests", "sizes")), strict=True):
                _names(root, digests, sizes, n)
                if shard != at:
                    if at is not None:
                        yield give()
                    at, tree, documents, ids = shard, MerkleStream(), 0, 0
                if (line, start) != (documents, ids):
                    raise ValueError(f"the recipes of shard {shard} do not follow one another")
                tree.add(root)
                documents, ids = documents + 1, ids + n
        if at is not None:
            yield give()

    dealt = recipes.select("shard", "line", "start", "n_tokens", "root", "digests", "sizes").repartition("shard").sortWithinPartitions("shard", "line")
    return dealt.mapInArrow(run, "shard int, documents bigint, ids bigint, root binary")


def write_store(docs: DataFrame, root: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", order: tuple[Column, Column] | None = None) -> str:
    """Writes the three tables under root and returns it. order: two long columns; without it documents go in ascending id_col."""
    ready(docs.sparkSession)
    first, second = order or (F.col(id_col).cast("long"), F.lit(0).cast("long"))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), first.cast("long").alias("ord1"), second.cast("long").alias("ord2"), F.col(text_col).alias("text"))
    made = slim.mapInArrow(lambda b: encode_partition(b, tokenizer), "kind int, digest binary, payload binary, doc_id bigint, ord1 bigint, ord2 bigint, n_tokens bigint, sizes binary, root binary")
    once = made.withColumn("copy", F.row_number().over(W.partitionBy("kind", "digest").orderBy("doc_id"))).where("kind = 0 OR copy = 1").drop("copy")
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{root}/staged")
    spark = docs.sparkSession
    staged = spark.read.schema(f"{_ddl(made)}").parquet(f"{root}/staged")
    recipes = staged.where("kind = 0").select("doc_id", "ord1", "ord2", "n_tokens", F.col("payload").alias("digests"), "sizes", "root")
    ordered = recipes.repartitionByRange("ord1", "ord2").sortWithinPartitions("ord1", "ord2", "doc_id", "root")
    ordered.mapInArrow(number_lines, "shard int, line bigint, start bigint, " + _ddl(ordered)).write.option("compression", "zstd").parquet(f"{root}/recipes")
    _manifest(spark.read.parquet(f"{root}/recipes")).write.parquet(f"{root}/manifest")
    return root


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def chunks_of(spark: SparkSession, root: str) -> DataFrame:
    schema = "digest binary, payload binary, kind int"
    return spark.read.schema(schema).parquet(f"{root}/staged").where("kind = 1").select("digest", "payload")


# CRC-32 of A+B is the CRC of A, carried over the bytes of B, xor the CRC of B.


@lru_cache(maxsize=1)
def _shift_tables(levels: int = 40) -> np.ndarray:
    """[k, byte, value]: what carrying a CRC over 2**k zero bytes does to each byte of it."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    full = np.stack([(x := (np.arange(256, dtype=np.uint32) << np.uint32(8 * k)), (x >> np.uint32(8)) ^ one[x & 255])[1] for k in range(4)])
    made = [full]
    for _ in range(levels - 1):
        made.append(np.stack([_carry(made[-1], made[-1][k]) for k in range(4)]))
    return np.stack(made)


def _carry(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def shift_crc(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each CRC as it stands in a stream with count bytes after it."""
    tables = _shift_tables()
    crc, count, level = crc.astype(np.uint32), count.astype(np.int64), 0
    while count.any():
        odd = (count & 1).astype(bool)
        crc = np.where(odd, _carry(tables[level], crc), crc).astype(np.uint32)
        count, level = count >> 1, level + 1
    return crc


def check_manifest(recipes: DataFrame, shards: DataFrame) -> None:
    """Raises where the manifest (shards) is not the one that the recipes give."""
    found, kept = _manifest(recipes), shards.select("shard", "documents", "ids", "root")
    apart = found.withColumn("side", F.lit(1)).unionByName(kept.withColumn("side", F.lit(-1))).groupBy("shard", "documents", "ids", "root")
    wrong = apart.agg(F.sum("side").alias("side"), F.count(F.lit(1)).alias("rows")).where("side <> 0 OR rows <> 2").limit(1).collect()
    if wrong:
        raise ValueError(f"shard {wrong[0]['shard']} does not match the manifest")


def read_back(spark: SparkSession, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Recipes are
    held against the manifest at once, chunks against the recipes as the rows are read."""
    recipes = spark.read.parquet(f"{root}/recipes")
    shards = spark.read.parquet(f"{root}/manifest")
    check_manifest(recipes, shards)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(digest(p) != n for n, p in zip(names, payloads, strict=True)):
                raise ValueError("a chunk does not match its name")
            sizes = np.fromiter(map(len, payloads), np.int64, len(payloads)) // width
            wide = memoryview(np.frombuffer(b"".join(payloads), held).astype("<u4").tobytes())
            ends = (4 * np.cumsum(sizes)).tolist()
            sums = [zlib.crc32(wide[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array(sizes)], ["digest", "crc", "size"])

    width = int(spark.read.parquet(f"{root}/format").first()["width"])
    held = "<u2" if width == 2 else "<u4"
    known = chunks_of(spark, root).mapInArrow(verify, "digest binary, crc bigint, size bigint")

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            counts = np.fromiter(map(len, sizes), np.int64, len(sizes)) // 4
            planned = np.frombuffer(b"".join(sizes), "<u4").astype(np.int64)
            before = np.cumsum(planned) - planned
            ends = np.cumsum(counts)
            total = np.append(before, planned.sum())[ends]  # ids of all documents up to each one's end
            after = 4 * (np.repeat(total, counts) - before - planned)
            names = pa.Array.from_buffers(pa.binary(DIGEST), len(planned), [None, pa.py_buffer(b"".join(digests))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner := pa.array(np.repeat(np.arange(len(counts)), counts))), batch.column(1).take(owner), names, pa.array(after), pa.array(planned)], ["shard", "line", "digest", "after", "planned"])

    # check_manifest has held these recipes' names and sizes against their roots
    parts = recipes.select("shard", "line", "digests", "sizes").mapInArrow(unroll, "shard int, line bigint, digest binary, after bigint, planned bigint")

    @F.pandas_udf("long")
    def carried(crc, after):
        import pandas as pd

        return pd.Series(shift_crc(crc.to_numpy(), after.to_numpy()).astype(np.int64))

    # the error stands in the value itself, as a column that nothing reads would be pruned
    crc = F.when(F.col("crc").isNotNull() & (F.col("size") == F.col("planned")), F.col("crc")).otherwise(F.raise_error("a recipe names a chunk that is missing or of another size").cast("long"))
    joined = parts.join(known, "digest", "left").select("shard", "line", "size", carried(crc, "after").alias("crc"))
    whole = joined.groupBy("shard", "line").agg(F.sum("size").alias("read_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    n_tokens = F.when(F.col("read_tokens") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error("a document's chunks do not have its ids").cast("long"))
    # the manifest holds a row for each shard, as many as the range partitioning had
    before = shards.select("shard", (F.sum("ids").over(W.orderBy("shard")) - F.col("ids")).alias("offset"))
    return recipes.select("shard", "line", "doc_id", F.col("start").alias("inner"), "n_tokens").join(whole, ["shard", "line"], "left").join(before, "shard").select("doc_id", (F.col("offset") + F.col("inner")).alias("start"), n_tokens.alias("n_tokens"), "ids_crc32")


def reconstruct(spark: SparkSession, root: str, lines: DataFrame) -> DataFrame:
    """The ids themselves of chosen recipes (columns shard, line): shard, line, doc_id, ids (little-endian unsigned 32-bit bytes)."""
    width = int(spark.read.parquet(f"{root}/format").first()["width"])
    held = "<u2" if width == 2 else "<u4"
    chosen = lines.select("shard", "line").distinct().join(spark.read.parquet(f"{root}/recipes"), ["shard", "line"], "left")

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("line", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("parts_", pa.int32()), ("digest", pa.binary())])
        for batch in batches:
            rows = []
            for shard, line, doc, top, digests, sizes, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if top is None:
                    raise ValueError(f"there is no recipe in line {line} of shard {shard}")
                names = _names(top, digests, sizes, n)
                rows += ((shard, line, doc, k, len(names), name) for k, name in enumerate(names))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    spread = chosen.select(F.col("shard").cast("int"), F.col("line").cast("long"), "doc_id", "root", "digests", "sizes", "n_tokens").mapInArrow(unroll, "shard int, line bigint, doc_id bigint, k int, parts_ int, digest binary")

    @F.pandas_udf("binary")
    def widen(name, payload):
        def checked(n, p):
            if p is None:
                raise ValueError("a recipe names a chunk that is missing")
            if digest(p) != n:
                raise ValueError("a chunk does not match its name")
            return np.frombuffer(p, held).astype("<u4").tobytes()

        return name.combine(payload, checked)

    got = spread.join(chunks_of(spark, root), "digest", "left").select("shard", "line", "doc_id", "parts_", "k", widen("digest", "payload").alias("ids"))
    parts = got.groupBy("shard", "line", "doc_id", "parts_").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    whole = F.when(F.size("parts") == F.col("parts_"), F.col("parts")).otherwise(F.raise_error("a chunk is stored more than once"))
    return parts.select("shard", "line", "doc_id", F.aggregate(whole, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def token_store(docs: DataFrame, tokenizer: str, root: str | None = None, **options) -> tuple[str, DataFrame]:
    """Writes the store of docs and reads it back: its root folder and read_back's rows."""
    spark = docs.sparkSession
    root = root or fresh_path(spark, "tokens")
    width = Encoder(tokenizer).width
    spark.createDataFrame([(width,)], "width int").coalesce(1).write.parquet(f"{root}/format")
    write_store(docs, root, tokenizer, **options)
    return root, read_back(spark, root)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), default_tokenizer())[1]
