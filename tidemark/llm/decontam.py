"""Operator 1, benchmark decontamination: an FM-index per training shard.

Phrases are the 10-word windows of the benchmark items (an item of fewer words, but not none, is one window).
A shard is a bounded run of documents inside one task. Its words become symbols of the phrases' vocabulary;
stretches too short for any phrase, or of words that no phrase has, cannot hold an occurrence and shrink to a
separator. Over that text an FM-index is built; every phrase is searched backwards through wavelet ranks,
occurrences are located by sampled suffix positions, and their word ranges merge into removal spans.

Defined results: a null or wordless text has no spans; null item texts and null item ids are ignored; an empty
benchmark leaves every document clean; repeated rows give repeated results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import LOWER, WORD_BYTES, WORD_CHARS, ready, sliced, table
from .fmindex import SEPARATOR, FMIndex

WINDOW = 10
#: Words of benchmark text searched in one pass: its windows are 40 bytes each, its distinct words some 100, so that a
#: broadcast stays under 70 MB and the driver under 300 MB.
PASS_WORDS = 500_000
#: Words of a shard; bounds a worker's memory.
SHARD_WORDS = 400_000

SPAN = "struct<word_start:bigint,word_end:bigint,char_start:bigint,char_end:bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, spans array<{SPAN}>, item_ids array<string>, clean_text string"


def words_of(text: str | None) -> list[bytes]:
    return WORD_BYTES.findall((text or "").encode().translate(LOWER))


class Phrases:
    """The distinct windows of a block of items, as symbols, by length: lines (a window each), and in owners, from
    bounds[k] to bounds[k + 1], the items of window k."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.symbol: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.items)}
        lines: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                ids = np.fromiter((self.symbol.setdefault(w, len(self.symbol) + 1) for w in words), np.int32, len(words))
                size = min(window, len(ids))
                made = np.lib.stride_tricks.sliding_window_view(ids, size)
                lines.setdefault(size, []).append(made)
                owners.setdefault(size, []).append(np.full(len(made), number[item], np.int32))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted(lines):
            distinct, which = np.unique(np.concatenate(lines.pop(size)), axis=0, return_inverse=True)
            pairs = np.unique(which.reshape(-1).astype(np.int64) * len(self.items) + np.concatenate(owners.pop(size)))
            bounds = np.searchsorted(pairs // len(self.items), np.arange(len(distinct) + 1))
            self.by_length[size] = (distinct, (pairs % len(self.items)).astype(np.int32), bounds)
        self.shortest = min(self.by_length, default=0)

    def names(self, size: int, line: int) -> list[str]:
        _, owners, bounds = self.by_length[size]
        return [self.items[k] for k in owners[bounds[line] : bounds[line + 1]].tolist()]


def shard_hits(words: list[list[bytes]], phrases: Phrases, sample: int) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Of the documents of a shard: where each begins, which words are hit, and the items found in each."""
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    total = int(starts[-1])
    hit = np.zeros(total + 1, np.int64)
    found: list[set[str]] = [set() for _ in words]
    get = phrases.symbol.get
    ids = np.fromiter((get(w, 0) for doc in words for w in doc), np.int64, total)
    if not total or not phrases.shortest:
        return starts, hit[:total] > 0, found
    # stretches of known words inside one document
    known = ids != 0
    if not known.any():
        return starts, hit[:total] > 0, found
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    inner = starts[:-1][sizes > 0]
    opens[inner] = known[inner]
    stretch = np.cumsum(opens) - 1
    lengths = np.bincount(stretch[known], minlength=int(stretch[-1]) + 1 if total else 0)
    kept = np.flatnonzero(known & (lengths[np.maximum(stretch, 0)] >= phrases.shortest))
    if not len(kept):
        return starts, hit[:total] > 0, found
    ends = np.append(stretch[kept][1:] != stretch[kept][:-1], True)  # a separator follows each stretch
    at = np.arange(len(kept)) + np.concatenate(([0], np.cumsum(ends)[:-1]))
    text = np.full(int(at[-1]) + 2, SEPARATOR, np.int64)
    text[at] = ids[kept]
    place = np.zeros(len(text), np.int64)
    place[at] = kept
    index = FMIndex(text, len(phrases.symbol), sample)
    for size, (lines, _, _) in phrases.by_length.items():
        low, high = index.search(lines.astype(np.int64))
        some = np.flatnonzero(high > low)
        if not len(some):
            continue
        counts = (high - low)[some]
        rows = np.repeat(low[some], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        first = place[index.locate(rows)]
        np.add.at(hit, first, 1)
        np.add.at(hit, first + size, -1)
        doc = np.searchsorted(starts, first, "right") - 1
        for pair in np.unique(doc * len(lines) + np.repeat(some, counts)):
            found[pair // len(lines)].update(phrases.names(size, int(pair % len(lines))))
    return starts, np.cumsum(hit[:total]) > 0, found


def spans_of(text: str, covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    places = [m.span() for m in WORD_CHARS.finditer(text.encode().translate(LOWER).decode())]
    return [{"word_start": int(a), "word_end": int(b), "char_start": places[a][0], "char_end": places[b - 1][1]} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def cut(text: str, spans: list[dict]) -> str:
    """The text without its spans; a line break stands for each, so that no new phrase forms across a cut."""
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["char_start"]])
        at = s["char_end"]
    return "\n".join([*out, text[at:]]) if spans else text


def _edges(covered: np.ndarray) -> list[int]:
    """Begins and ends of the runs of covered words."""
    return np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist()


def scan(batches: Iterator[pa.RecordBatch], phrases: Phrases, sample: int, last: bool, with_text: bool) -> Iterator[pa.RecordBatch]:
    """In: doc_id, text, and what earlier passes found: edges (begins and ends of words) and item_ids. Out: the same with
    this pass's findings, or, from the last one, rows of SCHEMA."""
    carried = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("edges", pa.list_(pa.int64())), ("item_ids", pa.list_(pa.string()))])
    told = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(k, pa.int64()) for k in ("word_start", "word_end", "char_start", "char_end")]))), ("item_ids", pa.list_(pa.string())), ("clean_text", pa.string())])

    def flush(rows: list[tuple], words: list[list[bytes]]) -> pa.RecordBatch:
        starts, covered, found = shard_hits(words, phrases, sample)
        for k, (_, _, edges, items) in enumerate(rows):
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                covered[starts[k] + a : starts[k] + b] = True
            found[k].update(items)
        parts = [covered[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        items = [sorted(x) for x in found]
        if last:
            spans = [spans_of(r[1], part) if named else [] for r, part, named in zip(rows, parts, items, strict=True)]
            schema, columns = told, [[r[0] for r in rows], [len(w) for w in words], spans, items, [cut(r[1], s) if with_text and r[1] is not None else None for r, s in zip(rows, spans, strict=True)]]
        else:
            schema, columns = carried, [[r[0] for r in rows], [r[1] for r in rows], [_edges(p) for p in parts], items]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows, words, size = [], [], 0
    for batch in sliced(batches):
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            rows.append(row)
            words.append(words_of(row[1]))
            size += len(words[-1])
            if size >= SHARD_WORDS or len(rows) >= 20_000:
                yield flush(rows, words)
                rows, words, size = [], [], 0
    if rows:
        yield flush(rows, words)


def _passes(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, pass_words: int) -> Iterator[tuple[object, bool]]:
    """The phrases of each pass, broadcast, and whether it is the last; one at a time reaches the driver."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("body")).where("item IS NOT NULL AND body IS NOT NULL").distinct()
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    count = max(1, -(-size // (4 * pass_words)))
    for k in range(count):
        block = items if count == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k)
        yield spark.sparkContext.broadcast(Phrases([tuple(r) for r in block.collect()], window)), k == count - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, sample: int = 8, with_text: bool = True, pass_words: int = PASS_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (words and code points, ends exclusive, merged), item_ids (sorted),
    clean_text (the text without its spans; null stays null).

    A larger benchmark is searched pass_words at a time; each pass hands its findings on beside the row, in the same
    task, and the last one merges them. Nothing is shuffled.
    """
    ready(docs.sparkSession)
    none = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<string>)")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), none[0].alias("edges"), none[1].alias("item_ids"))
    for held, last in _passes(benchmark, item_col, item_text_col, window, pass_words):
        out = out.mapInArrow(lambda batches, held=held, last=last: scan(batches, held.value, sample, last, with_text), SCHEMA if last else "doc_id bigint, text string, edges array<bigint>, item_ids array<string>")
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["word_end"] - s["word_start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP1_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT rid, size, s, array_to_string(w[s : s + size - 1], ' ') AS gram
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT g.rid, g.s, g.size, x.item_id FROM grams g JOIN windows x ON g.size = x.size AND g.gram = x.gram),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (rid) LEFT JOIN named n USING (rid)
"""


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", length_col: str = "n_chars", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, sample: int = 8, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of docs, all columns, with the spans cut out of text_col (length_col, if there is one, follows).
    A document of which the cuts leave no word goes; every other one stays. Each pass of a larger benchmark searches
    the texts as given and hands on the words that it found beside the row; the last one cuts."""
    ready(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    lengths = length_col if length_col in names else None
    carried = "_words_found"
    while carried in names:
        carried += "_"
    wide = StructType([*schema.fields, StructField(carried, ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch], held, last: bool) -> Iterator[pa.RecordBatch]:
        def flush(group: list[pa.RecordBatch], words: list[list[bytes]]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
            starts, covered, _ = shard_hits(words, held.value, sample)
            if carried in whole.schema.names:  # begins and ends of the words that earlier passes found
                for k, edges in enumerate(whole.column(carried).to_pylist()):
                    for a, b in zip(edges[::2], edges[1::2], strict=True):
                        covered[starts[k] + a : starts[k] + b] = True
                whole = whole.drop_columns([carried])
            if not last:
                edges = [_edges(covered[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                return pa.RecordBatch.from_arrays([*whole.columns, pa.array(edges, pa.list_(pa.int64()))], [*whole.schema.names, carried])
            hit = np.unique(np.searchsorted(starts, np.flatnonzero(covered), "right") - 1).tolist()
            if not hit:
                return whole
            column = names.index(text_col)
            texts, stays = whole.column(column).to_pylist(), np.ones(len(words), bool)
            counts = whole.column(names.index(lengths)).to_pylist() if lengths else None
            for k in hit:
                texts[k] = cut(texts[k], spans_of(texts[k], covered[starts[k] : starts[k + 1]]))
                stays[k] = not covered[starts[k] : starts[k + 1]].all()
                if counts:
                    counts[k] = len(texts[k])
            arrays = list(whole.columns)
            arrays[column] = pa.array(texts, whole.schema.field(column).type)
            if counts:
                at = names.index(lengths)
                arrays[at] = pa.array(counts, whole.schema.field(at).type)
            return pa.RecordBatch.from_arrays(arrays, schema=whole.schema).filter(pa.array(stays))

        group, words, size = [], [], 0
        for batch in sliced(batches):
            if batch.num_rows:
                group.append(batch)
                words += [words_of(t) for t in batch.column(names.index(text_col)).to_pylist()]
                size += sum(map(len, words[-batch.num_rows :]))
            if size >= SHARD_WORDS or len(words) >= 20_000:
                yield flush(group, words)
                group, words, size = [], [], 0
        if group:
            yield flush(group, words)

    for held, last in _passes(benchmark, item_col, item_text_col, window, pass_words):
        docs = docs.mapInArrow(lambda batches, held=held, last=last: run(batches, held, last), schema if last else wide)
    return docs
