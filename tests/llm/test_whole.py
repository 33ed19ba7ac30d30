"""Results that an earlier round cut short."""

import random
import re
import shutil
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, langid, mixing, pii, simhash, tokenstore


def test_pii_gate_skips_no_disguise(monkeypatch):
    for text, span in (("write john.doe at example.com today", "john.doe at example.com"), ("write john @ example.com today", "john @ example.com"), ("write john at mail . example . com", "john at mail . example . com")):
        assert [text[a:b] for _, a, b in pii.find(text)[1]] == [span]
    rng = random.Random(8)
    pieces = ["ann", "lee", "mail", "org", "c-o", ".", "@", "at", "AT", "dot", "point", "[", "]", "(at)", "[dot]", "plus", "one", "two", "7", ",", " ", " ", " ", "  ", "\n", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 16))) for _ in range(20_000)]
    gated = [pii.deobfuscate(t).text for t in texts]
    monkeypatch.setattr(pii, "_HINT", re.compile(""))
    assert gated == [pii.deobfuscate(t).text for t in texts]


def test_pii_spans_reach_beyond_their_base_part():
    for part, whole in (("hn@example.com", "j\u043ehn@example.com"), ("lee@example.com", "ann [dot] lee@example.com"), ("hn@example.com", "jo\u200bhn@example.com"), ("john@mail.ex", "john@mail.ex\u0430mple.com")):
        text = f"to {whole} now"
        base, every = pii.find(text)
        assert [text[a:b] for _, a, b in base] == [part]
        assert {text[a:b] for _, a, b in every} == {part, whole}
        assert set(base) <= set(every)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "zug", "of", "the", "12"]) for _ in range(900)) for _ in range(6)]
    root = f"{tmp_path_factory.mktemp('store')}/s"
    tokenstore.token_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenstore.default_tokenizer(), root)
    return root


def altered(spark, store, tmp_path, part, change):
    """A copy of the store, of which one table is written anew."""
    root = f"{tmp_path}/s"
    shutil.copytree(store, root)
    source = spark.read.parquet(f"{store}/{part}")
    shutil.rmtree(f"{root}/{part}")
    change(source).write.parquet(f"{root}/{part}")
    return root


BROKEN = [
    ("staged/kind=1", lambda df: df.where(F.col("digest") != df.agg(F.min("digest")).first()[0])),
    ("staged/kind=1", lambda df: df.withColumn("payload", F.reverse(F.hex("payload")).cast("binary"))),
    ("staged/kind=1", lambda df: df.union(df.limit(1))),
    ("recipes", lambda df: df.withColumn("root", F.col("digests").substr(1, 15))),
    ("recipes", lambda df: df.withColumn("digests", F.concat(F.col("digests").substr(17, 1 << 20), F.col("digests").substr(1, 16)))),
    ("recipes", lambda df: df.where("doc_id <> 2")),
    ("recipes", lambda df: df.withColumn("n_tokens", F.col("n_tokens") + 1)),
    ("manifest", lambda df: df.withColumn("ids", F.col("ids") + 1)),
    ("manifest", lambda df: df.withColumn("documents", F.col("documents") + 1)),
    ("manifest", lambda df: df.withColumn("root", F.reverse(F.hex("root")).cast("binary"))),
    ("manifest", lambda df: df.where("shard <> 0")),
]


@pytest.mark.parametrize(("part", "change"), BROKEN)
def test_token_store_reading_finds_what_is_broken(spark, store, tmp_path, part, change):
    root = altered(spark, store, tmp_path, part, change)
    with pytest.raises(Exception, match="match|missing|do not"):
        tokenstore.read_back(spark, root).collect()
    if part != "manifest":
        lines = spark.read.parquet(f"{store}/recipes").select("shard", "line")
        with pytest.raises(Exception, match="match|missing|more than once|there is no"):
            tokenstore.reconstruct(spark, root, lines).collect()


def ideal_mix(blocks, weights):
    """Of each source what it has had after each slot, sources leaving as they are used up: exact, phase by phase."""
    had, lines = dict.fromkeys(blocks, Fraction(0)), []
    left = Fraction(0)  # of the slot
    for _ in range(sum(blocks.values())):
        left = Fraction(1)
        while left:
            live = [s for s in blocks if had[s] < blocks[s]]
            live = [s for s in live if weights.get(s, 0) > 0] or live
            share = {s: Fraction(weights.get(s, 0) or 1) for s in live}
            total = sum(share.values())
            step = min(left, *((blocks[s] - had[s]) * total / share[s] for s in live))
            for s in live:
                had[s] += step * share[s] / total
            left -= step
        lines.append(dict(had))
    return lines


def within_a_block(blocks, weights):
    rows = list(mixing.schedule(blocks, weights))
    assert [r[5] for r in rows] == list(range(sum(blocks.values())))
    assert all(released <= slot < due for *_, released, due, slot in rows)
    done = dict.fromkeys(blocks, 0)
    for (s, block, *_), want in zip(rows, ideal_mix(blocks, weights), strict=True):
        assert block == done[s]
        done[s] += 1
        assert all(abs(done[x] - want[x]) < 1 for x in blocks)


def test_mixing_is_within_a_block_of_the_given_weights():
    rng = random.Random(5)
    within_a_block({"a": 40, "b": 7, "c": 1, "d": 90}, {"a": 0.3, "b": 0.001, "d": 2.0})
    within_a_block({f"s{k}": rng.randint(1, 6) for k in range(40)}, {f"s{k}": rng.random() for k in range(38)})
    within_a_block({"big": 60, **{f"s{k}": 1 for k in range(60)}}, {"big": 0.1} | {f"s{k}": 0.015 for k in range(60)})


def test_mixing_holds_the_weights_over_a_long_schedule(spark):
    sizes = {"hot": 20_000, **{f"s{k}": 2105 for k in range(19)}}
    docs = spark.createDataFrame([(k, s) for s, n in sizes.items() for k in range(n)], "doc_id long, source string")
    got = {(r.source_, r.block): r.slot for r in mixing.mix(docs).select("source_", "block", "slot").distinct().collect()}
    assert sorted(got.values()) == list(range(len(got)))
    hot = np.array(sorted(slot for (s, _), slot in got.items() if s == "hot"))
    until = min(max(slot for (s, _), slot in got.items() if s == x) for x in sizes)  # all sources are open so far
    hot, share = hot[hot < until], 20_000**0.5 / sum(n**0.5 for n in sizes.values())
    assert len(hot) > 150
    assert (abs(np.arange(1, len(hot) + 1) - share * (hot + 1)) < 1).all()


def test_mixing_takes_any_number_of_sources(spark):
    docs = spark.createDataFrame([(k, f"host{k % 1500}") for k in range(4000)], "doc_id long, source string")
    got = mixing.mix(docs, block=2).collect()
    assert len(got) == 4000
    assert all(r.released <= r.slot < r.due for r in got)


def test_clean_cuts_the_same_in_any_number_of_passes(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    whole = " ".join(words[:30])
    texts = [whole, f"Before, {whole.upper()} after.", None, "", "...", "nothing of it", " ".join(words), *(" ".join(rng.choices(words[:4], k=25)) for _ in range(40))]
    rows = [(k, t, None if t is None else len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, n_chars long")
    items = [(k, " ".join(words[k : k + 14])) for k in range(0, 30, 4)] + [(100 + k, " ".join(rng.choices(words[:4], k=3))) for k in range(8)] + [(200, None), (None, "nothing")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc, text, _ in [*rows, rows[1]]:
        given = decontam.words_of(text)
        covered = np.zeros(len(given), bool)
        for item, passage in items:
            w = decontam.words_of(passage) if item is not None else []
            for window in {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else ():
                for k in range(len(given) - len(window) + 1):
                    if tuple(given[k : k + len(window)]) == window:
                        covered[k : k + len(window)] = True
        if not covered.any() or not covered.all():
            left = decontam.cut(text, decontam.spans_of(text, covered)) if covered.any() else text
            want.append((doc, left, None if left is None else len(left)))
    for pass_words in (decontam.PASS_WORDS, 40, 3):
        got = decontam.clean(docs, bench, pass_words=pass_words)
        assert got.columns == docs.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def one_of_each_group(rows):
    """Of rows (id, text, ...) the first of each group by id, nulls last; groups from all pairs of fingerprints."""
    fp = np.array([simhash.fingerprint(r[1]) for r in rows], np.uint64)
    label, old = np.arange(len(rows)), None
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= simhash.MOST_BITS
    while old is None or (label != old).any():
        old, label = label, np.array([label[line].min() for line in near])
    first = {}
    for row, group in sorted(zip(rows, label, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(group, row)
    return list(first.values())


def near_texts(seed):
    """Two texts with fingerprints that differ, but in few bits."""
    rng = random.Random(seed)
    while True:
        words = [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(400)]
        other = " ".join([*words[:-1], "other"])
        if 0 < (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(other)).bit_count() <= simhash.MOST_BITS:
            return " ".join(words), other


def test_keep_first_keeps_one_row_of_each_group(spark):
    (a, b), (c, d), (e, f) = near_texts(1), near_texts(2), near_texts(3)
    rows = [(5, a), (5, c), (None, b), (None, e), (None, f), (None, e), (7, d), (5, a), (9, "one more text of its own"), (None, None)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [5, 5, 9]
    assert {r.text for r in got if r.doc_id == 5} == {a, c}
    assert len([r for r in got if r.doc_id is None and r.text in (e, f)]) == 1
    assert len(got) == len(one_of_each_group(rows)) == 5


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(400)
    extra = given.where("doc_id IS NOT NULL").orderBy("doc_id").limit(3)
    docs = given.unionByName(extra).unionByName(extra.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    other = given.orderBy(F.desc("doc_id")).limit(1).withColumn("doc_id", F.lit(extra.first()["doc_id"])).withColumn("text", F.concat("text", F.lit(" and then the river of the old town was seen from the hill with all of its boats")))
    docs.unionByName(other.select(docs.columns)).withColumn("doc_id", F.col("doc_id").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = langid.identify(docs).where("accepted_").select("row_.doc_id", "row_.text", "row_.source", F.xxhash64("row_.doc_id")).collect()
    rows = one_of_each_group([tuple(r) for r in known])
    windows = {}
    for item, text in spark.read.parquet(f"{tmp_path}/benchmark.parquet").select("item_id", "text").collect():
        w = decontam.words_of(text) if item is not None else []
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(len(w[k : k + 10]), set()).add(tuple(w[k : k + 10]))
    left = []
    for doc, text, source, key in rows:
        w = decontam.words_of(text)
        covered = np.zeros(len(w), bool)
        for size, known_ in windows.items():
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in known_:
                    covered[k : k + size] = True
        if not covered.any() or not covered.all():
            left.append((doc, decontam.cut(text, decontam.spans_of(text, covered)) if covered.any() else text, mixing.NO_SOURCE if source is None else source, key))
    by_source = {}
    for row in sorted(left, key=lambda r: r[3]):
        by_source.setdefault(row[2], []).append(row)
    order = []
    for s, block, *_ in mixing.schedule({s: -(-len(x) // 32) for s, x in by_source.items()}, {s: len(x) ** 0.5 for s, x in by_source.items()}):
        order += by_source[s][32 * block : 32 * block + 32]
    library, want, start = Tokenizer.from_file(tokenstore.default_tokenizer()), [], 0
    for doc, text, *_ in order:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, tokenstore.END_ID], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(want) > 100
    assert sorted(got, key=lambda r: r[1]) == want
