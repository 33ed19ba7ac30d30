"""The corpus operators against brute force, and their defined edge cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import chat, decontam, langid, licenses, media, mixing, pii, quality, simhash, tokenstore
from tidemark.llm.fmindex import FMIndex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "émile", "zug"]


def rows(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    texts[5] = texts[4]
    texts[7] = texts[6] + " omega"
    out = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), len(t), 0.5, "k") for k, t in enumerate(texts)]
    return [*out, (n, None, None, None, None, None, None), (n + 1, "", "en", "a", 0, 1.0, None), (None, "alpha beta", "en", "b", 10, 1.0, "x"), out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    for _ in range(30):
        text = np.append(rng.integers(0, 4, 200), 0)
        index = FMIndex(text, 3, 4)
        for size in (1, 2, 3, 6):
            lines = rng.integers(1, 4, (5, size))
            for low, high, line in zip(*index.search(lines), lines, strict=True):
                found = sorted(index.locate(np.arange(low, high)).tolist())
                assert found == [k for k in range(len(text) - size + 1) if (text[k : k + size] == line).all()]


@pytest.mark.parametrize("pass_words", [decontam.PASS_WORDS, 8])
def test_decontaminate(spark, docs, pass_words):
    texts = [r[1] for r in rows()]
    bench = [(1, texts[3]), (2, "alpha beta"), (3, None), (None, "zug"), (4, "nothing of this"), (5, "")]
    got = decontam.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string"), pass_words=pass_words).collect()
    windows = {}
    for item, text in bench:
        w = decontam.words_of(text)
        for k in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    want = []
    for doc, text, *_ in rows():
        w, hit, items = decontam.words_of(text), set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in windows}:
                if k + size <= len(w) and (found := windows.get(tuple(w[k : k + size]))):
                    hit.update(range(k, k + size))
                    items |= found
        want.append(repr((doc, len(w), len(hit), sorted(items))))
    assert sorted(repr((r.doc_id, r.n_words, sum(s.word_end - s.word_start for s in r.spans), list(r.item_ids))) for r in got) == sorted(want)


def test_simhash_components(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    fp = np.array([r.fp for r in got], np.int64).view(np.uint64)
    ids = [r.doc_id for r in got]
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    label = list(range(len(ids)))
    for _ in ids:
        label = [min(label[k] for k in np.flatnonzero(line)) for line in near]
    least = {}
    for k, x in enumerate(label):
        least[x] = min([i for i in (least.get(x), ids[k]) if i is not None], default=None)
    assert [r.component_id for r in got] == [least[x] for x in label]


def test_simhash_long_runs_lose_no_link(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")

    def components(run):
        links = [(r.u, r.v) for r in simhash.similar_links(df, run, 16).collect()]
        label = {f: f for f in np.array(fps, np.uint64).view(np.int64).tolist()}
        for _ in range(len(fps)):
            for u, v in links:
                label[u] = label[v] = min(label[u], label[v])
        return label

    assert components(8) == components(2048)


def test_simhash_keeps_one_of_each_group(docs, empty):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(found.values()))
    assert simhash.near_duplicates(empty).count() == 0


def test_mixing_stays_within_a_block(docs, empty):
    got = mixing.mix(docs, block=2).collect()
    assert len(got) == docs.count()
    assert all(r.released <= r.slot < r.due for r in got)
    blocks = {(r.source_, r.block): r.slot for r in got}
    assert sorted(blocks.values()) == list(range(len(blocks)))
    assert mixing.mix(empty).count() == 0


def test_period_is_fair():
    units = {"a": 500, "b": 300, "c": 150, "d": 74}
    slots, period = mixing.period_table(units), sum(units.values())
    for s, u in units.items():
        done = np.searchsorted(slots[s], np.arange(period + 1))
        assert (abs(done - np.arange(period + 1) * u / period) < 1).all()


def test_language(spark):
    made = [(k, (t + " ") * 40, lang, "h.de", len(t), 1.0, "") for k, (t, lang) in enumerate([("die und der nicht ist", "de"), ("the and of with from", "en"), ("les des une avec dans", "fr"), ("los las una con para", "es")] * 20)]
    made += [(900, "русский текст совсем другой " * 5, None, None, 1, 1.0, ""), (901, None, None, None, 1, 1.0, "")]
    got = {r.row_.doc_id: r for r in langid.identify(spark.createDataFrame(made, SCHEMA)).collect()}
    assert all(got[k].lang_ == made[k][2] and got[k].accepted_ for k in range(80))
    assert not got[900].accepted_
    assert got[900].lang_ == "und"


def test_token_store_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenstore.default_tokenizer()
    library = Tokenizer.from_file(path)
    root, read = tokenstore.token_store(docs, path)
    ids_of = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    want = [(d, ids_of(t)) for d, t, *_ in rows()]
    got = read.orderBy("start").collect()
    assert sorted(repr((d, len(b) // 4, zlib.crc32(b))) for d, b in want) == sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    recipes = spark.read.parquet(f"{root}/recipes")
    again = tokenstore.reconstruct(spark, root, recipes).collect()
    assert sorted(repr((r.doc_id, bytes(r.ids))) for r in again) == sorted(repr((d, b)) for d, b in want)
    assert tokenstore.token_store(empty, path)[1].count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenstore.default_tokenizer()
    library, ours = Tokenizer.from_file(path), tokenstore.Encoder(path)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", "É", "é", ".", ",", "'s", " ", "\n", "\t", "1", "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "日"]) for _ in range(40))
        assert np.frombuffer(ours([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_keeps_ids_when_its_tables_turn_over():
    ours = tokenstore.Encoder(tokenstore.default_tokenizer(), held=50)
    rng = random.Random(6)
    for _ in range(40):
        texts = ["".join(rng.choice("abcßéèzAÉ''s#%,.<|>_-1² \n\u0301\u0338") for _ in range(rng.randrange(80))) for _ in range(50)]
        want = ours.library.encode_batch_fast(texts, add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in ours(texts)] == [e.ids for e in want]


def test_encoder_looks_up_a_word_once_a_batch():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    ours = tokenstore.Encoder(tokenstore.default_tokenizer())
    texts = ["of, the And\nend. " * 500, "", ".of the, <|endoftext|> The, end", "<|", ", end,\n", "\n"] * 5
    want = [e.ids for e in ours.library.encode_batch_fast(texts, add_special_tokens=False)]
    ours.young = Counted()
    assert [np.frombuffer(x, "<u4").tolist() for x in ours(texts)] == want
    assert Counted.asked < 100
    assert ours([]) == []


def test_encoding_holds_little_at_a_time(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenstore.default_tokenizer()
    library, rng, asked, cut, plain_cuts = Tokenizer.from_file(path), random.Random(9), [], [], tokenstore.cuts

    class Watched:
        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    encoder = tokenstore.Encoder(path)
    encoder.library = Watched()
    monkeypatch.setattr(tokenstore, "encoder_of", lambda path: encoder)
    monkeypatch.setattr(tokenstore, "cuts", lambda ids, starts: cut.append(len(starts) - 1) or plain_cuts(ids, starts))
    texts = [" ".join(f"{rng.randrange(10**6)}" for _ in range(rng.randrange(20))) + " end" * rng.choice([0, 0, 900]) for _ in range(1200)]
    ids = pa.array(range(len(texts)), pa.int64())
    made = list(tokenstore.encode_partition(iter([pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts)], ["doc_id", "ord1", "ord2", "text"])]), path))
    assert sum(asked) > 5000
    assert max(asked) <= 2000
    assert sum(cut) == len(texts)
    assert max(cut) <= 250
    rows = [r for b in made for r in b.to_pylist()]
    payload = {r["digest"]: r["payload"] for r in rows if r["kind"] == 1}
    got = {r["doc_id"]: b"".join(payload[r["payload"][k : k + 16]] for k in range(0, len(r["payload"]), 16)) for r in rows if r["kind"] == 0}
    assert got == {k: np.array([*e.ids, 1], "<u2").tobytes() for k, e in enumerate(library.encode_batch_fast(texts, add_special_tokens=False))}
    assert sum(r["n_tokens"] for r in rows if r["kind"] == 0) == sum(len(x) // 2 for x in got.values())


def test_a_worker_encodes_on_its_own_core(spark):
    path = tokenstore.default_tokenizer()

    def threads(batches):
        for b in batches:
            before = len(os.listdir("/proc/self/task"))
            encoder = tokenstore.encoder_of(path)
            encoder([" ".join(f"{k}é{n}" for k in range(4000)) for n in range(3)])
            yield pa.RecordBatch.from_arrays([pa.array([len(os.listdir("/proc/self/task")) - before], pa.int64())], ["more"])

    tokenstore.ready(spark)
    assert spark.range(1).mapInArrow(threads, "more long").first()["more"] == 0


def test_pii_equals_plain_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab1.2@+- ()_%é") for _ in range(rng.randint(1, 40)))
        found = pii.detect(text)
        assert [s[1:] for s in found if s[0] == "email"] == [m.span() for m in email.finditer(text)]
        assert [s[1:] for s in found if s[0] == "ip"] == [m.span() for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]


def test_pii_disguises_map_back():
    for text, span in (("to ann (at) mail [dot] org now", "ann (at) mail [dot] org"), ("x jоhn@exаmple.com y", "jоhn@exаmple.com"), ("call plus one four one five five five five one two three four ok", "plus one four one five five five five one two three four")):
        base, every = pii.find(text)
        assert not base
        assert [text[a:b] for _, a, b in every] == [span]
    assert pii.find(None) == ([], [])


def test_licenses(spark, empty):
    texts = ["Released under the MIT License.", "x Licensed under the Apache License, Version 2.0. y", "CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3.", "license software free", None, ""]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [",".join(got[k].labels) for k in range(7)] == ["mit", "apache-2", "cc-by-nc", "gpl-3", "", "", ""]
    assert [list(got[k].base) for k in range(3)] == [[1], [4], [0]]
    assert licenses.scan(empty).count() == 0


def test_media_round_trip(docs):
    stored = media.store(docs)
    for r, (_, text, *_) in zip(sorted(media.describe(stored).collect(), key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows(), key=lambda r: (r[0] is None, r[0])), strict=True):
        assert r.payload_sha256 == hashlib.sha256(media.payload_of(text)).hexdigest()
        assert len(r.landmarks)


def test_quality_machine_uses_pairs():
    rng = np.random.default_rng(1)
    made, labels = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        made.append((np.array([a, 2 + b]), np.ones(2)))
        labels.append(a == b)
    machine = quality.Machine().fit(made, np.array(labels, float), epochs=60)
    assert all((machine.score(np.array([a, 2 + b]), np.ones(2)) > 0.5) == (a == b) for a in (0, 1) for b in (0, 1))


def test_chat_prefix(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None)]
    conv = chat.turns_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv: r.turns for r in conv.collect()}
    pairs = spark.createDataFrame([(0, got[0], got[1]), (1, got[2], None)], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    first, second = sorted(chat.preference_pairs(pairs).collect(), key=lambda r: r.pair_id)
    assert (first.n_common, first.prompt) == (1, "<|user|>\nhi<|end|>\n")
    a, b = map(int, first.chosen_mask.split(":"))
    assert first.chosen[a:b] == "yes<|end|>\n"
    assert second.rejected is None


def test_fingerprint_brute():
    text = "A b c d e f É"
    w = text.lower().replace("é", "É").split()
    hashes = [xxhash.xxh64(" ".join(w[k : k + 4]).encode(), seed=42).intdigest() for k in range(len(w) - 3)]
    assert simhash.fingerprint(text) == sum((2 * sum(h >> j & 1 for h in hashes) > len(hashes)) << j for j in range(64))
