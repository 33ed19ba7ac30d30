"""Operator 5, language identification by Bayesian evidence fusion.

Evidence of a row: its text (hashed byte trigrams under a multinomial model, tempered because trigrams overlap), the
language its markup declares, its address's suffix, and a prior of its host, smoothed towards its domain, that
towards its suffix, that towards all rows. The trigram model comes from all rows that declare one of the languages;
the priors from the grouped counts of what the text alone says. Beside the languages stands "und", under which all
trigrams are alike: texts of no known language fall to it.

Texts are read twice: for the model, and to be scored; what the text says is written beside the row then, and all
that follows joins numbers. A hot host's rows are not joined in one task.

Defined results: a null or letterless text has no text evidence; missing host, declaration or suffix are no evidence
(null hosts share one prior); ties go to the language first in the list; repeated rows count each; without any
declared row the text says nothing and the priors are even. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, join_by_key, materialize, ready, sliced, table

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 8192
TEMPER = 0.25
#: Rows that a parent's prior weighs as.
KAPPA = 20.0
DECLARED_RIGHT, SUFFIX_RIGHT, LEAST_PROB = 0.85, 0.6, 0.5

# Country suffixes and the language mostly written under them.
SUFFIX_LANGUAGE = {"at": "de", "ch": "de", "de": "de", "au": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en", "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es", "pe": "es", "fr": "fr"}

MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", re.S | re.I)
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)


def trigrams(text: str | None, markup: bool = False) -> np.ndarray:
    """Buckets of the byte trigrams of the letters of a text, runs of other characters as one blank."""
    if not text:
        return np.empty(0, np.int64)
    letters = b" ".join((MARKUP.sub(" ", text) if markup else text).encode().translate(_LETTERS).split())
    if not letters:
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + letters + b" ", np.uint8).astype(np.uint32)
    mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(32 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def train(rows: DataFrame, languages: tuple[str, ...], markup: bool) -> np.ndarray:
    """Log probabilities [bucket, language and und], from all rows' counts; at most BUCKETS x languages sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in sliced(batches):
            for text, declared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if declared in languages:
                    sums[languages.index(declared)] += np.bincount(trigrams(text, markup), minlength=BUCKETS)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[lang, bucket])], ["lang", "bucket", "n"])

    found = rows.where("text IS NOT NULL AND declared IS NOT NULL").select("text", "declared").mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for r in found:
        counts[r["bucket"], r["lang"]] += r["n"]
    known = np.log(counts / counts.sum(axis=0))
    return np.column_stack((known, np.full(BUCKETS, -np.log(BUCKETS))))


def identify(docs: DataFrame, *, text: str | Column = "text", declared: str | Column = "lang", host: str | Column = "source", markup: bool = False, languages: tuple[str, ...] = LANGUAGES, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs' rows (of the columns in keep; all without it) as a struct row_, with lang_ (a language, or und), prob_ and
    accepted_ (a language, of LEAST_PROB at least). host: an address's host name; its last part is the suffix, its last
    two parts the domain."""
    spark = docs.sparkSession
    ready(spark)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    name = F.lower(F.coalesce(col(host).cast("string"), F.lit("")))
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct("*")
    rows = docs.select(kept.alias("row_"), col(text).cast("string").alias("text"), F.lower(F.substring_index(col(declared).cast("string"), "-", 1)).alias("declared"), name.alias("host"))
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    model = spark.sparkContext.broadcast(train(rows, languages, markup))
    classes = len(languages) + 1

    @F.pandas_udf("array<double>")
    def text_evidence(texts):
        def one(t):
            found = trigrams(t, markup)
            return TEMPER * model.value[found].sum(axis=0) if len(found) else np.zeros(classes)

        return texts.map(one, na_action=None)

    scored = materialize(rows.withColumn("says", text_evidence("text")).drop("text"), "says")
    best = F.when(F.array_max("says") == F.array_min("says"), None).otherwise(F.array_position("says", F.array_max("says")) - 1)
    said = scored.select("host", "domain", "suffix", best.alias("best")).groupBy("host", "domain", "suffix", "best").count()
    hosts = materialize(_priors(materialize(said, "counts"), classes), "priors")
    one_of = lambda right: [[np.log(right if k == d else (1 - right) / (classes - 1)) for k in range(classes)] for d in range(len(languages))]
    as_array = lambda xs: F.array(*(F.lit(float(x)) for x in xs))

    def told(column: str, names: dict[str, str], right: float) -> Column:
        out = as_array([0.0] * classes)
        for d, logs in enumerate(one_of(right)):
            of = [n for n, lang in names.items() if lang == languages[d]]
            if of:
                out = F.when(F.col(column).isin(of), as_array(logs)).otherwise(out)
        return out

    even = as_array([-np.log(classes)] * classes)
    joined = join_by_key(scored, hosts, "host", "rows")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(add("says", F.coalesce("prior", even)), add(told("declared", {x: x for x in languages}, DECLARED_RIGHT), told("suffix", SUFFIX_LANGUAGE, SUFFIX_RIGHT)))
    fused = joined.select("row_", total.alias("total"))
    top = F.array_max("total")
    prob = F.lit(1.0) / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("total")))
    lang = F.element_at(F.array(*(F.lit(x) for x in (*languages, "und"))), F.array_position("total", top).cast("int"))
    return fused.select("row_", lang.alias("lang_"), prob.alias("prob_")).withColumn("accepted_", (F.col("lang_") != "und") & (F.col("prob_") >= LEAST_PROB))


def _priors(said: DataFrame, classes: int) -> DataFrame:
    """host, prior (log, by class), rows, each level smoothed towards the one above."""
    wide = said.groupBy("host", "domain", "suffix").agg(*(F.sum(F.when(F.col("best") == k, F.col("count")).otherwise(0)).alias(f"c{k}") for k in range(classes)), F.sum("count").alias("rows"))
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in range(classes)]
    every = wide.agg(*sums).first()
    counts = [float(x or 0) for x in every]
    overall = [(c + 1) / (sum(counts) + classes) for c in counts]

    def smooth(level: DataFrame, key: str, above: list[Column]) -> DataFrame:
        n = sum((F.col(f"c{k}") for k in range(classes)), F.lit(0))
        return level.select("*", *(((F.col(f"c{k}") + KAPPA * above[k]) / (n + KAPPA)).alias(f"{key}_p{k}") for k in range(classes)))

    suffix = smooth(wide.groupBy("suffix").agg(*sums), "suffix", [F.lit(x) for x in overall]).drop(*(f"c{k}" for k in range(classes)))
    domain = wide.groupBy("domain", "suffix").agg(*sums).join(suffix, "suffix")
    domain = smooth(domain, "domain", [F.col(f"suffix_p{k}") for k in range(classes)]).select("domain", *(f"domain_p{k}" for k in range(classes)))
    host = smooth(wide.join(domain, "domain"), "host", [F.col(f"domain_p{k}") for k in range(classes)])
    return host.select("host", "rows", F.array(*(F.log(f"host_p{k}") for k in range(classes))).alias("prior"))


def host_of(url: Column) -> Column:
    """The host name of an address; null if it has none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def markup_language(html: Column) -> Column:
    """The lang attribute of the html element; null if there is none."""
    lang = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    return F.when(lang != "", lang)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "pages"), text="html", declared=markup_language(F.col("html")), host=host_of(F.col("url")), markup=True, keep=("page_id",))
    return found.select("row_.page_id", F.col("lang_").alias("lang"), F.round("prob_", 6).alias("prob"), F.col("accepted_").alias("accepted"))
