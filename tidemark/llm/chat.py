"""Operator 2, chat formatting of preference pairs.

The longest common turn prefix of a chosen and a rejected conversation (turns with equal role and text, in order) is
rendered once as the prompt; what follows in each is its completion, with the character ranges that a loss counts:
the texts of assistant turns and their closing mark. DataFrame expressions only.

Defined results: turns go by their number, ties by role and text; a null role is "user", a null text empty; a turn of
a null conversation belongs to none and is left out; a null turn number comes last; a conversation without its
partner keeps its side, the other is null and the prompt is empty; conversations that are equal, or of which one
continues the other, give empty completions; repeated rows are repeated turns. An empty table gives an empty result.

The turns of a pair are gathered once, into one row, as they must be to be rendered: a pair is bounded by what a row of
Spark holds, 2 GB. Masks are made by blocks of BLOCK turns, so that no list is copied for each turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
BLOCK = 64


def _turn(turn_col: str, role_col: str, text_col: str) -> Column:
    return F.struct(F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _ordered(turns: Column) -> Column:
    """role, text of gathered turns, in order."""
    return F.transform(F.array_sort(turns), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def turns_of(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turns (array of role, text)."""
    slim = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), _turn(turn_col, role_col, text_col).alias("t"))
    return slim.groupBy("conv").agg(F.collect_list("t").alias("ts")).select("conv", _ordered(F.col("ts")).alias("turns"))


def sides_of(conversations: DataFrame, pair: Column, chosen: Column, *, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, chosen, rejected (turns; null for a side without any): each turn goes to its pair in one shuffle. pair:
    the pair of a row, null for none; chosen: whether the row's conversation is the chosen one."""
    slim = conversations.select(pair.alias("pair_id"), chosen.alias("side"), _turn(turn_col, role_col, text_col).alias("t")).where("pair_id IS NOT NULL")
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("t")))
    told = lambda ts: F.when(F.size(ts) > 0, _ordered(ts))
    return slim.groupBy("pair_id").agg(of(True).alias("c"), of(False).alias("r")).select("pair_id", told(F.col("c")).alias("chosen"), told(F.col("r")).alias("rejected"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """start:end of the counted characters of rendered(turns), comma-joined; ends exclusive."""
    head = lambda t: F.lit(len(OPEN) + len(MIDDLE)) + F.length(t["role"])
    size = lambda t: F.length(t["text"]) + F.lit(len(CLOSE))
    span = "array<struct<a:bigint,b:bigint>>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {span})").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        a, b = acc["at"] + head(t), acc["at"] + head(t) + size(t)
        more = F.concat(acc["spans"], F.array(F.struct(a.alias("a"), b.alias("b"))))
        return F.struct(b.alias("at"), F.when(t["role"] == "assistant", more).otherwise(acc["spans"]).alias("spans"))

    count = F.floor((F.size(turns) - 1) / BLOCK).cast("int")
    blocks = F.when(F.size(turns) > 0, F.transform(F.sequence(F.lit(0), count), lambda k: F.aggregate(F.slice(turns, k * BLOCK + 1, F.lit(BLOCK)), begin, step)))
    outer = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{span}>)").alias("parts"))
    moved = lambda acc, x: F.transform(x["spans"], lambda s: F.struct((s["a"] + acc["at"]).alias("a"), (s["b"] + acc["at"]).alias("b")))
    whole = F.aggregate(blocks, outer, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["parts"], F.array(moved(acc, x))).alias("parts")), lambda acc: F.flatten(acc["parts"]))
    text = F.array_join(F.transform(whole, lambda s: F.concat_ws(":", s["a"].cast("string"), s["b"].cast("string"))), ",")
    return F.when(turns.isNotNull(), F.coalesce(text, F.lit("")))


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen and rejected (arrays of role, text; null if missing). Returns pair_id, n_common,
    prompt, chosen, chosen_mask, rejected, rejected_mask."""
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    common = F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), 0).otherwise(F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.least(F.size("chosen"), F.size("rejected"))))
    cut = pairs.select("pair_id", F.col("chosen").alias("c"), F.col("rejected").alias("r"), common.cast("int").alias("same"))
    rest = lambda c: F.slice(c, F.col("same") + 1, F.greatest(F.size(c), F.lit(0)))
    prompt = F.coalesce(rendered(F.slice(F.coalesce("c", "r"), F.lit(1), F.col("same"))), F.lit(""))
    parts = cut.select("pair_id", "same", prompt.alias("prompt"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select("pair_id", F.col("same").cast("long").alias("n_common"), "prompt", rendered(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"), rendered(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are pair k."""
    conv = F.col("conv_id").cast("long")
    return preference_pairs(sides_of(table(spark, sf_dir, "conversations"), F.shiftright(conv, 1), conv % 2 == 0))


OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, 'user'), 'text': coalesce(text, '')} ORDER BY turn NULLS LAST, coalesce(role, 'user'), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sides AS (
  SELECT CAST((conv_id - ((conv_id % 2) + 2) % 2) // 2 AS BIGINT) AS pair_id, any_value(ts) FILTER (WHERE conv_id % 2 = 0) AS c, any_value(ts) FILTER (WHERE conv_id % 2 <> 0) AS r
  FROM turns GROUP BY 1),
cut AS (
  SELECT *, CAST(coalesce(len(list_filter(range(1, least(len(c), len(r)) + 1), lambda k: c[1:k] = r[1:k])), 0) AS BIGINT) AS n_common FROM sides),
rest AS (
  SELECT pair_id, n_common, coalesce(c, r)[1:n_common] AS p, c[n_common + 1 :] AS c, r[n_common + 1 :] AS r FROM cut),
lines AS (
  SELECT pair_id, n_common, [concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) FOR t IN p] AS p,
         [concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) FOR t IN c] AS cl, [concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) FOR t IN r] AS rl, c, r FROM rest)
SELECT pair_id, n_common, array_to_string(p, '') AS prompt, array_to_string(cl, '') AS chosen,
  CASE WHEN c IS NOT NULL THEN array_to_string([concat(coalesce(list_sum([length(x) FOR x IN cl[1 : k - 1]]), 0) + 5 + length(c[k].role), ':', list_sum([length(x) FOR x IN cl[1:k]])) FOR k IN range(1, len(c) + 1) IF c[k].role = 'assistant'], ',') END AS chosen_mask,
  array_to_string(rl, '') AS rejected,
  CASE WHEN r IS NOT NULL THEN array_to_string([concat(coalesce(list_sum([length(x) FOR x IN rl[1 : k - 1]]), 0) + 5 + length(r[k].role), ':', list_sum([length(x) FOR x IN rl[1:k]])) FOR k IN range(1, len(r) + 1) IF r[k].role = 'assistant'], ',') END AS rejected_mask
FROM lines
"""
