"""Preference formatting: the common prompt of two conversations once, and both completions with their loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.llm.common import table

# Fixed markers of the rendered template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turn numbers that are rendered together before a conversation's pieces are joined.
PIECE = 256


def _turn(turn: Column, role: Column, text: Column) -> Column:
    """A turn with nulls replaced, and without markers of its own: "<|im_" is written "<| im_"."""
    plain = [F.replace(F.coalesce(c, F.lit(d)), F.lit("<|im_"), F.lit("<| im_")) for c, d in ((role, "user"), (text, ""))]
    return F.struct(F.coalesce(turn.cast("long"), F.lit(-1)).alias("turn"), plain[0].alias("role"), plain[1].alias("text"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(f"{CLOSE}\n"))), "")


def _mask(turns: Column) -> Column:
    """Start and end (code points, end exclusive) of what an assistant says, its end marker included."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def preferences(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """turns(pair_id, chosen boolean, turn, role, text) as one row for each pair: pair_id, n_prompt, n_chosen, n_rejected
    (turns), prompt, chosen, rejected (rendered texts), chosen_mask and rejected_mask (start:end of what is trained on).

    A conversation is its rows by turn, role, text; rows that repeat are turns of their own. The prompt is the longest
    prefix that both conversations share, whatever follows in both is rendered in both. The prompt is never trained on; of
    a completion only what the assistant says is. A null turn counts as -1, a null role as user, a null text as empty;
    rows without pair_id or chosen belong to no conversation and are left out. Markers within a text or role are broken by
    a blank. Without a partner, a conversation is one completion beside an empty one. Empty tables give no rows; other
    columns are ignored."""
    rows = turns.where("pair_id is not null and chosen is not null")
    yes = F.col("chosen").cast("boolean")
    each = rows.select(F.col("pair_id").cast("long"), _turn(F.col("turn"), F.col("role"), F.col("text")).alias("t"), yes.cast("long").alias("c"), (~yes).cast("long").alias("r"))
    return paired(each, piece)


def paired(each: DataFrame, piece: int = PIECE) -> DataFrame:
    """preferences() of rows (pair_id, t, c, r): the turn t stands c times in the chosen conversation and r times in the
    rejected one; what several rows say of a turn is added up.

    The prefix comes from an aggregate and a join, so no conversation is sorted as a whole. `piece` turn numbers are
    rendered together, wherever they are; only the rendered pieces of a pair meet in its one row, which is bounded by the
    size of a string."""
    sides = each.groupBy("pair_id", "t").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    forks = sides.where("c <> r").groupBy("pair_id").agg(F.min("t").alias("fork"))
    shared = F.when(F.col("fork").isNull() | (F.col("t") < F.col("fork")), F.col("c")).when(F.col("t") == F.col("fork"), F.least("c", "r")).otherwise(0)
    placed = sides.join(forks, "pair_id", "left").withColumn("p", shared).select("pair_id", F.floor(F.col("t.turn") / piece).alias("piece"), "t", "p", (F.col("c") - F.col("p")).alias("c"), (F.col("r") - F.col("p")).alias("r"))
    parts = {"prompt": "p", "chosen": "c", "rejected": "r"}

    def turns(times: str) -> Column:
        lists = F.sort_array(F.collect_list(F.when(F.col(times) > 0, F.struct("t", F.col(times).cast("int").alias("n")))))
        return F.flatten(F.transform(lists, lambda x: F.array_repeat(x["t"], x["n"])))

    lists = placed.groupBy("pair_id", "piece").agg(*[turns(n).alias(x) for x, n in parts.items()])
    shown = lists.select("pair_id", "piece", *[F.size(x).cast("long").alias(f"n_{x}") for x in parts], *[_rendered(F.col(x)).alias(x) for x in parts], *[_mask(F.col(x)).alias(f"{x}_mask") for x in ("chosen", "rejected")])
    # a piece's spans move by the length of the pieces before it
    before = Window.partitionBy("pair_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    for x in ("chosen", "rejected"):
        shown = shown.withColumn("by", F.coalesce(F.sum(F.length(x)).over(before), F.lit(0)))
        shown = shown.withColumn(f"{x}_mask", F.array_join(F.transform(f"{x}_mask", lambda s: F.concat_ws(":", s["start"] + F.col("by"), s["end"] + F.col("by"))), ","))
    texts = [*parts, "chosen_mask", "rejected_mask"]
    whole = shown.groupBy("pair_id").agg(*[F.sum(f"n_{x}").alias(f"n_{x}") for x in parts], F.sort_array(F.collect_list(F.struct("piece", *texts))).alias("pieces"))

    def joined(x: str) -> Column:
        cells = F.transform("pieces", lambda p: p[x])
        return (F.array_join(F.filter(cells, lambda c: c != ""), ",") if x.endswith("mask") else F.array_join(cells, "")).alias(x)

    return whole.select("pair_id", *[f"n_{x}" for x in parts], *map(joined, texts))


def swapped(conversations: DataFrame) -> DataFrame:
    """The table names no preferences: each conversation is chosen, and rejected with its last assistant turn replaced by
    what the assistant says last in the conversation of the neighbouring number (even with the next odd one); without
    such a turn there, it ends before its own. Rows (pair_id, t, c, r) for paired(); no conversation is joined row by row."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), _turn(F.col("turn"), F.col("role"), F.col("text")).alias("t"))
    one = F.lit(1).cast("long")
    last = rows.where("t.role = 'assistant'").groupBy("pair_id").agg(F.max("t").alias("t"))
    partner = last.select(F.expr("pair_id ^ 1").alias("pair_id"), F.col("t.text").alias("text"))
    new = last.join(partner, "pair_id").select("pair_id", F.struct(F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), F.col("text").alias("text")).alias("t"))
    return rows.select("pair_id", "t", one.alias("c"), one.alias("r")).union(last.select("pair_id", "t", one - 1, -one)).union(new.select("pair_id", "t", one - 1, one))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(swapped(table(spark, sf_dir, "conversations")))


def _spans(part: str) -> str:
    span = f"CAST(CAST(stop - length(text) - {len(CLOSE)} - 1 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop - 1 AS BIGINT) AS VARCHAR)"
    return f"coalesce(string_agg({span}, ',' ORDER BY turn, role, text, copy) FILTER (part = '{part}' AND role = 'assistant'), '') AS {part}_mask"


ORACLE = f"""
WITH t AS (
  SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, replace(coalesce(role, 'user'), '<|im_', '<| im_') AS role,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT pair_id, turn, role, text FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) = 1
), e AS (
  SELECT *, 1 AS c, 1 AS r FROM t
  UNION ALL SELECT *, 0, -1 FROM l
  UNION ALL SELECT a.pair_id, a.turn, a.role, b.text, 0, 1 FROM l a JOIN l b ON b.pair_id = xor(a.pair_id, 1)
), s AS (
  SELECT pair_id, turn, role, text, sum(c) AS c, sum(r) AS r FROM e GROUP BY pair_id, turn, role, text
), p AS (
  SELECT *, sum(CASE WHEN c <> r THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS forks FROM s
), q AS (
  SELECT *, CASE WHEN forks = 0 THEN c WHEN forks = 1 AND c <> r THEN least(c, r) ELSE 0 END AS p FROM p
), x AS (
  SELECT pair_id, turn, role, text, 'prompt' AS part, unnest(range(CAST(p AS BIGINT))) AS copy FROM q
  UNION ALL SELECT pair_id, turn, role, text, 'chosen', unnest(range(CAST(c - p AS BIGINT))) FROM q
  UNION ALL SELECT pair_id, turn, role, text, 'rejected', unnest(range(CAST(r - p AS BIGINT))) FROM q
), y AS (
  SELECT *, '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS shown FROM x
), z AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text, copy) AS stop FROM y
)
SELECT pair_id,
  count(*) FILTER (part = 'prompt') AS n_prompt, count(*) FILTER (part = 'chosen') AS n_chosen, count(*) FILTER (part = 'rejected') AS n_rejected,
  coalesce(string_agg(shown, '' ORDER BY turn, role, text, copy) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY turn, role, text, copy) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY turn, role, text, copy) FILTER (part = 'rejected'), '') AS rejected,
  {_spans("chosen")},
  {_spans("rejected")}
FROM z GROUP BY pair_id
"""
