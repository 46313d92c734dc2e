"""Preference formatting (operator 9).

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns is rendered once, as the prompt; what follows it in either is rendered as
a completion, with the character ranges that a loss may see: the text and end
mark of assistant turns, never the headers or the other roles.

Only DataFrame and SQL functions are used. One shuffle brings the turns of a
pair together; a pair is one output row, so its turns are one task's work
anyway.

Defined cases: turns sort by number, nulls first, ties by role and text; a null
role counts as user, a null text as empty; a null pair id is a pair of its own;
a side without turns gives an empty completion; identical sides give a prompt
and two empty completions; very long texts are rendered whole; an empty table
gives no pair; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "<|end|>\n"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))), "")


def _trained(turns: Column) -> Column:
    """Ranges [start, end) of assistant text and end mark in the rendered turns."""

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"])
        mark = F.struct(start.alias("start"), (end + len(END) - 1).alias("end"))
        return F.struct((end + len(END)).alias("at"), F.when(t["role"] == "assistant", F.array_append(s["spans"], mark)).otherwise(s["spans"]).alias("spans"))

    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    empty = F.coalesce(none, F.array().cast("array<struct<start:int,end:int>>"))
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans and
    rejected_spans from two sides of rows (pair_id, turn, role, text)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("pair_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(name).alias("side"))

    both = side(chosen, "c").unionByName(side(rejected, "r"))
    turn = F.struct("turn", "role", "text")
    pairs = both.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("c", "r")])
    same = F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    # The first turn that differs, or that one side lacks (null: neither side ends first).
    shorter = F.least(F.size("c"), F.size("r"))
    differs = F.array_position(F.slice(same, F.lit(1), shorter), False).cast("int")
    pairs = pairs.withColumn("n_prompt_turns", F.when(differs > 0, differs - 1).otherwise(shorter))

    def rest(c: str) -> Column:
        return F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))

    return pairs.select(
        "pair_id", "n_prompt_turns",
        _rendered(F.slice("c", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        _rendered(rest("c")).alias("chosen"), _rendered(rest("r")).alias("rejected"),
        _trained(rest("c")).alias("chosen_spans"), _trained(rest("r")).alias("rejected_spans"),
    )


def reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides for every conversation with an assistant turn:
    it up to its last such turn, and the same with that turn's text taken from
    the neighbour whose id differs in the last bit (empty where there is none).

    Null turns come first; of several assistant rows with the last turn's number
    the largest text is the reply, and all of them are replaced. A null id is a
    conversation like any other, without a neighbour."""
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    nth = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    last = turns.filter("role = 'assistant'").groupBy("pair_id").agg(F.max_by("text", F.struct(nth, "text")).alias("__reply"), F.max(nth).alias("__last"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("__reply").alias("__other"))
    ends = last.join(other, "pair_id", "left").select(F.col("pair_id").alias("__pair"), "__last", "__other")
    upto = turns.join(ends, turns["pair_id"].eqNullSafe(ends["__pair"])).filter(nth <= F.col("__last"))
    chosen = upto.select("pair_id", "turn", "role", "text")
    own = nth.eqNullSafe(F.col("__last")) & (F.col("role") == "assistant")
    rejected = upto.select("pair_id", "turn", "role", F.when(own, F.coalesce("__other", F.lit(""))).otherwise(F.col("text")).alias("text"))
    return chosen, rejected


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), "|")


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_pairs(*reply_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", _joined("chosen_spans").alias("chosen_trained"), _joined("rejected_spans").alias("rejected_trained"))


OP9_SQL = r"""
WITH last AS (
  SELECT conv_id, max(turn) AS a, max_by(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), ends AS (
  SELECT l.conv_id, l.a, coalesce(o.reply, '') AS other
  FROM last l LEFT JOIN last o ON o.conv_id = xor(l.conv_id, 1)
), turns AS (
  SELECT c.conv_id, c.turn, c.role, coalesce(c.text, '') AS x,
         CASE WHEN c.turn = e.a AND c.role = 'assistant' THEN e.other ELSE coalesce(c.text, '') END AS y,
         row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS n
  FROM conversations c JOIN ends e ON c.conv_id = e.conv_id WHERE c.turn <= e.a
), cut AS (
  SELECT conv_id, coalesce(min(CASE WHEN x <> y THEN n END) - 1, max(n)) AS p FROM turns GROUP BY conv_id
), parts AS (
  SELECT t.*, p,
         '<|' || role || '|>' || chr(10) || x || '<|end|>' || chr(10) AS rx,
         '<|' || role || '|>' || chr(10) || y || '<|end|>' || chr(10) AS ry
  FROM turns t JOIN cut USING (conv_id)
), placed AS (
  SELECT *,
         coalesce(sum(CASE WHEN n > p THEN length(rx) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS sx,
         coalesce(sum(CASE WHEN n > p THEN length(ry) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS sy
  FROM parts
)
SELECT conv_id AS pair_id, CAST(max(p) AS INT) AS n_prompt_turns,
       coalesce(string_agg(rx, '' ORDER BY n) FILTER (n <= p), '') AS prompt,
       coalesce(string_agg(rx, '' ORDER BY n) FILTER (n > p), '') AS chosen,
       coalesce(string_agg(ry, '' ORDER BY n) FILTER (n > p), '') AS rejected,
       coalesce(string_agg(CAST(sx AS VARCHAR) || '-' || CAST(sx + length(x) + 7 AS VARCHAR), '|' ORDER BY n) FILTER (n > p AND role = 'assistant'), '') AS chosen_trained,
       coalesce(string_agg(CAST(sy AS VARCHAR) || '-' || CAST(sy + length(y) + 7 AS VARCHAR), '|' ORDER BY n) FILTER (n > p AND role = 'assistant'), '') AS rejected_trained
FROM placed GROUP BY conv_id
"""
