"""Operator 7: preference formatting of chosen and rejected conversations.

Turns stay rows: two conversations of a pair are compared turn by turn, the first turn in which they differ ends the
common prefix, and offsets are sums over blocks of turns. So a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultline.llm.common import table

#: Turns of a block; offsets are summed within blocks, then over blocks.
BLOCK = 256

# The rendering: header, text, end.
HEAD, END = ("<|", "|>\n"), "<|end|>\n"
LEARNED = "assistant"


def _turns(df: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """Plain names; rows without a pair id go, repeated rows count once, turns of the same number get an order."""
    rows = df.filter(F.col(f"`{pair}`").isNotNull()).select(
        F.col(f"`{pair}`").alias("pair"),
        F.coalesce(F.col(f"`{turn}`").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("pair", "turn").orderBy("role", "text")
    return rows.distinct().withColumn("nth", F.row_number().over(order))


def _offsets(rows: DataFrame, length: Column) -> DataFrame:
    """`rows` with `start`: the sum of the lengths before it in its pair and part."""
    rows = rows.withColumns({"length": length, "block": F.floor(F.col("turn") / BLOCK)})
    within = Window.partitionBy("pair", "part", "block").orderBy("turn", "nth")
    blocks = rows.groupBy("pair", "part", "block").agg(F.sum("length").alias("size"))
    over = Window.partitionBy("pair", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("size").over(over), F.lit(0))).drop("size")
    inside = F.sum("length").over(within) - F.col("length")
    return rows.withColumn("inside", inside).join(before, ["pair", "part", "block"]).withColumn(
        "start", F.col("inside") + F.col("before")
    )


def format_pairs(
    chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per rendered turn: pair, part, turn, nth, role, rendered, start, length, learn_from.

    Part "prompt" holds the longest common prefix of turns, once; "chosen" and "rejected" hold what follows on either
    side. `start` is the offset in code points within the part. `learn_from` is the offset within the turn from which a
    model learns; it is null, that is masked, in the prompt and for turns that are not the assistant's.

    Pairs that one side lacks have an empty prefix. Equal conversations are all prompt. Null roles are "unknown", null
    texts empty, null turns come first, rows without a pair id are left out, repeated rows count once; several messages
    of one turn are ordered by role and text. Other columns are ignored; empty tables give no rows.
    """
    sides = [
        _turns(df, pair, turn, role, text).withColumn("side", F.lit(name))
        for df, name in ((chosen, "chosen"), (rejected, "rejected"))
    ]
    both = sides[0].unionByName(sides[1])
    same = (F.count(F.lit(1)) == 2) & (F.min("role") == F.max("role")) & (F.min("text") == F.max("text"))
    places = both.groupBy("pair", "turn", "nth").agg(same.alias("same"))
    ends = places.groupBy("pair").agg(
        F.min(F.when(~F.col("same"), F.struct("turn", "nth"))).alias("first")
    )
    split = both.join(ends, "pair")
    common = F.col("first").isNull() | (F.struct("turn", "nth") < F.col("first"))
    parts = split.withColumn("part", F.when(common, "prompt").otherwise(F.col("side")))
    # The prefix is the same on both sides; it is rendered from the chosen one.
    once = parts.filter((F.col("part") != "prompt") | (F.col("side") == "chosen"))
    head = F.concat(F.lit(HEAD[0]), F.col("role"), F.lit(HEAD[1]))
    rendered = once.withColumn("rendered", F.concat(head, F.col("text"), F.lit(END)))
    placed = _offsets(rendered, F.char_length("rendered").cast("long"))
    learned = (F.col("part") != "prompt") & (F.col("role") == LEARNED)
    return placed.select(
        F.col("pair").alias(pair), "part", "turn", "nth", "role", "rendered", "start", "length",
        F.when(learned, F.char_length(head).cast("long")).alias("learn_from"),
    )


def reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns made from single conversations.

    Chosen is a conversation up to its last reply of the assistant. Rejected is the same with the last reply of the
    neighbouring conversation (2k and 2k + 1) in its place, or without it if the neighbour has none. Conversations
    without a reply make no pair.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    replies = turns.filter(F.col("role") == LEARNED).groupBy("conv_id").agg(
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("reply")
    )
    other = F.col("conv_id") + 1 - 2 * F.pmod(F.col("conv_id"), F.lit(2))
    ends = replies.select("conv_id", F.col("reply.turn").alias("end"), other.alias("other"))
    chosen = turns.join(ends, "conv_id").filter(F.col("turn") <= F.col("end")).select("conv_id", "turn", "role", "text")
    before = turns.join(ends, "conv_id").filter(F.col("turn") < F.col("end")).select("conv_id", "turn", "role", "text")
    swapped = ends.join(replies.select(F.col("conv_id").alias("other"), "reply"), "other").select(
        "conv_id", F.col("end").alias("turn"), F.lit(LEARNED).alias("role"), F.col("reply.text").alias("text")
    )
    return chosen, before.unionByName(swapped)


def op7_chat_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = format_pairs(*reply_pairs(table(spark, folder, "conversations")), pair="conv_id")
    return pairs.select(
        "conv_id", "part", "turn", F.col("nth").cast("long").alias("nth"), "role", "start", "length", "learn_from",
        F.sha2("rendered", 256).alias("rendered_sha256"),
    )


SQL = """
WITH c AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
ends AS (SELECT conv_id, max(turn) AS last FROM c WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT conv_id, last, max(text) AS text FROM ends JOIN c USING (conv_id)
          WHERE turn = last AND role = 'assistant' GROUP BY conv_id, last),
sides AS (
  SELECT 'chosen' AS side, conv_id, turn, role, text FROM c JOIN ends USING (conv_id) WHERE turn <= last
  UNION ALL SELECT 'rejected', conv_id, turn, role, text FROM c JOIN ends USING (conv_id) WHERE turn < last
  UNION ALL SELECT 'rejected', e.conv_id, e.last, 'assistant', r.text FROM ends e
    JOIN reply r ON r.conv_id = CASE WHEN e.conv_id % 2 = 0 THEN e.conv_id + 1 ELSE e.conv_id - 1 END),
n AS (SELECT *, row_number() OVER (PARTITION BY side, conv_id, turn ORDER BY role, text) AS nth
      FROM (SELECT DISTINCT * FROM sides)),
place AS (SELECT conv_id, turn, nth, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
          FROM n GROUP BY conv_id, turn, nth),
split AS (SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM place p WHERE p.conv_id = n.conv_id AND NOT same
            AND (p.turn < n.turn OR p.turn = n.turn AND p.nth <= n.nth)) THEN side ELSE 'prompt' END AS part FROM n),
r AS (SELECT conv_id, part, turn, nth, role, '<|' || role || '|>' || chr(10) AS head, text
      FROM split WHERE part <> 'prompt' OR side = 'chosen'),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM r)
SELECT conv_id, part, turn, nth::BIGINT AS nth, role,
       coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, part ORDER BY turn, nth
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       length(rendered)::BIGINT AS length,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head)::BIGINT END AS learn_from,
       sha256(rendered) AS rendered_sha256
FROM s
"""
