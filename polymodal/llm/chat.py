"""Multi-party perspective rotation, in DataFrame operations alone.

Every dialogue is rendered once for each participant: that speaker is the assistant, all others are users under their own names, and the mask covers what the
assistant says. Dialogues are rendered in segments of bounded length, in order, whose texts joined are the dialogue; so a conversation of any length
never meets in one row, and is dealt out by segment. What people write cannot forge a turn: in texts and names ``<|`` becomes ``< |``, and line breaks in names spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers a segment spans; and messages a row holds at most, which matters where many messages share a turn.
TURNS, MESSAGES = 256, 256
#: Roles that speak but are no participants: they are rendered under their own role, and no perspective is theirs.
OTHERS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _head(mine: Column, speaker: Column, others: tuple[str, ...]) -> Column:
    return F.when(mine, F.lit(f"{OPEN}assistant\n")).when(speaker.isin(*others), F.concat(F.lit(OPEN), speaker, F.lit("\n"))).otherwise(F.concat(F.lit(f"{OPEN}user name="), speaker, F.lit("\n")))


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", others: tuple[str, ...] = OTHERS) -> DataFrame:
    """One row per conversation, perspective and segment: conv_id, perspective, segment (from 0), part (from 0), n_messages, text, mask_spans.

    mask_spans is an array of (start, end), characters of this row's text that the assistant says, its closing mark included. Messages are in order of turn
    (null last), then speaker, then text. Segment k holds turns TURNS*k and on, in parts of MESSAGES at most. Messages without a turn come last, in segments -1 to
    -256 by a hash of what they say, so that any number of them is spread. A null speaker is the participant ``unknown``; speakers in ``others`` are no
    participants, and a conversation of theirs alone gives no rows. A null text is an empty message; a null conversation is one conversation. Repeated rows are messages
    each. Very long messages stay whole; other columns are ignored. An empty table gives no rows.
    """
    m = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.translate(_plain(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))), "\n\r", "  ").alias("speaker"), _plain(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("content"),
    )
    late = -1 - F.conv(F.substring(F.md5(F.concat("speaker", F.lit(":"), "content").cast("binary")), 1, 2), 16, 10).cast("long")
    m = m.withColumn("segment", F.coalesce(F.floor(F.col("turn") / TURNS).cast("long"), late))
    # null-safe keys as plain columns: messages are dealt out once, by conversation and segment, and stay there for the window, the
    # grouping and the join; only participants, a few short rows a segment, are dealt out to meet them
    m = m.withColumns({"c": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull()})
    order = Window.partitionBy("c", "none", "segment").orderBy(F.col("turn").asc_nulls_last(), "speaker", "content")
    who = m.where(~F.col("speaker").isin(*others)).select("c", "none", F.col("speaker").alias("perspective")).distinct().join(m.select("c", "none", "segment").distinct(), ["c", "none"])
    place = F.row_number().over(order) - 1
    m = m.withColumn("place", place).withColumn("part", F.floor(F.col("place") / MESSAGES).cast("long"))
    packed = m.groupBy("c", "none", "segment", "part").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("place", "speaker", "content"))).alias("said"))
    each = packed.join(who, ["c", "none", "segment"])
    lines = F.transform("said", lambda x: F.struct(_head(x["speaker"] == F.col("perspective"), x["speaker"], others).alias("head"), F.concat(x["content"], F.lit(CLOSE)).alias("body"), (x["speaker"] == F.col("perspective")).alias("mine")))
    each = each.withColumn("lines", lines)
    text = F.concat_ws("", F.transform("lines", lambda x: F.concat(x["head"], x["body"])))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a, x):
        begin, end = a["at"] + F.length(x["head"]), a["at"] + F.length(x["head"]) + F.length(x["body"])
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["mine"], F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

    return each.select("conv_id", "perspective", "segment", "part", F.size("said").cast("long").alias("n_messages"), text.alias("text"), F.aggregate("lines", start, step, lambda a: a["spans"]).alias("mask_spans"))


ROTATE_SQL = f"""
WITH g AS (
  SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10) || chr(13), '  ') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations
), m AS (
  SELECT *, CAST(coalesce(floor(turn / {TURNS}.0), -1 - CAST('0x' || substr(md5(speaker || ':' || content), 1, 2) AS BIGINT)) AS BIGINT) AS segment FROM g
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn ASC NULLS LAST, speaker, content) - 1 AS place FROM m
), who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
l AS (
  SELECT p.conv_id, w.perspective, segment, place // {MESSAGES} AS part, place, speaker = perspective AS mine,
         '{OPEN}' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head, content || '<|im_end|>' || chr(10) AS body
  FROM p JOIN who w ON p.conv_id IS NOT DISTINCT FROM w.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment, part ORDER BY place) - length(body) AS start FROM l
)
SELECT conv_id, perspective, segment, part, count(*) AS n_messages, string_agg(head || body, '' ORDER BY place) AS text,
       coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ',' ORDER BY place) FILTER (WHERE mine), '') AS mask_spans
FROM o GROUP BY ALL
"""
