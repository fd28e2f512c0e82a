"""Chat formatting by perspective rotation, in DataFrame functions only.

Every speaker of a conversation gets a rendering in which that speaker is the assistant and all others are named
users. A rendering is a table of segments, one per turn, with places in characters: joined in order they are the
dialogue. So neither the text nor the order of a long conversation has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Roles that are no speakers: their turns stand the same in every rendering.
NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """What people say, so that it holds no mark of a segment: "<|" gets a blank inside."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _running(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with `name`, the sum of value over the rows before in their group, and _row, their number.

    rows have _part, the range they lie in, and ranges follow the order. Sums run inside each range first; the sums of
    whole ranges, one row per group and range, are added. No window holds more of a group than a range.
    """
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_value", value).withColumn("_sum", F.coalesce(F.sum("_value").over(before), F.lit(0))).withColumn("_row", F.row_number().over(inside) - 1)
    ranges = rows.groupBy(*group, "_part").agg(F.sum("_value").alias("_s"), F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*group, "_part", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_s"), F.coalesce(F.sum("_c").over(over), F.lit(0)).alias("_c"))
    joined = rows.join(ranges, [*group, "_part"])
    return joined.withColumn(name, (F.col("_sum") + F.col("_s")).cast("long")).withColumn("_row", (F.col("_row") + F.col("_c")).cast("long")).drop("_value", "_sum", "_s", "_c")


def rotate(conversations: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """Segments of every rendering of conversations (conv_id, turn, role, text).

    conv_id, perspective (the speaker who is the assistant), position (from 0), turn, speaker, segment, masked
    (whether the segment is learned from), char_start and char_end of the segment in the rendering, and mask_start
    and mask_end, the part of a masked segment after its header: what the assistant says and its end mark. Texts and
    names are escaped, and line breaks in names become blanks, so that no turn can pass for another one.

    A conversation of n turns and s speakers has n * s segments; its set of speakers is held in one row.

    Defined results: a null role is the speaker "unknown" and a null text is empty; turns go by number, nulls first,
    then by role and text, so repeated rows are turns of their own; a null conv_id is left out; a conversation of narrators only has
    no speaker and no rendering; other columns are ignored; an empty table gives an empty table.
    """
    speaker = F.coalesce(F.col("role"), F.lit("unknown"))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text"), F.col("_tie")]  # the tie lets repeated turns lie in several ranges
    turns = turns.withColumn("_tie", F.monotonically_increasing_id())
    ranged = shared.written(turns.repartitionByRange(F.col("conv_id"), *order).withColumn("_part", F.spark_partition_id()), "chat-turns")
    spoken = ~F.col("speaker").isin(*narrators) if narrators else F.lit(True)
    speakers = turns.groupBy("conv_id").agg(F.collect_set(F.when(spoken, F.col("speaker"))).alias("speakers"), F.count(F.lit(1)).alias("n"))
    rows = shared.join_groups(ranged, shared.written(speakers, "chat-speakers"), ["conv_id"], "n").withColumn("perspective", F.explode("speakers")).drop("speakers")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("assistant")).when(~spoken, F.col("speaker")).otherwise(F.concat(F.lit("user name="), F.translate(escaped(F.col("speaker")), "\r\n", "  ")))
    head = F.concat(F.lit(OPEN), head, F.lit("\n"))
    rows = rows.withColumn("_head", F.length(head).cast("long")).withColumn("segment", F.concat(head, escaped(F.col("text")), F.lit(CLOSE))).withColumn("masked", own)
    rows = _running(rows, ["conv_id", "perspective"], order, F.length("segment").cast("long"), "char_start")
    start, end = F.col("char_start"), F.col("char_start") + F.length("segment")
    return rows.select(
        "conv_id", "perspective", F.col("_row").alias("position"), "turn", "speaker", "segment", "masked", start.alias("char_start"), end.alias("char_end"),
        F.when(F.col("masked"), start + F.col("_head")).alias("mask_start"), F.when(F.col("masked"), end).alias("mask_end"),
    )


def op2_chat_rotation(spark, sf_dir: str) -> DataFrame:
    """rotate() of the whole conversations table; edge cases as defined there."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
     r AS (SELECT t.*, s.perspective, t.speaker = s.perspective AS masked,
                  '<|im_start|>' || CASE WHEN t.speaker = s.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user name=' || translate(replace(t.speaker, '<|', '< |'), chr(13) || chr(10), '  ') END || chr(10) AS head
           FROM t JOIN s USING (conv_id)),
     g AS (SELECT *, head || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS segment FROM r),
     o AS (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS char_end
           FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, speaker, segment, masked, char_end - length(segment) AS char_start, char_end,
       CASE WHEN masked THEN char_end - length(segment) + length(head) END AS mask_start, CASE WHEN masked THEN char_end END AS mask_end
FROM o
"""
