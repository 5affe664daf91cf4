"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the
assistant and all others as named users; only the assistant's turns are trained on.  A rendering is kept
as one row per (conversation, perspective, turn): its text segment, the segment's place in the rendered
dialogue, and its mask.  Nothing gathers a conversation into one row or task, so it may be of any length:
turns are range-sorted into blocks of bounded size (ties are cut, too), and offsets are summed within
blocks first, then over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, partitions_for

#: Turn numbers to a block, and turns to a range: what has one number is cut there.
BLOCK, RANGE = 256, 20_000
NOBODY = "unknown"


def _head(name: Column, own: Column) -> Column:
    return F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user|>"), name, F.lit("\n")))


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, perspective and turn.

    conv_id, perspective, turn, position (from 0), speaker, chat_role (assistant or user), segment,
    seg_start and seg_end (characters in the perspective's dialogue), target_start and target_end (the
    trained characters, end mark included; null where masked), trained.

    A null or blank role is the participant "unknown"; a null text is empty.  Turns are ordered by turn
    (null first), then role, then text; equal rows are turns of their own.  Rows with a null conv_id are
    one conversation.  Other columns are not read.  An empty table gives an empty result.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(F.coalesce(F.trim(F.col(role_col)), F.lit("")) == "", F.lit(NOBODY)).otherwise(F.col(role_col)).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
        F.monotonically_increasing_id().alias("tie"),
    )
    workspace = Workspace(turns.sparkSession, "chat")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "speaker", "body", "tie"]
    ranged = rows.repartitionByRange(partitions_for(turns.sparkSession, rows.count(), RANGE), *order).withColumn("block", F.struct(F.spark_partition_id().alias("range"), F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK).alias("part")))
    rows = workspace.stage(ranged, "turns")  # written, so that blocks and ties stay as they are
    people = rows.select(F.col("conv_id").alias("people_of"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    rotated = (
        rows.join(people, F.col("conv_id").eqNullSafe(F.col("people_of")))
        .select("conv_id", "perspective", "turn", "block", "tie", "speaker", "body", own.alias("trained"), _head(F.col("speaker"), own).alias("head"))
        .withColumn("segment", F.concat("head", "body", F.lit("<|end|>\n")))
        .withColumn("chars", F.length("segment").cast("long"))
    )
    # Names of the table of blocks differ from the rows', so the join below is plain.
    sums = rotated.groupBy("conv_id", "perspective", "block").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nought = F.lit(0).cast("long")
    sums = sums.select(F.col("conv_id").alias("sum_of"), F.col("perspective").alias("sum_by"), F.col("block").alias("sum_block"), F.coalesce(F.sum("n").over(before), nought).alias("turns_before"), F.coalesce(F.sum("c").over(before), nought).alias("chars_before"))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "body", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rotated.withColumn("k", F.count("*").over(within))
        .withColumn("start_in_block", F.coalesce(F.sum("chars").over(within), nought))
        .join(sums, F.col("conv_id").eqNullSafe(F.col("sum_of")) & (F.col("perspective") == F.col("sum_by")) & (F.col("block") == F.col("sum_block")))
        .withColumn("seg_start", F.col("chars_before") + F.col("start_in_block"))
        .withColumn("seg_end", F.col("seg_start") + F.col("chars"))
    )
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        (F.col("turns_before") + F.col("k")).alias("position"),
        "speaker",
        F.when(F.col("trained"), F.lit("assistant")).otherwise(F.lit("user")).alias("chat_role"),
        "segment",
        "seg_start",
        "seg_end",
        F.when(F.col("trained"), F.col("seg_start") + F.length("head")).alias("target_start"),
        F.when(F.col("trained"), F.col("seg_end")).alias("target_end"),
        "trained",
    )


ORACLE = r"""
with t as (select conv_id, turn, case when trim(coalesce(role, '')) = '' then 'unknown' else role end as speaker, coalesce(text, '') as body from conversations),
p as (select distinct conv_id, speaker as perspective from t),
r as (select t.*, perspective, speaker = perspective as trained,
  case when speaker = perspective then '<|assistant|>' || chr(10) else '<|user|>' || speaker || chr(10) end as head
  from t join p on t.conv_id is not distinct from p.conv_id),
s as (select *, head || body || '<|end|>' || chr(10) as segment from r),
o as (select *, row_number() over w - 1 as position, cast(sum(length(segment)) over w as bigint) as seg_end from s
  window w as (partition by conv_id, perspective order by turn nulls first, speaker, body rows between unbounded preceding and current row))
select conv_id, perspective, turn, cast(position as bigint) as position, speaker, case when trained then 'assistant' else 'user' end as chat_role, segment,
  seg_end - length(segment) as seg_start, seg_end,
  case when trained then seg_end - length(segment) + length(head) end as target_start, case when trained then seg_end end as target_end, trained
from o
"""
