"""Dropping segments until a session fits its budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import KEY, by_session


def drop_ladder(segments: DataFrame, target) -> DataFrame:
    """(session_id, seg_index, tokens, rung): 1 reasoning stripped, 2 tool pairs, 3 oldest turns.

    segments: the columns of segment_table, salient, and shed (tokens of reasoning in an eligible
    assistant turn, else null). Rung 1 takes every eligible turn when over the target; rungs 2 and 3
    drop the oldest while the running total is above it. The last segment, the system's and the
    tools' are never dropped. All rungs are windows over the session: one shuffle, no join.
    """
    whole = Window.partitionBy(KEY)
    before = by_session("seg_index").rowsBetween(Window.unboundedPreceding, -1)
    tokens, goal = F.col("token_estimate"), F.col("_target")

    def sum_before(rows):
        return F.coalesce(F.sum(F.when(rows, tokens)).over(before), F.lit(0))

    s = segments.withColumn("_target", target)
    s = s.withColumn("_total", F.sum(tokens).over(whole))
    s = s.withColumn("_first", F.col("shed").isNotNull() & (F.col("_total") > goal))
    s = s.withColumn("_left", F.col("_total") - F.coalesce(F.sum(F.when(F.col("_first"), F.greatest("shed", F.lit(0)))).over(whole), F.lit(0)))
    pair = (F.col("kind") == "tool_pair") & ~F.col("pinned") & ~F.col("salient")
    s = s.withColumn("_second", pair & (F.col("_left") - sum_before(pair) > goal))
    s = s.withColumn("_left", F.col("_left") - F.coalesce(F.sum(F.when(F.col("_second"), tokens)).over(whole), F.lit(0)))
    rest = ~F.col("_second") & ~F.col("kind").isin("system", "tools") & ~F.col("is_current")
    s = s.withColumn("_third", rest & (F.col("_left") - sum_before(rest) > goal))
    taken = [F.when(F.col(c), F.struct(n.cast("long").alias("tokens"), F.lit(k).alias("rung"))) for k, (c, n) in enumerate((("_first", F.col("shed")), ("_second", tokens), ("_third", tokens)), 1)]
    return s.select(KEY, "seg_index", F.explode(F.array_compact(F.array(*taken))).alias("d")).select(KEY, "seg_index", "d.tokens", "d.rung")
