"""From decisions to replaced blocks: staged plans, texts and blocks to put in place, and summaries of
what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from .segments import KEY, by_session, recency_protected

DROPPED = "[left out to fit the budget]"


def staged(segments: DataFrame, plan: DataFrame) -> DataFrame:
    """Segments with their staged decision, by content address; equal segments all find it.
    plan: session_id, ref_id and the decision's columns."""
    return segments.join(plan, [KEY, "ref_id"])


def strategy_text(strategy: Column, content: Column, marker: Column, keeps_ref: Column) -> Column:
    """What stands in a segment's place: nothing if kept, a fixed line if dropped, the recoded text
    (with the marker, where its original is stored), else the marker."""
    return (
        F.when(strategy == "keep", F.lit(None).cast("string"))
        .when(strategy == "drop", F.lit(DROPPED))
        .when(strategy == "recode", F.when(keeps_ref, F.concat(content, F.lit("\n"), marker)).otherwise(content))
        .otherwise(marker)
    )


def block_json(slot: Column, text: Column, tool_use_id: Column, is_error: Column) -> Column:
    """The block for a slot: a tool result with its id and error flag, a text block, or for a whole
    string content an array of one text block."""
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), tool_use_id.alias("tool_use_id"), text.alias("content"), F.when(is_error, F.lit(True)).alias("is_error")))
    block = F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))
    return F.when(slot == "tool_result", result).when(slot == "text_block", block).otherwise(F.concat(F.lit("["), block, F.lit("]")))


def merged(base: DataFrame, lane: DataFrame) -> DataFrame:
    """Replacements of the staged plan and of the fast lane; where both want a slot, the plan's.
    Both: session_id, message, block (null for a whole message), json."""
    b = base.select(KEY, "message", "block")
    same = (lane[KEY] == b[KEY]) & (lane["message"] == b["message"]) & lane["block"].eqNullSafe(b["block"])
    return base.unionByName(lane.join(b, same, "left_anti"))


def uncached(source_msgs: Column, floor: Column) -> Column:
    """Whether all messages of a segment are newer than what was last seen, so surely not cached."""
    return (F.size(source_msgs) > 0) & F.forall(source_msgs, lambda m: m >= floor)


def safe_hints(hints: Column, rewritten: Column) -> Column:
    """Hint positions on messages that are rewritten anyway."""
    return F.array_intersect(hints, rewritten)


def tool_names(segments: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, seg_index, tool, tool_use_id) of tool pairs: of the first result, by its use."""
    s = segments.where("kind = 'tool_pair'").select(KEY, "seg_index", F.col("source_msgs")[0].alias("a"), F.col("source_msgs")[1].alias("b"))
    m = messages.select(KEY, "msg_index", "blocks")
    both = s.join(m.withColumnRenamed("msg_index", "a").withColumnRenamed("blocks", "uses"), [KEY, "a"]).join(m.withColumnRenamed("msg_index", "b").withColumnRenamed("blocks", "results"), [KEY, "b"])
    first = F.get(F.filter("results", lambda x: (x["kind"] == "tool_result") & x["id"].isNotNull()), 0)
    both = both.withColumn("tool_use_id", first["id"])
    use = F.get(F.filter("uses", lambda x: (x["kind"] == "tool_use") & (x["id"] == F.col("tool_use_id"))), 0)
    return both.select(KEY, "seg_index", use["name"].alias("tool"), "tool_use_id").where("tool is not null")


def reasoning_shed(segments: DataFrame, messages: DataFrame) -> DataFrame:
    """Add shed to segments: the tokens an assistant turn loses without its reasoning blocks; null where
    it has none, and for the latest assistant turn."""
    thinking = lambda b: b["kind"].isin("thinking", "redacted_thinking")
    m = messages.select(
        KEY, F.col("msg_index").alias("_msg"), F.exists("blocks", thinking).alias("_has"),
        token_estimate(F.array_join(F.transform(F.filter("blocks", lambda b: ~thinking(b)), lambda b: b["raw"]), "")).alias("_rest"),
    )
    turns = segments.where("kind = 'assistant_turn'").withColumn("_nth", F.row_number().over(by_session(F.desc("seg_index")))).where("_nth > 1")
    shed = turns.select(KEY, "seg_index", "token_estimate", F.col("source_msgs")[0].alias("_msg")).join(m.where("_has"), [KEY, "_msg"])
    shed = shed.select(KEY, "seg_index", F.greatest(F.col("token_estimate") - F.col("_rest"), F.lit(0)).cast("long").alias("shed"))
    return segments.join(shed, [KEY, "seg_index"], "left")


def recent_text(segments: DataFrame) -> DataFrame:
    """(session_id, recent): the texts of the protected last segments, in order, a line each."""
    rows = F.array_sort(F.collect_list(F.struct("seg_index", "rendered")))
    return segments.where(recency_protected()).groupBy(KEY).agg(F.array_join(F.transform(rows, lambda r: r["rendered"]), "\n").alias("recent"))


def lane_summary(lane: DataFrame) -> DataFrame:
    """Count, fresh count and bytes saved. lane: fresh, before, after."""
    return lane.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0)).alias("n_fresh"), F.coalesce(F.sum(F.col("before") - F.col("after")), F.lit(0)).cast("long").alias("bytes_saved"))


def forward(body: Column, rewritten: Column, killed: Column, shadow: Column) -> Column:
    """The body that goes out: the original when killed, or in shadow, where plans are only made."""
    return F.when(killed | shadow | rewritten.isNull(), body).otherwise(rewritten)
