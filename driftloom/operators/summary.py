"""Compaction requests answered from what is known of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_line, join_or_none
from .segments import KEY, by_session

MARKER = "Write the compaction summary now"
MOST_TOKENS, RECAP = 20_000, 6


def is_compaction(body: Column, max_tokens: Column, has_tool_choice: Column, last_user: Column, marker: str = MARKER) -> Column:
    """The marker twice in the body and in the last user message, few tokens allowed, no tool chosen."""
    twice = F.regexp_count(body, F.lit(r"\Q" + marker + r"\E")) == 2
    return body.contains(marker) & twice & (max_tokens <= MOST_TOKENS) & ~has_tool_choice & F.coalesce(last_user.contains(marker), F.lit(False))


def recap_turns(messages: DataFrame, most: int = RECAP) -> DataFrame:
    """(session_id, recap): texts of the last user turns but the final one, oldest first."""
    user = messages.where((F.col("role") == "user") & (F.col("rendered") != ""))
    nth = user.withColumn("_nth", F.row_number().over(by_session(F.desc("msg_index")))).where(F.col("_nth").between(2, most + 1))
    rows = F.array_sort(F.collect_list(F.struct("msg_index", "rendered")))
    return nth.groupBy(KEY).agg(F.transform(rows, lambda r: r["rendered"]).alias("recap"))


def live(items: Column) -> Column:
    return F.filter(items, lambda x: x["superseded_by"].isNull())


def summary(constraints: Column, decisions: Column, in_flight: Column, recap: Column) -> Column:
    """Four sections: live constraints as they are, live decisions with their state, what is in flight,
    and the story so far, told by the first lines of the recap."""
    rules = F.transform(live(constraints), lambda c: F.concat(F.lit("- "), c["text"]))
    made = F.transform(live(decisions), lambda d: F.concat(F.lit("- "), d["text"], F.when(d["planned"], F.lit(" (planned)")).otherwise(F.lit(" (done)")), F.lit(": "), d["rationale"]))
    story = F.transform(recap, lambda r: F.concat(F.lit("- "), first_line(r)))
    return F.concat_ws(
        "\n", F.lit("## Constraints"), join_or_none(rules, "\n"), F.lit("## Decisions"), join_or_none(made, "\n"), F.lit("## In flight"), join_or_none(F.transform(in_flight, lambda f: F.concat(F.lit("- "), f)), "\n"), F.lit("## So far"), join_or_none(story, "\n"),
    )


def salience_tags(source_msgs: Column, live_sources: Column) -> Column:
    return F.when(F.arrays_overlap(source_msgs, live_sources), F.array(F.lit("[CONSTRAINT]"))).otherwise(F.array().cast("array<string>"))
