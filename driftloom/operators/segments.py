"""Messages to segments, and what is computed over the segments of a session.

A session is ordered by one window; sessions are the partitioning key of everything here, so the
windows of one plan share a single shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_chars, byte_length, token_estimate

RECENT = 3
LOOKBACK = 20
MOST_HINTS = 4
HUGE_PASTE_CHARS = 16_384
KEY = "session_id"


def by_session(*order) -> Window:
    return Window.partitionBy(KEY).orderBy(*order)


def session_messages(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as messages whose content is a string. The raw span of a string is its
    bytes and two quotes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    return conversations.select(
        F.col("conv_id").alias(KEY),
        F.col("turn").cast("long").alias("msg_index"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.lit("string").alias("content_kind"),
        text.alias("rendered"),
        (byte_length(text) + 2).alias("raw_len"),
        none.alias("use_ids"),
        none.alias("result_ids"),
    )


def segment_table(messages: DataFrame, estimate: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """One row for each segment of a session. estimate: the tokens of a text, as a column function.

    messages: session_id, msg_index, role, content_kind, rendered, raw_len, use_ids, result_ids. An
    assistant message whose tool uses are answered by the next user message makes one tool_pair with
    it; every other message is a segment of its own. Rows of role "tools" or "prefix" (indexes below
    0) are the tool list and the system prompt.
    """
    w = by_session("msg_index")
    following = {c: F.lead(c).over(w) for c in ("role", "result_ids", "rendered", "raw_len", "msg_index")}
    pairs = (F.col("role") == "assistant") & (F.col("next_role") == "user") & F.coalesce(F.arrays_overlap("use_ids", "next_result_ids"), F.lit(False))
    m = messages.withColumns({f"next_{c}": x for c, x in following.items()})
    m = m.withColumn("paired", F.coalesce(pairs, F.lit(False)))
    m = m.withColumn("consumed", F.coalesce(F.lag("paired").over(w), F.lit(False))).where("not consumed")
    kind = (
        F.when(F.col("paired"), "tool_pair").when(F.col("role") == "assistant", "assistant_turn").when(F.col("role") == "user", "user_turn").when(F.col("role") == "tools", "tools").otherwise("system")
    )
    m = m.withColumns(
        {
            "kind": kind,
            "rendered": F.when(F.col("paired"), F.concat("rendered", "next_rendered")).otherwise(F.col("rendered")),
            "raw_len": F.when(F.col("paired"), F.col("raw_len") + F.col("next_raw_len")).otherwise(F.col("raw_len")),
            "source_msgs": F.when(F.col("msg_index") < 0, F.expr("cast(array() as array<bigint>)")).when(F.col("paired"), F.array("msg_index", "next_msg_index")).otherwise(F.array("msg_index")),
            "open_use": ~F.col("paired") & (F.col("role") == "assistant") & (F.size("use_ids") > 0),
        }
    )
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = m.withColumn("token_estimate", estimate(F.col("rendered")))
    m = m.withColumns(
        {
            "seg_index": (F.row_number().over(w) - 1).cast("long"),
            "n_segments": F.count(F.lit(1)).over(whole),
            "byte_offset": F.coalesce(F.sum("raw_len").over(before), F.lit(0)).cast("long"),
            "generation": F.sum((F.col("kind") == "user_turn").cast("long")).over(so_far),
            "suffix_tokens": F.coalesce(F.sum("token_estimate").over(after), F.lit(0)).cast("long"),
            "prefix_tokens": F.sum("token_estimate").over(so_far).cast("long"),
        }
    )
    m = m.withColumn("newest", F.max("generation").over(whole))
    last = F.col("seg_index") == F.col("n_segments") - 1
    return m.select(
        KEY, "seg_index", "kind", "rendered", "raw_len", "byte_offset", "token_estimate", "generation", (F.col("open_use") | last).alias("pinned"), last.alias("is_current"),
        ((F.col("role") == "user") & (F.col("content_kind") == "string") & (F.col("kind") == "user_turn")).alias("is_true_human"), "source_msgs", "n_segments", "suffix_tokens", "prefix_tokens", (F.col("newest") - F.col("generation")).alias("gap"),
    )


def recency_protected(recent: int = RECENT) -> Column:
    return F.col("seg_index") >= F.greatest(F.col("n_segments") - recent, F.lit(0))


def huge_paste() -> Column:
    return F.col("is_true_human") & (F.col("kind") == "user_turn") & (approx_chars(F.col("token_estimate")) > HUGE_PASTE_CHARS)


def with_salience(segments: DataFrame, constraints: DataFrame | None = None) -> DataFrame:
    """Add salient: a typed human turn, or one that a live constraint was taken from.

    constraints: session_id, source_message, superseded_by; live while the last is null.
    """
    human = (F.col("kind") == "user_turn") & F.col("is_true_human")
    if constraints is None:
        return segments.withColumn("salient", human)
    live = constraints.where("superseded_by is null").groupBy(KEY).agg(F.collect_set(F.col("source_message").cast("long")).alias("_sources"))
    joined = segments.join(live, KEY, "left")
    return joined.withColumn("salient", human | F.coalesce(F.arrays_overlap("source_msgs", "_sources"), F.lit(False))).drop("_sources")


def squash_candidate() -> Column:
    return ~F.col("salient") | huge_paste()


def prune_candidate() -> Column:
    return ~F.col("pinned") & ~recency_protected()


def fresh_boundary(segments: DataFrame) -> DataFrame:
    """(session_id, boundary): the second newest generation, the only one if there is one."""
    ranked = segments.select(KEY, "generation").distinct().withColumn("rank", F.dense_rank().over(by_session(F.desc("generation"))))
    return ranked.where("rank <= 2").groupBy(KEY).agg(F.min("generation").cast("long").alias("boundary"))


def breakpoints(segments: DataFrame, floor: Column, most: int = MOST_HINTS, lookback: int = LOOKBACK) -> DataFrame:
    """The latest `most` segments that a cache hint may follow: enough tokens before, near the end,
    not protected as recent."""
    fit = segments.where((F.col("prefix_tokens") >= floor) & (F.col("seg_index") >= F.col("n_segments") - lookback) & ~recency_protected())
    nth = F.row_number().over(by_session(F.desc("seg_index")))
    return fit.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")
