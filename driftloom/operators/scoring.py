"""Scores, candidates and the decision of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import economics as E
from .segments import KEY, recency_protected, squash_candidate

#: Tokens of the marker that a removed segment leaves behind.
MARKER_TOKENS = 40


def with_scores(segments: DataFrame) -> DataFrame:
    """Add the seven signals, value and quality to segments that have salient, base, w, r, alive and
    access (1.0 where the stored reference is hot)."""
    signals = {
        "salience": F.col("salient").cast("double"),
        "recency": recency_protected().cast("double"),
        "freshness": E.freshness_signal(F.col("gap")),
        "economics": E.economics_signal(F.col("token_estimate"), F.col("pinned"), F.col("base"), F.col("w"), F.col("r"), F.col("alive")),
        "size": E.size_signal(F.col("token_estimate")),
        "content_type": E.kind_signal(F.col("kind")),
        "access_count": F.col("access"),
    }
    scored = segments.withColumns(signals).withColumn("value", E.score_value(*[F.col(c) for c in signals]))
    return scored.withColumn("quality", E.quality_gain(F.col("value")))


def candidates(scored: DataFrame, scale: Column | None = None) -> DataFrame:
    """Segments that may be replaced: neither salient (but for huge pastes), pinned nor recent."""
    scale = F.lit(1.0) if scale is None else scale
    fit = scored.where(squash_candidate() & ~F.col("pinned") & ~recency_protected())
    return fit.withColumn("net_removed", E.scaled_signed((F.col("token_estimate") - MARKER_TOKENS).cast("double"), scale))


def batches(found: DataFrame) -> DataFrame:
    """One row for each session with candidates. One cache bust at the edit nearest the head counts,
    so the suffix is a maximum, while removals and gains add up."""
    return found.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.max("suffix_tokens").cast("long").alias("suffix"),
        F.sum("net_removed").cast("long").alias("removed"),
        F.sum("quality").alias("quality_sum"),
        F.min("byte_offset").cast("long").alias("head_offset"),
    )


def decisions(sessions: DataFrame, found: DataFrame, npv_floor: float = 0.0) -> DataFrame:
    """The decision of every session. sessions: session_id, prefix, base, w, r, floor, alive, cold,
    free_bust, n_turns."""
    both = sessions.join(batches(found), KEY, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_candidates", "suffix", "removed", "head_offset")}
    both = both.withColumns(zero | {"quality_sum": F.coalesce("quality_sum", F.lit(0.0))})
    both = both.withColumns(
        {
            "bust": E.bust_cost(F.col("suffix"), F.col("base"), F.col("w"), F.col("r"), F.col("alive"), F.col("cold")),
            "recurring": E.recurring_saving(F.col("n_turns"), F.col("removed"), F.col("base"), F.col("r")),
            "break_even": E.break_even_turns(F.col("suffix"), F.col("removed"), F.col("w"), F.col("r"), F.col("cold")),
            "sub_floor": F.col("prefix") - F.col("removed") < F.col("floor"),
        }
    )
    both = both.withColumn("npv", E.npv(F.col("recurring"), F.col("quality_sum"), F.col("bust")))
    return both.withColumn("decision", E.decision(F.col("n_candidates"), F.col("sub_floor"), F.col("cold"), F.col("free_bust"), F.col("npv"), F.lit(npv_floor)))


def without_hot(proposals: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals whose reference is not hot, those dropped because it is)."""
    refs = hot.select("ref_id").distinct()
    return proposals.join(refs, "ref_id", "left_anti"), proposals.join(refs, "ref_id", "left_semi")


def repaired(choice: Column, n_ranges: Column, summary: Column) -> Column:
    """A truncation without ranges keeps; a summary without text compresses."""
    return F.when((choice == "truncate") & (n_ranges == 0), "keep").when((choice == "summarize") & (F.coalesce(F.length(summary), F.lit(0)) == 0), "compress").otherwise(choice)


def pre_gated(choice: Column, chars: Column, summary: Column, least: int = 256) -> Column:
    """Short originals, and summaries longer than them, are kept."""
    longer = (choice == "summarize") & (F.char_length(summary) > chars)
    return F.when((chars < least) | F.coalesce(longer, F.lit(False)), "keep").otherwise(choice)


STRATEGY = {"truncate": "truncate", "summarize": "summarize", "compress": "reversible_ref"}


def ladder(rows: DataFrame) -> DataFrame:
    """Add strategy (null: kept) to rows with gated, is_huge_paste, value, choice, chars, n_ranges and
    summary. Huge pastes are kept unless compressed."""
    choice = pre_gated(repaired(F.col("choice"), F.col("n_ranges"), F.col("summary")), F.col("chars"), F.col("summary"))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGY.items() for x in kv]), choice)
    huge = F.when(choice == "compress", F.lit("reversible_ref"))
    return rows.withColumn("strategy", F.when(F.col("gated"), None).when(F.col("is_huge_paste"), huge).otherwise(F.when(choice != "keep", named)))


def economics_gate(npv: Column, pinned: Column, chars: Column, huge: Column, floor: float = 0.0, least: int = 256) -> Column:
    return huge | ~(pinned | (npv <= floor) | (chars < least))
