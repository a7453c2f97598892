"""Passes over segments, composed into plans.

A pass is a named function from one DataFrame to another. Leaves carry what earlier passes made of
them in columns: content (as recoded so far), carried (the original that has to be stored, if any
pass lost something), recoded_by, net_removed and strategy. A later pass overwrites an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext, markup
from ..functions import text as X
from ..operators import budget, dedup, near_diff, scoring, segments
from ..scratch import written

ON_PATH, OFF_PATH = "on_path", "off_path"
MOST_REVERTS = 2
RECODE_SHARE = 0.8
LANE_BYTES = 256 * 1024
LEAF = ("session_id", "seg_index", "tool", "raw", "content", "carried", "recoded_by", "net_removed")


@dataclass(frozen=True)
class Pass:
    name: str
    apply: Callable[[DataFrame], DataFrame]
    phase: str = OFF_PATH


@dataclass(frozen=True)
class Checkpoint:
    name: str


@dataclass(frozen=True)
class Plan:
    """An ordered list of passes and checkpoints; plans are joined by >>."""

    stages: tuple = field(default_factory=tuple)

    def __rshift__(self, other: Plan | Pass | Checkpoint) -> Plan:
        return Plan(self.stages + (other.stages if isinstance(other, Plan) else (other,)))

    def on_path(self) -> Plan:
        return Plan(tuple(s for s in self.stages if isinstance(s, Checkpoint) or s.phase == ON_PATH))

    def run(self, df: DataFrame, revert: Callable[[str, DataFrame], str | None] | None = None) -> DataFrame:
        """All passes in order. revert(pass name, result) may name a checkpoint to go back to, whose
        DataFrame is then taken up again; at most MOST_REVERTS times, unknown names are ignored."""
        marks: dict[str, tuple[int, DataFrame]] = {}
        at, left = 0, MOST_REVERTS
        while at < len(self.stages):
            stage = self.stages[at]
            at += 1
            if isinstance(stage, Checkpoint):
                marks[stage.name] = (at, df)
                continue
            out = stage.apply(df)
            goal = revert(stage.name, out) if revert and left else None
            if goal in marks:
                left -= 1
                at, df = marks[goal]
            else:
                df = out
        return df


def as_leaves(rows: DataFrame) -> DataFrame:
    """rows: session_id, seg_index, tool, content."""
    return rows.select(
        "session_id", "seg_index", "tool", F.col("content").alias("raw"), "content", F.lit(None).cast("string").alias("carried"), F.lit(None).cast("string").alias("recoded_by"), F.lit(0).cast("long").alias("net_removed")
    )


def recode(name: str, made: Callable[[Column], Column], keeps_original: bool = False) -> Pass:
    """Put made(content) in place of content where it is strictly shorter. keeps_original: the pass
    loses something, so the earliest input of such a pass is carried to be stored."""

    def apply(leaves: DataFrame) -> DataFrame:
        new = leaves.withColumn("_new", made(F.col("content")))
        better = F.coalesce(F.octet_length("_new") < F.octet_length("content"), F.lit(False))
        return new.select(
            "session_id", "seg_index", "tool", "raw", F.when(better, F.col("_new")).otherwise(F.col("content")).alias("content"),
            (F.coalesce("carried", F.when(better, F.col("content"))) if keeps_original else F.col("carried")).alias("carried"),
            F.when(better, F.lit(name)).otherwise(F.col("recoded_by")).alias("recoded_by"),
            F.when(better, X.token_estimate(F.col("content")) - X.token_estimate(F.col("_new"))).otherwise(F.col("net_removed")).alias("net_removed"),
        )

    return Pass(name, apply, ON_PATH if name in ("ansi", "whitespace", "json_minify") else OFF_PATH)


def back_references(leaves: DataFrame) -> DataFrame:
    """Later copies of a raw leaf become empty, whatever was made of them before."""
    later = dedup.backrefs(leaves.select("session_id", F.col("seg_index").alias("seq"), F.col("raw").alias("content"))).select("session_id", F.col("seq").alias("seg_index"), "marker")
    joined = leaves.join(later, ["session_id", "seg_index"], "left")
    copy = F.col("marker").isNotNull()
    return joined.select(
        "session_id", "seg_index", "tool", "raw", F.when(copy, F.lit("")).otherwise(F.col("content")).alias("content"), F.when(copy, F.col("raw")).otherwise(F.col("carried")).alias("carried"),
        F.when(copy, F.lit("dedup")).otherwise(F.col("recoded_by")).alias("recoded_by"), F.when(copy, X.token_estimate(F.col("raw"))).otherwise(F.col("net_removed")).alias("net_removed"),
    )


def differences(leaves: DataFrame) -> DataFrame:
    """Last, as its bases have to be what stays visible: leaves without a carried original. The leaves are written
    first: they are read twice here, and a filter on them would repeat all passes before."""
    leaves = written(leaves, "leaves")
    bare = leaves.where("carried is null").select("session_id", F.col("seg_index").alias("seq"), "tool", "content")
    made = near_diff.sequential_diffs(bare).where("diff is not null").select("session_id", F.col("seq").alias("seg_index"), "diff")
    joined = leaves.join(made, ["session_id", "seg_index"], "left")
    is_diff = F.col("diff").isNotNull()
    return joined.select(
        "session_id", "seg_index", "tool", "raw", F.coalesce("diff", "content").alias("content"), F.when(is_diff, F.col("content")).otherwise(F.col("carried")).alias("carried"),
        F.when(is_diff, F.lit("diff")).otherwise(F.col("recoded_by")).alias("recoded_by"), F.when(is_diff, X.token_estimate(F.col("content")) - X.token_estimate(F.col("diff"))).otherwise(F.col("net_removed")).alias("net_removed"),
    )


BLOB = recode("blob", X.extract_blob, keeps_original=True)
ANSI = recode("ansi", X.strip_ansi)
WHITESPACE = recode("whitespace", X.normalize_space)
MARKUP = recode("markup", lambda c: F.when(markup.looks_like_html(c), markup.strip_html_udf(c)), keeps_original=True)
MINIFY = recode("json_minify", lambda c: jsontext.minify_udf(c))
LEANEST = recode("json_leanest", lambda c: jsontext.leanest_udf(c))
DEDUP = Pass("dedup", back_references)
HEAD_TAIL = recode("head_tail", X.head_tail, keeps_original=True)
DIFF = Pass("diff", differences)


def deterministic() -> Plan:
    return Plan((BLOB, ANSI, WHITESPACE, MARKUP, MINIFY, LEANEST, DEDUP, HEAD_TAIL, DIFF))


def fast_lane(leaves: DataFrame) -> DataFrame:
    """Leaves of at most LANE_BYTES, cleaned on the path; only those that got shorter. They are written before they are
    compared: the optimizer would put every pass in place of its result, and again in that of the one before."""
    small = leaves.where(F.octet_length("content") <= LANE_BYTES)
    return written(deterministic().on_path().run(small), "lane").where(F.octet_length("content") < F.octet_length("raw"))


def preferred(leaves: DataFrame) -> DataFrame:
    """Recoded leaves that save a fifth of their bytes or more, and so need no other decision."""
    return leaves.where((F.octet_length("raw") > 0) & (F.octet_length("content") <= RECODE_SHARE * F.octet_length("raw")) & F.col("recoded_by").isNotNull())


def continuous(hot: DataFrame) -> Plan:
    """Gate, score, choose, price, and drop what is in use. Takes segments with the columns that
    scoring.with_scores needs, and choice, n_ranges, summary, chars, ref_id."""

    def priced(rows: DataFrame) -> DataFrame:
        from ..functions import economics as E

        removed = F.col("token_estimate") - scoring.MARKER_TOKENS
        bust = E.bust_cost(F.col("suffix_tokens"), F.col("base"), F.col("w"), F.col("r"), F.col("alive"), F.col("cold"))
        value = E.npv(E.recurring_saving(F.col("n_turns"), removed, F.col("base"), F.col("r")), F.col("quality"), bust)
        return rows.withColumn("npv", E.to_digits(value, 9)).where(scoring.economics_gate(F.col("npv"), F.col("pinned"), F.col("chars"), F.col("is_huge_paste")))

    return Plan(
        (
            Pass("salience_gate", lambda s: s.withColumns({"gated": ~segments.squash_candidate(), "is_huge_paste": segments.huge_paste()})),
            Pass("score", scoring.with_scores),
            Pass("ladder_select", lambda s: scoring.ladder(s).where("strategy is not null")),
            Pass("economics_gate", priced),
            Pass("anti_thrash", lambda s: scoring.without_hot(s, hot)[0]),
        )
    )


def budget_fallback(window: int, max_output: int) -> Plan:
    """Reasoning, tool pairs, then the oldest turns, until the target is met."""
    target = max(256, window - max_output - 1024)
    return Plan((Pass("drop_ladder", lambda s: budget.drop_ladder(s, F.lit(target))),))


def kept_drops(drops: DataFrame, segs: DataFrame) -> DataFrame:
    """Drops that are still allowed when rendered: neither pinned nor recent."""
    fit = segs.where(~F.col("pinned") & ~F.col("salient") & ~segments.recency_protected()).select("session_id", "seg_index")
    return drops.join(fit, ["session_id", "seg_index"], "left_semi")


def route(staged: Column, over_budget: Column) -> Column:
    """Which plan a request takes."""
    return F.when(staged, "continuous").when(over_budget, "budget_fallback").otherwise("identity")
