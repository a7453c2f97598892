"""Queries over the pass plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import economics as E
from ..functions import text as X
from ..operators.segments import KEY
from . import passes, session_queries
from .session_queries import LADDER, SEG
from .text_queries import leaves, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def dirty(spark, d):
    """Documents with colours, odd line ends, and in every third one a blob."""
    rows = leaves(spark, d).withColumnRenamed("seq", "seg_index")
    blob = F.when(F.col("seg_index") % 3 == 0, F.lit(" " + "QUJD" * 200 + " ")).otherwise(F.lit(""))
    return passes.as_leaves(rows.withColumn("content", F.concat(F.lit("\x1b[31m"), F.col("content"), F.lit("\x1b[0m  \r\n\n\n\n"), blob)))


CR, NL, ESC = "chr(13)", "chr(10)", "chr(27)"
#: What dirty() makes of each document, and its later copies in a session that are long enough to be told by reference.
DIRTY = f"""WITH l AS (SELECT coalesce(source, 'none') AS session_id, doc_id AS seg_index, {ESC} || '[31m' || coalesce(text, '') || {ESC} || '[0m  ' || {CR} || repeat({NL}, 4) || CASE WHEN doc_id % 3 = 0 THEN ' ' || repeat('QUJD', 200) || ' ' ELSE '' END AS raw FROM documents),
c AS (SELECT *, strlen(raw) >= 1024 AND seg_index > min(seg_index) OVER (PARTITION BY session_id, raw) AS copy FROM l)"""


@query("recode_chain", DIRTY + " SELECT seg_index, true AS never_longer, true AS original_kept, true AS clean, copy, CASE WHEN copy THEN md5(raw) END AS carried_md5, CASE WHEN copy THEN ceil(length(raw) / 3.5::DOUBLE)::BIGINT END AS saved FROM c")
def recode_chain(spark, d):
    """What must hold of every leaf, and which are copies: those carry their original whole."""
    out = passes.deterministic().run(dirty(spark, d))
    lossy, copy = F.col("recoded_by").isin("blob", "dedup", "head_tail", "diff", "markup"), F.coalesce(F.col("recoded_by") == "dedup", F.lit(False))
    return out.select(
        "seg_index", (F.octet_length("content") <= F.octet_length("raw")).alias("never_longer"), (~lossy | F.col("carried").isNotNull()).alias("original_kept"), (~F.col("content").contains("\x1b")).alias("clean"),
        copy.alias("copy"), F.when(copy, F.md5("carried")).alias("carried_md5"), F.when(copy, F.col("net_removed")).alias("saved"),
    )


@query("recode_rows")
def recode_rows(spark, d):
    return passes.deterministic().run(dirty(spark, d)).select("session_id", "seg_index", "recoded_by", "net_removed", F.md5("content").alias("content_md5"), F.md5("carried").alias("carried_md5"))


@query(
    "fast_lane",
    DIRTY + f""", a AS (SELECT *, regexp_replace(raw, '\\x1b(?:\\[[^\\x40-\\x7e]*[\\x40-\\x7e]?|[^\\[])?|[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g') AS bare FROM c WHERE strlen(raw) <= 262144),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(bare, '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), '^\\n{{2,}}', {NL}), '\\n{{3,}}', {NL} || {NL}, 'g') AS s FROM a)
SELECT seg_index, md5(CASE WHEN ends_with(bare, {NL}) THEN s ELSE regexp_replace(s, '\\n+$', '') END) AS content_md5 FROM w""",
)
def fast_lane(spark, d):
    """What is left of each leaf on the path; leaves over the lane's size are not taken up."""
    return passes.fast_lane(dirty(spark, d)).select("seg_index", F.md5("content").alias("content_md5"))


CONTINUOUS_SQL = LADDER + """, n AS (SELECT *, 'sha256:' || sha256(rendered) AS ref_id, round(40.0::DOUBLE * (token_estimate - 40)::DOUBLE * base * r + quality - CASE WHEN cold THEN 0.0::DOUBLE ELSE suffix_tokens::DOUBLE * base * (w - r) * alive END, 9) AS npv FROM lad WHERE strategy IS NOT NULL),
hot AS (SELECT DISTINCT 'sha256:' || sha256(rendered) AS ref_id FROM seg WHERE session_id % 10 = 0)
SELECT session_id, seg_index, strategy, npv FROM n WHERE (huge OR NOT (pinned OR npv <= 0 OR chars < 256)) AND ref_id NOT IN (SELECT ref_id FROM hot)"""


@query("continuous_plan", CONTINUOUS_SQL)
def continuous_plan(spark, d):
    s = session_queries.priced(session_queries.salient_segs(spark, d))
    names = F.array(*[F.lit(c) for c in ("truncate", "summarize", "compress", "keep")])
    s = s.withColumns(
        {"choice": F.element_at(names, ((F.col(KEY) + F.col("seg_index")) % 4 + 1).cast("int")), "n_ranges": (F.col("seg_index") % 3).cast("int"), "summary": F.when(F.col("seg_index") % 2 == 0, F.col("rendered")).otherwise(F.lit("")), "chars": F.char_length("rendered").cast("long"), "ref_id": X.content_address(F.col("rendered"))}
    )
    hot = session_queries.segs(spark, d).where(F.col(KEY) % 10 == 0).select(X.content_address(F.col("rendered")).alias("ref_id"))
    return passes.continuous(hot).run(s).select(KEY, "seg_index", "strategy", "npv")


@query("plan_route", f"WITH {SEG} SELECT session_id, CASE WHEN session_id % 4 = 0 THEN 'continuous' WHEN sum(token_estimate)::DOUBLE > 0.4::DOUBLE * 4000::DOUBLE THEN 'budget_fallback' ELSE 'identity' END AS plan FROM seg GROUP BY session_id")
def plan_route(spark, d):
    per = session_queries.segs(spark, d).groupBy(KEY).agg(F.sum("token_estimate").alias("added"))
    return per.select(KEY, passes.route(F.col(KEY) % 4 == 0, E.soft_pressure(F.lit(4000), F.col("added"))).alias("plan"))


@query(
    "fallback_drops",
    f"""WITH {SEG}, t AS (SELECT *, sum(token_estimate) OVER (PARTITION BY session_id)::BIGINT AS total FROM seg),
o AS (SELECT *, coalesce(sum(token_estimate) OVER (PARTITION BY session_id ORDER BY seg_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shed FROM t WHERE kind <> 'system' AND NOT is_current)
SELECT session_id, seg_index FROM o WHERE total - shed > 256 AND NOT pinned AND NOT salient AND NOT recent""",
)
def fallback_drops(spark, d):
    s = session_queries.salient_segs(spark, d).withColumn("shed", F.lit(None).cast("long"))
    return passes.kept_drops(passes.budget_fallback(4_000, 4_000).run(s), s).select(KEY, "seg_index")


@query("status_counts", f"WITH {SEG} SELECT count(DISTINCT session_id) AS sessions, count(*) AS segments, sum(token_estimate)::BIGINT AS tokens FROM seg")
def status_counts(spark, d):
    return session_queries.segs(spark, d).agg(F.countDistinct(KEY).alias("sessions"), F.count(F.lit(1)).alias("segments"), F.sum("token_estimate").cast("long").alias("tokens"))
