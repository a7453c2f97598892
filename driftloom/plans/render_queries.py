"""Queries over what is put in the place of segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import render, segments
from ..operators.segments import KEY
from ..operators.summarizer import Extractive
from .session_queries import SEG, read, segs
from .text_queries import D, NL, docs

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def addressed(spark, d):
    return segs(spark, d).withColumn("ref_id", X.content_address(F.col("rendered")))


@query("staged_plan", f"WITH {SEG}, a AS (SELECT *, 'sha256:' || sha256(rendered) AS ref_id FROM seg), p AS (SELECT DISTINCT session_id, ref_id, 'summarize' AS choice FROM a WHERE seg_index % 2 = 1) SELECT session_id, seg_index, ref_id, choice FROM a JOIN p USING (session_id, ref_id)")
def staged_plan(spark, d):
    a = addressed(spark, d)
    plan = a.where(F.col("seg_index") % 2 == 1).select(KEY, "ref_id").distinct().withColumn("choice", F.lit("summarize"))
    return render.staged(a, plan).select(KEY, "seg_index", "ref_id", "choice")


@query("staged_summary", f"WITH {SEG} SELECT session_id, count(*) AS candidates, count(*) FILTER (seg_index % 2 = 1) AS staged FROM seg WHERE NOT pinned GROUP BY session_id")
def staged_summary(spark, d):
    return segs(spark, d).where("not pinned").groupBy(KEY).agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("seg_index") % 2 == 1, 1)).alias("staged"))


@query(
    "strategy_text",
    f"""WITH {SEG}, k AS (SELECT session_id, seg_index, rendered, ['keep', 'drop', 'recode', 'summarize', 'truncate'][seg_index % 5 + 1] AS strategy, '[repeats an earlier message | ref=sha256:' || sha256(rendered) || ']' AS marker FROM seg)
SELECT session_id, seg_index, CASE strategy WHEN 'drop' THEN '[left out to fit the budget]' WHEN 'recode' THEN CASE WHEN session_id % 2 = 0 THEN rendered || {NL} || marker ELSE rendered END ELSE marker END AS text FROM k WHERE strategy <> 'keep'""",
)
def strategy_text(spark, d):
    s = addressed(spark, d)
    strategy = F.element_at(F.array(*[F.lit(x) for x in ("keep", "drop", "recode", "summarize", "truncate")]), (F.col("seg_index") % 5 + 1).cast("int"))
    out = render.strategy_text(strategy, F.col("rendered"), X.backref(F.col("ref_id")), F.col(KEY) % 2 == 0)
    return s.select(KEY, "seg_index", out.alias("text")).where("text is not null")


@query("uncached_tail", f"WITH {SEG} SELECT session_id, seg_index, msg_index >= 2 AS uncached FROM seg")
def uncached_tail(spark, d):
    return segs(spark, d).select(KEY, "seg_index", render.uncached(F.col("source_msgs"), F.lit(2)).alias("uncached"))


@query("safe_hints", f"WITH {SEG} SELECT session_id, string_agg(msg_index::VARCHAR, ',' ORDER BY msg_index) AS hints FROM seg WHERE msg_index % 2 = 1 AND NOT recent GROUP BY session_id")
def safe_hints(spark, d):
    s = segs(spark, d).withColumn("m", F.col("source_msgs")[0])
    per = s.groupBy(KEY).agg(F.array_sort(F.collect_list(F.when(~segments.recency_protected(), F.col("m")))).alias("hints"), F.collect_list(F.when(F.col("m") % 2 == 1, F.col("m"))).alias("rewritten"))
    kept = render.safe_hints(F.col("hints"), F.col("rewritten"))
    return per.select(KEY, F.array_join(kept, ",").alias("hints")).where("hints <> ''")


@query("recent_text", f"WITH {SEG} SELECT session_id, string_agg(rendered, {NL} ORDER BY seg_index) AS recent FROM seg WHERE recent GROUP BY session_id")
def recent_text(spark, d):
    return render.recent_text(segs(spark, d))


@query("block_json", f"""WITH {D} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{{"type":"tool_result","tool_use_id":"t","content":"c' || doc_id || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"is_error":true' ELSE '' END || '}}' WHEN 1 THEN '{{"type":"text","text":"c' || doc_id || '"}}' ELSE '[{{"type":"text","text":"c' || doc_id || '"}}]' END AS json FROM d""")
def block_json(spark, d):
    slot = F.element_at(F.array(F.lit("tool_result"), F.lit("text_block"), F.lit("string_content")), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    return docs(spark, d).select("doc_id", render.block_json(slot, text, F.lit("t"), F.col("doc_id") % 2 == 0).alias("json"))


@query("merged_targets", "SELECT conv_id AS session_id, turn AS message, CASE WHEN turn % 2 = 0 THEN 'plan' ELSE 'lane' END AS json FROM conversations WHERE turn % 2 = 0 OR turn % 3 = 0")
def merged_targets(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias(KEY), F.col("turn").cast("long").alias("message"), F.when(F.col("turn") % 4 == 0, F.lit(0)).alias("block"))
    plan, lane = c.where("message % 2 = 0").withColumn("json", F.lit("plan")), c.where("message % 3 = 0").withColumn("json", F.lit("lane"))
    return render.merged(plan, lane).select(KEY, "message", "json")


@query(
    "lane_summary",
    f"""WITH {D}, t AS (SELECT doc_id, repeat(chr(27) || '[31m', doc_id % 4) || text || CASE WHEN doc_id % 5 = 0 THEN chr(7) || chr(27) || '[1;2' ELSE '' END AS dirty FROM d),
c AS (SELECT doc_id, dirty, regexp_replace(dirty, '\\x1b(?:\\[[^\\x40-\\x7e]*[\\x40-\\x7e]?|[^\\[])?|[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g') AS clean FROM t)
SELECT count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS n_fresh, sum(strlen(dirty) - strlen(clean))::BIGINT AS bytes_saved FROM c WHERE strlen(clean) < strlen(dirty)""",
)
def lane_summary(spark, d):
    k = F.col("doc_id")
    dirty = F.concat(F.repeat(F.lit("\x1b[31m"), (k % 4).cast("int")), F.col("text"), F.when(k % 5 == 0, F.lit("\x07\x1b[1;2")).otherwise(""))
    lane = docs(spark, d).select((k % 2 == 0).alias("fresh"), X.byte_length(dirty).alias("before"), X.byte_length(X.strip_ansi(dirty)).alias("after"))
    return render.lane_summary(lane.where("after < before"))


@query("shadow_kill", "SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id % 2 = 0 OR conv_id % 3 = 0 THEN 'old' ELSE 'new' END AS body FROM conversations")
def shadow_kill(spark, d):
    s = read(spark, d, "conversations").select(F.col("conv_id").alias(KEY)).distinct()
    return s.select(KEY, render.forward(F.lit("old"), F.lit("new"), F.col(KEY) % 2 == 0, F.col(KEY) % 3 == 0).alias("body"))


@query("summarizer_choice", f"""WITH {D} SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR length(text) < 256 THEN 'keep' WHEN len(string_split(regexp_replace(text, '\\n$', ''), {NL})) > 60 THEN 'truncate' ELSE 'summarize' END AS choice FROM d""")
def summarizer_choice(spark, d):
    tags = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("[CONSTRAINT]"))).otherwise(F.expr("cast(array() as array<string>)"))
    return docs(spark, d).select("doc_id", Extractive().decide(F.col("text"), tags)["choice"].alias("choice"))
