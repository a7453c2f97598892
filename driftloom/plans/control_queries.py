"""Queries over what comes from beside the data: retrieval in SQL, control frames, status."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import scratch_path
from ..sources import control, retrieval, status
from . import session_queries
from .session_queries import read
from .text_queries import BM25, NL, asked

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query(
    "retrieve_sql",
    BM25.replace("/ av))), 6) AS score", "/ av))), 9) AS score") + f""", own AS (SELECT DISTINCT sha256(coalesce(text, '')) AS h, coalesce(source, 'none') AS session_id FROM documents),
top AS (SELECT doc_id, idx FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) <= 5),
f AS (SELECT doc_id, string_agg(passage, {NL} ORDER BY idx) AS found FROM top JOIN u USING (doc_id, idx) GROUP BY doc_id)
SELECT p.doc_id, h IS NOT NULL AS hit, md5(CASE WHEN h IS NULL THEN '{retrieval.HINT}' WHEN p.doc_id % 3 = 0 THEN q.text WHEN found IS NULL THEN array_to_string(ps[1:5], {NL}) ELSE found END) AS found_md5
FROM p JOIN q USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN own ON h = sha256(q.text) AND session_id = 'src' || (p.doc_id % 20)::VARCHAR""",
)
def retrieve_sql(spark, d):
    """Each document asked for by some session, every third time whole, otherwise by a query; in SQL."""
    t = F.coalesce("text", F.lit(""))
    view, calls = f"kept_{uuid.uuid4().hex}", f"asked_{uuid.uuid4().hex}"
    read(spark, d, "documents").select(X.content_address(t).alias("ref_id"), F.coalesce("source", F.lit("none")).alias("session_id"), t.alias("doc")).distinct().createOrReplaceTempView(view)
    whole = F.col("doc_id") % 3 == 0
    asked(spark, d).select("doc_id", X.content_address(F.col("doc")).alias("ref_id"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("session_id"), F.when(~whole, F.col("query")).alias("query")).createOrReplaceTempView(calls)
    retrieval.register(spark, view)
    return spark.sql(f"SELECT r.doc_id, o.doc IS NOT NULL AS hit, md5(f.found) AS found_md5 FROM {calls} r LEFT JOIN LATERAL stored(r.ref_id, r.session_id) o JOIN LATERAL found_in(o.doc, r.query) f")


def frame_lines(spark, d):
    """Events as frames of twenty connections; some are torn, of another protocol or of unknown kinds."""
    e = read(spark, d, "events")
    k = F.col("event_id")
    text = lambda s: F.lit(s)
    token = F.concat(text('"token": "t'), (k % 50).cast("string"), text('"'))
    frame = (
        F.when(k % 97 == 5, text('{"type": "kill", "on": tr')).when(k % 89 == 7, text('{"type": "kill", "protocol": 2, "on": true}')).when(k % 83 == 9, text('{"type": "dance", "protocol": 1}')).when(k % 79 == 3, text('{"type": "gc", "protocol": 1, "on": true}'))
        .when(k % 73 == 2, text('{"type": "evict", "protocol": 1, "token": ""}'))
        .when(k % 5 == 0, F.concat(text('{"type": "mint", "protocol": 1, '), token, text(', "config": {"b": 1, "a": []}}')))
        .when(k % 5 == 1, F.concat(text('{"protocol": 1, "type": "evict", '), token, text("}")))
        .when(k % 5 == 2, F.concat(text('{"type": "shadow", "protocol": 1, "on": '), (k % 2 == 0).cast("string"), text("}")))
        .when(k % 5 == 3, F.concat(text('{"type": "kill", "protocol": 1, "on": '), (k % 2 == 0).cast("string"), text("}"))).otherwise(text('{"type": "gc", "protocol": 1}'))
    )
    return e.select(k.alias("k"), (k % 20).cast("int").alias("file"), frame.alias("value"))


FRAMES = """f AS (SELECT event_id AS k, event_id % 20 AS file,
  CASE WHEN event_id % 97 = 5 THEN 'no json' WHEN event_id % 89 = 7 THEN 'other protocol' WHEN event_id % 83 = 9 THEN 'unknown type' WHEN event_id % 79 = 3 THEN 'other fields' WHEN event_id % 73 = 2 THEN 'bad value' END AS error,
  CASE event_id % 5 WHEN 0 THEN 'mint' WHEN 1 THEN 'evict' WHEN 2 THEN 'shadow' WHEN 3 THEN 'kill' ELSE 'gc' END AS kind,
  CASE WHEN event_id % 5 < 2 THEN 't' || (event_id % 50)::VARCHAR END AS token, CASE WHEN event_id % 5 IN (2, 3) THEN event_id % 2 = 0 END AS "on" FROM events)"""


def append_frames(rows, folder):
    """One file for each connection, its frames in order."""
    named = rows.select("k", F.col("file").alias("name"), "value").repartition("name").sortWithinPartitions("name", "k")
    named.select("value", "name").write.mode("append").partitionBy("name").text(folder)


def numbered(frames):
    """The frames of a connection numbered from 1."""
    w = Window.partitionBy("file").orderBy("pos")
    return frames.withColumn("file", F.regexp_extract("file", r"name=(\d+)/", 1).cast("long")).withColumn("nth", F.row_number().over(w).cast("long"))


def told(frames):
    return numbered(frames).select("file", "nth", "kind", "token", "on", F.md5("config").alias("config_md5"), "error")


TOLD = f"""WITH {FRAMES} SELECT file, row_number() OVER (PARTITION BY file ORDER BY k) AS nth, CASE WHEN error IS NULL THEN kind END AS kind, CASE WHEN error IS NULL THEN token END AS token,
  CASE WHEN error IS NULL THEN "on" END AS "on", CASE WHEN error IS NULL AND kind = 'mint' THEN md5('{{"a": [], "b": 1}}') END AS config_md5, error FROM f"""


def source(spark):
    spark.dataSource.register(control.ControlFrames)
    return "control_frames"


def frame_folder(spark):
    return scratch_path(spark, "frames").removeprefix("file://")


@query("control_frames", TOLD)
def control_frames(spark, d):
    folder = frame_folder(spark)
    append_frames(frame_lines(spark, d), folder)
    return told(spark.read.format(source(spark)).load(folder))


@query("stream_control_frames", TOLD)
def stream_control_frames(spark, d):
    """The same from a stream that is stopped and started again while connections come."""
    rows, folder, kind = frame_lines(spark, d), frame_folder(spark), source(spark)
    out = scratch_path(spark, "frames-read")
    for part in ("file < 8", "file >= 8"):
        append_frames(rows.where(part), folder)
        save = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/rows/batch={k}")
        spark.readStream.format(kind).load(folder).writeStream.option("checkpointLocation", f"{out}/log").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return told(spark.read.schema(control.FRAME).parquet(f"{out}/rows"))


@query("control_in_force", f"""WITH {FRAMES}, e AS (SELECT file, min(k) AS bad FROM f WHERE error IS NOT NULL GROUP BY file)
SELECT file, count(*) AS frames, arg_max("on", k) FILTER (kind = 'kill') AS kill, arg_max("on", k) FILTER (kind = 'shadow') AS shadow FROM f LEFT JOIN e USING (file) WHERE bad IS NULL OR k < bad GROUP BY file""")
def control_in_force(spark, d):
    """What each connection has set before its first bad frame."""
    folder = frame_folder(spark)
    append_frames(frame_lines(spark, d), folder)
    held = numbered(control.in_force(spark.read.format(source(spark)).load(folder)))
    latest = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("on")), F.when(F.col("kind") == kind, F.col("nth"))).alias(kind)
    return held.groupBy("file").agg(F.count(F.lit(1)).alias("frames"), latest("kill"), latest("shadow"))


@query("status_snapshot", f"WITH {session_queries.SEG} SELECT count(DISTINCT session_id) AS sessions, count(*) AS segments, sum(token_estimate)::BIGINT AS tokens, max(generation)::BIGINT AS newest FROM seg")
def status_snapshot(spark, d):
    """Counts observed while the segments of all sessions are worked out for another use, published and read back."""
    path = scratch_path(spark, "status.json")
    rows, seen = status.observing(
        session_queries.segs(spark, d), sessions=F.count_if(F.col("seg_index") == 0), segments=F.count(F.lit(1)), tokens=F.coalesce(F.sum("token_estimate").cast("long"), F.lit(0).cast("long")), newest=F.coalesce(F.max("generation").cast("long"), F.lit(0).cast("long"))
    )
    rows.write.format("noop").mode("overwrite").save()
    status.publish(spark, path, seen.get)
    found = status.snapshot(spark, path, dict.fromkeys(("sessions", "segments", "tokens", "newest"), int))
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in found.items()])
