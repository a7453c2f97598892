"""Queries over events as usage observations, stored references, request bodies and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import economics as E
from ..functions import text as X
from ..operators import segments, summary
from ..operators.segments import KEY, by_session
from ..sources import events as sse
from ..sources import refs, settings
from ..streaming import session_state
from .session_queries import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


START = "2024-01-01 00:00:00"


def as_observations(ev):
    """Events as the usage of responses; some leave no cached prefix, some have no estimate."""
    value = F.coalesce("value", F.lit(0.0))
    creation = F.when(F.col("event_type").isin("purchase", "signup", "click"), F.round(value * 10)).otherwise(0).cast("long")
    reads = F.when(F.col("event_type").isin("view", "click"), F.round(value)).otherwise(0).cast("long")
    at = F.timestamp_diff("MICROSECOND", F.lit(START).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / F.lit(1e6)
    return ev.select(
        F.col("user_id").cast("long").alias(KEY), F.col("event_id").cast("long").alias("seq"), at.alias("at"), creation.alias("creation"), reads.alias("read"), (F.round(value) + 1).cast("long").alias("input"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 500 + 50).cast("long").alias("estimated"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 100).cast("long").alias("predicted"), (F.col("event_id") % 37).cast("long").alias("messages"),
    )


def observations(spark, d):
    return as_observations(read(spark, d, "events"))


OBS = f"""obs AS (
  SELECT user_id AS session_id, event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '{START}'))::DOUBLE / 1e6::DOUBLE AS sec,
         CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN round(coalesce(value, 0) * 10)::BIGINT ELSE 0 END AS creation,
         CASE WHEN event_type IN ('view', 'click') THEN round(coalesce(value, 0))::BIGINT ELSE 0 END AS read, (round(coalesce(value, 0)) + 1)::BIGINT AS input,
         CASE WHEN event_id % 3 <> 0 THEN event_id % 500 + 50 END AS estimated, CASE WHEN event_id % 2 = 0 THEN event_id % 100 END AS predicted, event_id % 37 AS messages FROM events),
ord AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sec, seq) AS turn FROM obs)"""
FOLDS = f"""{OBS},
grp AS (SELECT session_id, count(*) AS turn, arg_max(creation + read, turn) AS prefix, arg_max(sec, turn) AS last_at, max(messages) AS floor,
  list(CASE WHEN estimated > 0 AND read + creation + input > 0 THEN (read + creation + input)::DOUBLE / estimated::DOUBLE END ORDER BY turn) AS ratios,
  list({{'sec': sec, 'n': 0::BIGINT}} ORDER BY turn) FILTER (turn >= 2 AND ((creation = 0 AND read = 0) OR coalesce(creation > 4 * predicted, false))) AS fails FROM ord GROUP BY session_id),
fold AS (SELECT session_id, turn, prefix, last_at, floor,
  list_reduce(list_filter(ratios, lambda x: x IS NOT NULL), lambda acc, x: CASE WHEN acc = 1.0::DOUBLE THEN x ELSE 0.7::DOUBLE * acc + 0.3::DOUBLE * x END, 1.0::DOUBLE) AS scale,
  list_reduce(list_transform(range(1, turn + 1), lambda t: t::DOUBLE), lambda acc, t: 0.3::DOUBLE * t + 0.7::DOUBLE * acc, 4.0::DOUBLE) AS remaining,
  list_reduce(coalesce(fails, []), lambda acc, x: CASE WHEN x.sec >= acc.sec + 60.0::DOUBLE THEN {{'sec': x.sec, 'n': acc.n + 1}} ELSE acc END, {{'sec': -1e18::DOUBLE, 'n': 0::BIGINT}}).n AS trips FROM grp)"""


@query("cache_warmth", f"WITH {OBS} SELECT seq, round(lag_at, 6) AS last_at, round(least(greatest(1.0::DOUBLE - (sec - lag_at) / 300.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 9) AS alive, (sec - lag_at) >= 300.0::DOUBLE AS cold, creation + read AS prefix FROM (SELECT *, lag(sec) OVER (PARTITION BY session_id ORDER BY sec, seq) AS lag_at FROM obs) WHERE lag_at IS NOT NULL")
def cache_warmth(spark, d):
    o = observations(spark, d).withColumn("last_at", F.lag("at").over(by_session("at", "seq"))).where("last_at is not null")
    ttl = F.lit(300.0)
    return o.select("seq", E.to_digits("last_at", 6).alias("last_at"), E.to_digits(E.p_alive(F.col("last_at"), ttl, F.col("at")), 9).alias("alive"), E.is_cold(F.col("last_at"), ttl, F.col("at")).alias("cold"), (F.col("creation") + F.col("read")).alias("prefix"))


@query("token_scale_ewma", f"WITH {FOLDS} SELECT session_id, round(scale, 9) AS scale FROM fold")
def token_scale_ewma(spark, d):
    return session_state.batch_states(observations(spark, d)).select(KEY, E.to_digits("scale", 9).alias("scale"))


@query("remaining_turns", f"WITH {FOLDS} SELECT session_id, turn, round(remaining, 6) AS remaining FROM fold")
def remaining_turns(spark, d):
    g = observations(spark, d).groupBy(KEY).agg(F.count(F.lit(1)).alias("turn"))
    return g.select(KEY, "turn", E.to_digits(E.fold_turns(F.col("turn")), 6).alias("remaining"))


@query("breaker_trips", f"WITH {FOLDS} SELECT session_id, trips FROM fold")
def breaker_trips(spark, d):
    return session_state.batch_states(observations(spark, d)).select(KEY, "trips")


@query("message_floor", f"WITH {OBS} SELECT seq, max(messages) OVER (PARTITION BY session_id ORDER BY sec, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS floor FROM obs")
def message_floor(spark, d):
    from pyspark.sql import Window

    w = by_session("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return observations(spark, d).select("seq", F.max("messages").over(w).alias("floor"))


STATE_SQL = f"WITH {FOLDS} SELECT session_id, turn, prefix, round(last_at, 6) AS last_at, round(remaining, 6) AS remaining, round(scale, 9) AS scale, trips, floor FROM fold"


def rounded(states):
    return states.select(KEY, "turn", "prefix", E.to_digits("last_at", 6).alias("last_at"), E.to_digits("remaining", 6).alias("remaining"), E.to_digits("scale", 9).alias("scale"), "trips", "floor")


@query("session_states", STATE_SQL)
def session_states(spark, d):
    return rounded(session_state.batch_states(observations(spark, d)))


@query("stream_session_state", STATE_SQL)
def stream_session_state(spark, d):
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if not path_is_file(spark, path) else d + "/events.parque[t]")
    return rounded(session_state.run_stream(spark, as_observations(stream)))


def path_is_file(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query("fast_lane_state", f"WITH {OBS} SELECT session_id, count(*) AS n_keys FROM (SELECT session_id, seq % 11 AS key, max_by(read % 2 = 0, seq) AS inside FROM obs GROUP BY ALL) WHERE inside GROUP BY session_id")
def fast_lane_state(spark, d):
    """The keys that a session has committed and not uncommitted since."""
    o = observations(spark, d).withColumn("key", F.col("seq") % 11)
    last = o.groupBy(KEY, "key").agg(F.max_by(F.col("read") % 2 == 0, "seq").alias("inside"))
    return last.where("inside").groupBy(KEY).agg(F.count(F.lit(1)).alias("n_keys"))


@query("usage_tap", f"WITH {OBS} SELECT seq, 'model-' || (seq % 3)::VARCHAR AS model, creation, read, input FROM obs WHERE seq % 5 <> 4")
def usage_tap(spark, d):
    """Usage read from synthetic responses; every fifth is garbage and gives none."""
    o = observations(spark, d)
    data = F.to_json(F.struct(F.lit("message_start").alias("type"), F.struct(F.concat(F.lit("model-"), (F.col("seq") % 3).cast("string")).alias("model"), F.struct(F.col("input").alias("input_tokens"), F.col("creation").alias("cache_creation_input_tokens"), F.col("read").alias("cache_read_input_tokens")).alias("usage")).alias("message")))
    end = F.when(F.col("seq") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    body = F.concat(F.lit("event: ping\ndata: {}\n\nevent:message_start"), end, F.lit("data: {broken\n"), F.lit("data: "), data, end, end, F.lit("event: message_stop\ndata: {}\n\n"))
    body = F.when(F.col("seq") % 5 == 4, F.lit("event: message_delta\ndata: {}\n\n")).otherwise(body)
    return o.select("seq", sse.usage(body).alias("u")).where("u is not null").select("seq", "u.model", "u.creation", "u.read", "u.input")


def store(spark, d):
    """Documents as stored originals: written by their source, at a time told by their id."""
    t = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select(
        X.content_address(t).alias("ref_id"), X.byte_length(t).alias("byte_len"), X.token_estimate(t).alias("token_estimate"), F.format_string("m%08d", "doc_id").alias("source_uuid"), F.coalesce("source", F.lit("none")).alias("session_id"), F.lit("tool_pair").alias("kind"),
        (F.col("doc_id") * 7 % 5000).cast("double").alias("created_at"), (F.col("doc_id") * 13 % 6000).cast("double").alias("last_access_at"), (F.col("doc_id") % 4).cast("long").alias("access_count"), (F.col("doc_id") % 17 == 0).alias("pinned"),
    )


STORE = """st AS (SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS ref_id, strlen(coalesce(text, ''))::BIGINT AS byte_len, 'm' || lpad(doc_id::VARCHAR, 8, '0') AS source_uuid, coalesce(source, 'none') AS session_id,
  (doc_id * 7 % 5000)::DOUBLE AS created_at, (doc_id * 13 % 6000)::DOUBLE AS last_access_at, doc_id % 4 AS access_count, doc_id % 17 = 0 AS pinned FROM documents)"""


@query("ref_put", f"WITH {STORE}, f AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY created_at, source_uuid) AS k FROM st WHERE doc_id % 2 = 1) SELECT ref_id, source_uuid, session_id, created_at, byte_len FROM f WHERE k = 1 AND ref_id NOT IN (SELECT ref_id FROM st WHERE doc_id % 2 = 0)")
def ref_put(spark, d):
    s = store(spark, d)
    odd = F.substring("source_uuid", 2, 8).cast("long") % 2 == 1
    return refs.put(s.where(~odd), s.where(odd)).select("ref_id", "source_uuid", "session_id", "created_at", "byte_len")


@query("ref_retrieve", f"WITH {STORE}, rq AS (SELECT doc_id, ref_id, 'src' || (doc_id % 20)::VARCHAR AS session_id FROM st), one AS (SELECT DISTINCT ref_id, session_id, byte_len FROM st) SELECT doc_id, byte_len IS NOT NULL AS hit FROM rq LEFT JOIN one USING (ref_id, session_id)")
def ref_retrieve(spark, d):
    s = store(spark, d)
    asked = s.select((F.substring("source_uuid", 2, 8).cast("long")).alias("doc_id"), "ref_id").withColumn("session_id", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")))
    held = s.select("ref_id", "session_id", "byte_len").distinct()
    return refs.retrieve(held, asked).select("doc_id", "hit")


@query("hot_refs", f"WITH {STORE} SELECT session_id, ref_id FROM st WHERE access_count >= 2")
def hot_refs(spark, d):
    return refs.hot_refs(store(spark, d))


@query(
    "ref_gc",
    f"""WITH {STORE}, loose AS (SELECT * FROM st WHERE NOT pinned AND ref_id NOT IN (SELECT ref_id FROM st WHERE doc_id % 5 = 0)), live AS (SELECT sum(byte_len) AS n FROM loose),
o AS (SELECT *, coalesce(sum(byte_len) OVER (ORDER BY last_access_at, ref_id, source_uuid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM loose WHERE 5000.0::DOUBLE - created_at > 600)
SELECT source_uuid, ref_id, byte_len FROM o, live WHERE n - before > 500000""",
)
def ref_gc(spark, d):
    s = store(spark, d)
    reachable = s.where(F.substring("source_uuid", 2, 8).cast("long") % 5 == 0)
    return refs.collect_garbage(s, reachable, now=5000.0, most=500_000, order=("last_access_at", "ref_id", "source_uuid")).select("source_uuid", "ref_id", "byte_len")


def chats(spark, d):
    return segments.session_messages(read(spark, d, "conversations"))


@query("recap_turns", "WITH u AS (SELECT conv_id AS session_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user' AND text <> '') SELECT session_id, string_agg(text, chr(1) ORDER BY turn) AS recap FROM u WHERE k BETWEEN 2 AND 7 GROUP BY session_id")
def recap_turns(spark, d):
    return summary.recap_turns(chats(spark, d)).select(KEY, F.array_join("recap", "\x01").alias("recap"))


@query("compaction_detect", "SELECT DISTINCT conv_id AS session_id, conv_id % 4 = 0 AND conv_id % 3 <> 0 AS detected FROM conversations")
def compaction_detect(spark, d):
    m = F.lit(summary.MARKER)
    last = F.when(F.col(KEY) % 4 < 2, F.concat(F.lit("please. "), m)).otherwise(F.lit("go on"))
    body = F.concat(F.lit('{"a":"'), F.when(F.col(KEY) % 4 != 1, m).otherwise(F.lit("")), F.lit('","b":"'), last, F.lit('"}'))
    s = chats(spark, d).select(KEY).distinct()
    return s.select(KEY, summary.is_compaction(body, F.when(F.col(KEY) % 3 == 0, 30_000).otherwise(4_000), F.lit(False), last).alias("detected"))


SUMMARY_SQL = """WITH u AS (SELECT conv_id AS session_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user' AND text <> ''),
r AS (SELECT session_id, string_agg('- ' || trim(split_part(text, chr(10), 1)), chr(10) ORDER BY turn) AS story FROM u WHERE k BETWEEN 2 AND 7 GROUP BY session_id),
s AS (SELECT session_id, '## Constraints' || chr(10) || CASE WHEN session_id % 2 = 0 THEN '- keep it short' ELSE '(none)' END || chr(10) || '## Decisions' || chr(10) || '- use parquet (done): it is there' || chr(10)
  || '## In flight' || chr(10) || '(none)' || chr(10) || '## So far' || chr(10) || coalesce(story, '(none)') AS summary FROM (SELECT DISTINCT conv_id AS session_id FROM conversations) LEFT JOIN r USING (session_id))"""


def summaries(spark, d):
    m = chats(spark, d)
    s = m.select(KEY).distinct().join(summary.recap_turns(m), KEY, "left").withColumn("recap", F.coalesce("recap", F.expr("cast(array() as array<string>)")))
    gone = F.when(F.col(KEY) % 2 == 1, F.lit(3))
    rules = F.array(F.struct(F.lit("keep it short").alias("text"), F.lit(1).alias("source_message"), gone.alias("superseded_by")))
    made = F.array(F.struct(F.lit("use parquet").alias("text"), F.lit("it is there").alias("rationale"), F.lit(False).alias("planned"), F.lit(None).cast("int").alias("superseded_by")))
    return s.select(KEY, summary.summary(rules, made, F.expr("cast(array() as array<string>)"), F.col("recap")).alias("summary"))


@query("summary_render", SUMMARY_SQL + " SELECT session_id, summary FROM s")
def summary_render(spark, d):
    return summaries(spark, d)


@query("sse_frames", SUMMARY_SQL + """ SELECT session_id, f.idx, f.event, CASE WHEN f.event = 'message_delta' THEN strlen(summary) // 4 + 1 ELSE 0 END AS tokens FROM s, (VALUES (0, 'message_start'), (1, 'content_block_start'), (2, 'content_block_delta'), (3, 'content_block_stop'), (4, 'message_delta'), (5, 'message_stop')) f(idx, event)""")
def sse_frames(spark, d):
    s = summaries(spark, d)
    tokens = X.synthetic_tokens(F.col("summary"))
    fs = sse.frames(F.concat(F.lit("msg_"), F.col(KEY).cast("string")), F.lit("model-large"), F.col("summary"), F.lit(256), tokens)
    f = s.select(KEY, F.posexplode(fs).alias("idx", "f"))
    return f.select(KEY, "idx", "f.event", F.coalesce(F.get_json_object("f.data", "$.usage.output_tokens").cast("long"), F.lit(0)).alias("tokens"))


@query("session_demux", "SELECT DISTINCT conv_id AS session_id, conv_id % 3 = 0 AND conv_id % 2 = 0 AS inspected FROM conversations")
def session_demux(spark, d):
    s = read(spark, d, "conversations").select(F.col("conv_id").alias(KEY)).distinct()
    requests = s.select(KEY, F.when(F.col(KEY) % 2 == 0, "POST").otherwise("GET").alias("method"), F.concat(F.lit("/s/k"), F.col(KEY).cast("string"), F.lit("/v1/messages")).alias("path"))
    known = s.where(F.col(KEY) % 3 == 0).select(F.concat(F.lit("k"), F.col(KEY).cast("string")).alias("token"))
    return settings.routed(requests, known).select(KEY, "inspected")


@query("control_flags", "SELECT event_type AS name, arg_max(event_id % 2 = 0, event_id) AS value FROM events GROUP BY event_type")
def control_flags(spark, d):
    return settings.flags(read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), (F.col("event_id") % 2 == 0).alias("value")))
