"""Queries over events as all that happens to a session, and over conversations as its working state."""

from __future__ import annotations

import hashlib
import json
import threading

from pyspark.sql import functions as F

from ..functions import economics as E
from ..operators import decision_client as C
from ..operators import working_state as W
from ..operators.segments import KEY
from ..streaming import session_log as L
from ..streaming.slices import run_in_slices
from .session_queries import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


LIMITS = L.Limits(cooldown_ms=60_000, idle_ms=300_000)
START = "2024-01-01 00:00:00"


def events(spark, d):
    """What users did as requests, responses, plans and control, six hundred times as fast."""
    e = read(spark, d, "events")
    k, value, kind = F.col("event_id"), F.coalesce("value", F.lit(0.0)), F.col("event_type")
    named = (
        F.when(kind.isin("view", "purchase"), "usage").when(kind == "click", "request").when(kind == "signup", "plan")
        .when(k % 40 == 0, "evict").when(k % 4 == 1, "bypass").otherwise("request")
    )
    us = F.timestamp_diff("MICROSECOND", F.lit(START).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    of = e.select(F.col("user_id").cast("long").alias(KEY), k.cast("long").alias("seq"), F.floor(us / 600_000).cast("long").alias("at"), named.alias("kind"), value.alias("value"), kind.alias("type"))
    k, is_request, is_usage = F.col("seq"), F.col("kind") == "request", F.col("kind") == "usage"
    return of.select(
        KEY, "seq", "at", "kind",
        F.when(is_usage, F.when(F.col("type") == "purchase", F.round(F.col("value") * 10)).otherwise(0)).when(is_request & (k % 23 != 0), k % 37).when(F.col("kind") == "plan", k % 100).cast("long").alias("number"),
        F.when(is_usage, F.when(F.col("type") == "view", F.round("value")).otherwise(0)).when(is_request & (k % 29 != 0), k % 500 + 50).cast("long").alias("size"),
        F.when(is_usage, F.round("value") + 1).when(is_request, k % 41).cast("long").alias("place"),
        F.when(F.col("kind").isin("request", "plan") & (k % 11 != 0), F.concat(F.lit("k"), (k % 7).cast("string"))).alias("key"),
        F.when(is_request, k % 13 != 0).alias("done"),
    )


LOG = f"""WITH RECURSIVE e0 AS (
  SELECT user_id AS session_id, event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) // 600000 AS ms, event_type AS type, coalesce(value, 0) AS value,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'usage' WHEN event_type = 'click' THEN 'request' WHEN event_type = 'signup' THEN 'plan'
         WHEN event_id % 40 = 0 THEN 'evict' WHEN event_id % 4 = 1 THEN 'bypass' ELSE 'request' END AS kind FROM events),
ev AS (
  SELECT session_id, seq, ms, kind, row_number() OVER (PARTITION BY session_id ORDER BY ms, seq) AS n,
    CASE WHEN kind = 'usage' THEN CASE WHEN type = 'purchase' THEN round(value * 10)::BIGINT ELSE 0 END WHEN kind = 'request' AND seq % 23 <> 0 THEN seq % 37 WHEN kind = 'plan' THEN seq % 100 END AS number,
    CASE WHEN kind = 'usage' THEN CASE WHEN type = 'view' THEN round(value)::BIGINT ELSE 0 END WHEN kind = 'request' AND seq % 29 <> 0 THEN seq % 500 + 50 END AS size,
    CASE WHEN kind = 'usage' THEN round(value)::BIGINT + 1 WHEN kind = 'request' THEN seq % 41 END AS place,
    CASE WHEN kind IN ('request', 'plan') AND seq % 11 <> 0 THEN 'k' || (seq % 7)::VARCHAR END AS key, kind = 'request' AND seq % 13 <> 0 AS done FROM e0),
zero AS (SELECT {{'turn': 0::BIGINT, 'prefix': 0::BIGINT, 'last_at': NULL::BIGINT, 'last_seq': -1::BIGINT, 'remaining': 4.0::DOUBLE, 'scale': 1.0::DOUBLE, 'until': -1::BIGINT, 'by': -1::BIGINT, 'trips': 0::BIGINT,
  'floor': 0::BIGINT, 'closed': true, 'estimated': -1::BIGINT, 'predicted': -1::BIGINT, 'plan': NULL::VARCHAR, 'plan_seq': NULL::BIGINT, 'plan_tokens': -1::BIGINT, 'lane': []::VARCHAR[]}} AS z),
log AS (
  SELECT DISTINCT ev.session_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::BIGINT AS ms, z AS s, NULL::BIGINT AS used, false AS entered, false AS gone, NULL::BIGINT AS shut, NULL::BIGINT AS lost FROM ev, zero
  UNION ALL
  SELECT session_id, n, seq, kind, ms, CASE kind
    WHEN 'evict' THEN z
    WHEN 'bypass' THEN struct_update(b, closed := true)
    WHEN 'plan' THEN struct_update(b, plan := key, plan_seq := seq, plan_tokens := number)
    WHEN 'request' THEN struct_update(b, plan := CASE WHEN open THEN b.plan END, plan_seq := CASE WHEN open THEN b.plan_seq END, plan_tokens := CASE WHEN open THEN b.plan_tokens ELSE -1 END,
      predicted := CASE WHEN NOT open AND used IS NOT NULL AND done THEN b.plan_tokens ELSE b.predicted END,
      lane := CASE WHEN entered THEN list_append(b.lane, key) WHEN gone THEN list_filter(b.lane, lambda x: x <> key) ELSE b.lane END,
      estimated := coalesce(size, 0), floor := greatest(b.floor, coalesce(number, 0)), closed := b.closed AND number IS NULL)
    ELSE struct_update(b, turn := b.turn + 1, prefix := number + size, remaining := 0.3::DOUBLE * (b.turn + 1) + 0.7::DOUBLE * b.remaining,
      scale := CASE WHEN b.estimated > 0 AND number + size + place > 0 THEN CASE WHEN b.scale = 1.0::DOUBLE THEN (number + size + place)::DOUBLE / b.estimated::DOUBLE
                    ELSE 0.7::DOUBLE * b.scale + 0.3::DOUBLE * ((number + size + place)::DOUBLE / b.estimated::DOUBLE) END ELSE b.scale END,
      estimated := -1::BIGINT, predicted := -1::BIGINT, trips := b.trips + trip::INT, until := CASE WHEN trip THEN ms + {LIMITS.cooldown_ms} ELSE b.until END, "by" := CASE WHEN trip THEN seq ELSE b."by" END) END,
    used, entered, gone, shut, lost
  FROM (
    SELECT *, kind = 'request' AND NOT open AND key IS NOT NULL AND done AND NOT held AND covered IS DISTINCT FROM key AND NOT b.closed AND place >= b.floor AS entered,
      kind = 'request' AND NOT open AND key IS NOT NULL AND done AND held AND covered IS NOT DISTINCT FROM key AS gone,
      kind = 'usage' AND b.turn >= 1 AND NOT open AND ((number = 0 AND size = 0) OR (b.predicted >= 0 AND number > 4 * b.predicted)) AS trip
    FROM (
      SELECT *, ms < b.until AS open, CASE WHEN kind = 'request' AND ms >= b.until THEN b.plan_seq END AS used, b.plan AS covered, list_contains(b.lane, key) AS held
      FROM (
        SELECT ev.*, z, CASE WHEN s.by >= 0 AND ev.ms >= s.until THEN s.by END AS shut, CASE WHEN ev.ms >= s.last_at + {LIMITS.idle_ms} THEN s.last_seq END AS lost,
          struct_update(CASE WHEN ev.ms >= s.last_at + {LIMITS.idle_ms} THEN z WHEN s.by >= 0 AND ev.ms >= s.until THEN struct_update(s, "by" := -1::BIGINT) ELSE s END, last_at := ev.ms, last_seq := ev.seq) AS b
        FROM log JOIN ev ON ev.session_id = log.session_id AND ev.n = log.n + 1, zero)))),
fin AS (SELECT l.*, (SELECT max(ms) - 1000 FROM ev) AS water FROM log l JOIN (SELECT session_id, max(n) AS n FROM ev GROUP BY session_id) USING (session_id, n))
"""
SEEN = """SELECT session_id, seq, kind, s.turn AS turn, s.prefix AS prefix, round(s.remaining, 6) AS remaining, round(s.scale, 9) AS scale, ms >= s.until AS enabled, s.trips AS trips, s.floor AS floor, s.closed AS closed,
  used, s.plan_seq AS staged, len(s.lane) AS lane, entered, gone FROM log WHERE n > 0"""
TIMED = ("breaker_closed", "expired")


def seen(rows):
    rows = rows.where(~F.col("kind").isin(*TIMED))
    return rows.select(KEY, "seq", "kind", "turn", "prefix", E.to_digits("remaining", 6).alias("remaining"), E.to_digits("scale", 9).alias("scale"), "enabled", "trips", "floor", "closed", "used", "staged", "lane", "entered", F.col("left").alias("gone"))


def batch(spark, d):
    e = events(spark, d)
    return L.batch_log(e, e.agg((F.max("at") - 1000).alias("until")), LIMITS)


def streamed(spark, d):
    """The log of a stream that meets the events in three parts by time, and is started again for each."""
    e = events(spark, d)
    parts = [e.where(F.col("at") < 1_000_000), e.where(F.col("at").between(1_000_000, 2_499_999)), e.where((F.col("at") >= 2_500_000) | F.col("at").isNull())]
    return run_in_slices(spark, parts, lambda s: L.stream_log(s, limits=LIMITS), L.ROW, "append")


@query("session_log", LOG + SEEN)
def session_log(spark, d):
    return seen(batch(spark, d))


@query("stream_session_log", LOG + SEEN)
def stream_session_log(spark, d):
    return seen(streamed(spark, d)[0])


@query("calibration_taken", LOG + "SELECT session_id, seq, round(s.scale, 9) AS scale FROM log WHERE kind = 'usage'")
def calibration_taken(spark, d):
    """The token scale after each response: only the first after a request moves it."""
    return batch(spark, d).where("kind = 'usage'").select(KEY, "seq", E.to_digits("scale", 9).alias("scale"))


@query("fast_lane_window", LOG + "SELECT session_id, seq, s.floor AS floor, NOT s.closed AS reachable FROM log WHERE kind IN ('request', 'bypass', 'evict')")
def fast_lane_window(spark, d):
    """The floor of messages that were sent, and whether a leaf past it may enter the lane."""
    return batch(spark, d).where("kind in ('request', 'bypass', 'evict')").select(KEY, "seq", "floor", (~F.col("closed")).alias("reachable"))


@query("stream_plan_uses", LOG + "SELECT p.session_id, p.seq AS plan, count(u.used) AS uses FROM log p LEFT JOIN log u ON u.session_id = p.session_id AND u.used = p.seq WHERE p.kind = 'plan' GROUP BY ALL")
def stream_plan_uses(spark, d):
    """How many requests took each staged plan: one at most, whatever restarts there are."""
    rows = streamed(spark, d)[0]
    uses = rows.where("used is not null").groupBy(KEY, F.col("used").alias("plan")).agg(F.count(F.lit(1)).alias("n"))
    plans = rows.where("kind = 'plan'").select(KEY, F.col("seq").alias("plan"))
    return plans.join(uses, [KEY, "plan"], "left").select(KEY, "plan", F.coalesce("n", F.lit(0)).cast("long").alias("uses"))


@query("stream_lane_keys", LOG + f"SELECT session_id, unnest(s.lane) AS key FROM fin WHERE s.last_at + {LIMITS.idle_ms} > water")
def stream_lane_keys(spark, d):
    """What the stream's own state holds in the end: the keys of each session's lane."""
    log = streamed(spark, d)[1]
    held = spark.read.format("statestore").option("stateVarName", "lane").load(log)
    return held.select(F.col(f"key.{KEY}").alias(KEY), F.col("user_map_key.key").alias("key"))


@query(
    "stream_timers",
    LOG + f"""SELECT session_id, 'breaker_closed' AS kind, shut AS seq FROM log WHERE shut IS NOT NULL UNION ALL SELECT session_id, 'expired', lost FROM log WHERE lost IS NOT NULL
UNION ALL SELECT session_id, 'evict', seq FROM log WHERE kind = 'evict' UNION ALL SELECT session_id, 'breaker_closed', s.by FROM fin WHERE s.by >= 0 AND s.until <= water
UNION ALL SELECT session_id, 'expired', s.last_seq FROM fin WHERE s.last_at + {LIMITS.idle_ms} <= water""",
)
def stream_timers(spark, d):
    """Breakers that closed, sessions that were forgotten by time, and those that were evicted."""
    return streamed(spark, d)[0].where(F.col("kind").isin(*TIMED, "evict")).select(KEY, "kind", "seq")


# decisions by a model


def scripted():
    """A transport that answers by the hash of what it is asked, on a clock of its own for each call."""
    clock = threading.local()
    answer = lambda x: C.Answer(200, json.dumps({"content": [{"type": "text", "text": x}]}).encode())
    says = {
        0: '{"choice":"summarize","summary_content":"in short"}', 1: 'So:\n{"choice":"truncate","ranges_to_keep":[{"start":1,"end":2}]}\nDone.', 2: '{"choice":"compress"}',
        3: '{"choice":"summarize"}', 6: "I cannot say.", 7: '{"choice":"truncate"}',
    }

    def send(r: C.Request) -> C.Answer:
        content = json.loads(r.body)["messages"][0]["content"].split("<content>\n", 1)[1].removesuffix("\n</content>")
        case = int(hashlib.md5(content.encode()).hexdigest()[:8], 16) % 10
        clock.t = clock.__dict__.get("t", 0.0) + 1
        if case == 2 and r.attempt == 1:
            return C.Answer(429, retry_after="0")
        if case == 3 and r.attempt < 3:
            return C.Answer(529)
        if case == 4:
            return C.Answer(429, retry_after="soon")
        if case == 5:
            return C.Answer(500)
        if case == 8:
            return C.Answer(429, retry_after="200")
        if case == 9:
            raise C.CallFailed("unreachable")
        return answer(says[case])

    def sleep(s: float) -> None:
        clock.t += s

    return send, C.Clock(lambda: clock.__dict__.get("t", 0.0), sleep)


@query(
    "model_decisions",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT % 10 AS k FROM documents),
c AS (SELECT *, length(t) < 256 AS gated FROM d)
SELECT doc_id, CASE WHEN gated THEN 'gated' WHEN k IN (0, 1, 2, 3, 7) THEN 'ok' WHEN k = 4 THEN 'status 429' WHEN k = 5 THEN 'status 500' WHEN k = 6 THEN 'no json' WHEN k = 8 THEN 'timeout' ELSE 'unreachable' END AS outcome,
  CASE WHEN gated THEN 0 WHEN k = 2 THEN 2 WHEN k IN (3, 4) THEN 3 ELSE 1 END AS attempts,
  CASE WHEN gated THEN 'keep' WHEN k = 0 THEN 'summarize' WHEN k = 1 THEN 'truncate' WHEN k IN (2, 3) THEN 'compress' ELSE 'keep' END AS choice,
  md5(CASE WHEN gated OR k NOT IN (0, 1, 2, 3) THEN t WHEN k = 0 THEN 'in short' WHEN k = 1 THEN array_to_string(string_split(t, chr(10))[1:2], chr(10)) ELSE '' END) AS left_md5 FROM c""",
)
def model_decisions(spark, d):
    """Each document decided by a scripted model: limits, overload, errors, prose and silence among its answers."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    made = C.decided(docs, C.Client(scripted, model="any"), content="t")
    of = F.col("decision")
    lines = F.split("t", "\n")
    cut = F.array_join(F.flatten(F.transform(of["ranges_to_keep"], lambda r: F.slice(lines, r["start"], r["end"] - r["start"] + 1))), "\n")
    left = F.when(of["choice"] == "keep", F.col("t")).when(of["choice"] == "summarize", of["summary_content"]).when(of["choice"] == "truncate", cut).otherwise("")
    return made.select("doc_id", of["outcome"].alias("outcome"), of["attempts"].alias("attempts"), of["choice"].alias("choice"), F.md5(left.cast("binary")).alias("left_md5"))


def turns(spark, d):
    t = read(spark, d, "conversations")
    return t.select(F.col("conv_id").alias(KEY), "turn", F.concat_ws(":", "role", "turn").alias("message"), "text")


WORKING_SQL = """WITH t AS (SELECT conv_id AS session_id, turn, role, role || ':' || turn::VARCHAR AS message, coalesce(text, '') AS text, trim(regexp_extract(coalesce(text, ''), '^[^.\\n]*')) AS said FROM conversations),
g AS (SELECT *, role IN ('user', 'assistant') AND said <> '' AS good, regexp_extract(lower(said), '^[^ ,]*') AS topic FROM t),
w AS (SELECT *, CASE WHEN good THEN lead(message) OVER (PARTITION BY session_id, role, good, topic ORDER BY turn) END AS ended FROM g)
SELECT session_id, count(*) AS turns, count(*) FILTER (NOT good) AS failed,
  coalesce(string_agg(said || '|' || message || '|' || coalesce(ended, '-'), chr(10) ORDER BY turn) FILTER (good AND role = 'user'), '') AS constraints,
  coalesce(string_agg(said || '|' || split_part(text, chr(10), 1) || '|' || contains(said, ',')::VARCHAR || '|' || coalesce(ended, '-'), chr(10) ORDER BY turn) FILTER (good AND role = 'assistant'), '') AS decisions,
  CASE WHEN count(*) FILTER (good) > 0 THEN coalesce(arg_max(said, turn) FILTER (good AND role = 'user'), '') END AS task,
  CASE WHEN count(*) FILTER (good) > 0 THEN coalesce(arg_max(message, turn) FILTER (good AND role = 'assistant'), '') END AS last_safe_point,
  CASE WHEN count(*) FILTER (good) > 0 THEN 0 END AS n_files FROM w GROUP BY session_id"""


def told(states):
    s = F.col("state")
    none = F.lit("-")
    rules = F.transform(s["constraints"], lambda c: F.concat_ws("|", c["text"], c["source_message"], F.coalesce(c["superseded_by"], none)))
    made = F.transform(s["decisions"], lambda c: F.concat_ws("|", c["text"], c["rationale"], c["planned"].cast("string"), F.coalesce(c["superseded_by"], none)))
    flying = s["in_flight"]
    files = F.when(flying.isNotNull(), F.size(flying["open_files"]) + F.size(flying["skill_paths"]))
    return states.select(KEY, "turns", "failed", F.array_join(rules, "\n").alias("constraints"), F.array_join(made, "\n").alias("decisions"), flying["task"].alias("task"), flying["last_safe_point"].alias("last_safe_point"), files.alias("n_files"))


@query("working_state", WORKING_SQL)
def working_state(spark, d):
    return told(W.batch_states(turns(spark, d)))


@query("stream_working_state", WORKING_SQL)
def stream_working_state(spark, d):
    """The same, by a stream that meets the turns in three parts; the last state of each session."""
    t = turns(spark, d)
    parts = [t.where("turn < 1"), t.where("turn between 1 and 2"), t.where("turn > 2 or turn is null")]
    rows = run_in_slices(spark, parts, W.stream_states, W.ROW)[0]
    last = rows.groupBy(KEY).agg(F.max_by(F.struct("state", "turns", "failed"), "batch").alias("s")).select(KEY, "s.*")
    return told(W.with_state(last))


