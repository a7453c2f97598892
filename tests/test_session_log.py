"""The keyed state of a session: hand-off, calibration, lane, window, breaker and eviction."""

import random

import duckdb
from harness import rows_of, spark_rows

from driftloom.plans import event_queries
from driftloom.streaming import session_log as L
from driftloom.streaming.slices import run_in_slices

LIMITS = L.Limits(cooldown_ms=60_000, idle_ms=500_000)
NAMES = [x.split()[0] for x in L.EVENT.split(", ")]


def run(events, limits=LIMITS):
    """events: (at, kind, {fields}); gives the final state, the lane and all rows as dictionaries."""
    s, lane, out = L.Session(), set(), []
    for seq, (at, kind, more) in enumerate(events):
        e = L.Event(seq, at, kind, *(more.get(k) for k in ("number", "size", "place", "key", "done")))
        s, rows = L.step(7, s, lane, e, limits)
        out += [dict(zip(L.COLUMNS, r, strict=True)) for r in rows]
    return s, lane, out


def request(number=1, size=100, key=None, place=None, done=True):
    return "request", {"number": number, "size": size, "key": key, "place": place, "done": done}


def usage(creation=10, read=0, fresh=0):
    return "usage", {"number": creation, "size": read, "place": fresh}


def test_a_plan_is_taken_once():
    _, _, out = run([(0, "plan", {"key": "a", "number": 5}), (1, "plan", {"key": "b", "number": 6}), (2, *request()), (3, *request()), (4, "plan", {"key": "c", "number": 1}), (5, *request(done=False)), (6, *request())])
    assert [r["used"] for r in out] == [None, None, 1, None, None, 4, None]


def test_an_open_breaker_leaves_the_plan():
    s, _, out = run([(0, *usage()), (1, *usage(0, 0)), (2, "plan", {"key": "a", "number": 5}), (3, *request()), (60_001, *request())])
    assert [r["kind"] for r in out] == ["usage", "usage", "plan", "request", "breaker_closed", "request"]
    assert [r["used"] for r in out if r["kind"] == "request"] == [None, 2] and out[4]["seq"] == 1 and s.trips == 1
    assert [r["enabled"] for r in out] == [True, False, False, False, True, True]


def test_calibration_and_prediction_are_taken_once():
    s, _, out = run([(0, *request(size=100)), (1, *usage(150, 0, 50)), (2, *usage(400, 0, 0)), (3, *request(size=0)), (4, *usage(400)), (5, *request(size=None)), (6, *usage(400)), (7, *request(size=200)), (8, *usage(100))])
    assert [round(r["scale"], 6) for r in out if r["kind"] == "usage"] == [2.0, 2.0, 2.0, 2.0, 1.55]
    plan = (0, "plan", {"key": "a", "number": 10})
    trips = lambda events: run(events)[0].trips
    assert trips([plan, (1, *request()), (2, *usage(41)), (3, *usage(41))]) == 0  # the first turn never trips
    assert trips([(0, *usage()), plan, (1, *request()), (2, *usage(40)), (3, *usage(41))]) == 0
    assert trips([(0, *usage()), plan, (1, *request()), (2, *usage(41))]) == 1
    assert trips([(0, *usage()), plan, (1, *request(done=False)), (2, *usage(41))]) == 0


def test_lane_entry_needs_an_open_window_an_unsent_leaf_and_no_plan():
    first = (0, *request(number=3))
    entered = lambda events: [r["entered"] for r in run(events)[2]]
    assert entered([(0, *request(key="k", place=9))]) == [False]  # the window is closed at birth
    assert entered([first, (1, *request(number=4, key="k", place=3)), (2, *request(number=4, key="k", place=9))]) == [False, True, False]
    assert entered([first, (1, *request(key="k", place=2))])[1] is False  # sent before
    assert entered([first, (1, "bypass", {}), (2, *request(key="k", place=9)), (3, *request(key="k", place=9))]) == [False, False, False, True]
    assert entered([first, (1, *request(key="k", place=9, done=False))])[1] is False
    assert entered([first, (1, "plan", {"key": "k"}), (2, *request(key="k", place=9)), (3, *request(key="k", place=9))]) == [False, False, False, True]
    s, lane, out = run([first, (1, *request(key="k", place=9)), (2, "plan", {"key": "k"}), (3, *request(key="k", place=0, done=False)), (4, "plan", {"key": "k"}), (5, *request(key="k", place=0))])
    assert [r["left"] for r in out][-3:] == [False, False, True] and not lane and s.lane == 0


def test_floor_is_monotone_and_an_unreadable_request_changes_nothing():
    _, _, out = run([(0, *request(number=None)), (1, *request(number=5)), (2, *request(number=2)), (3, "bypass", {}), (4, *request(number=None)), (5, *request(number=1))])
    assert [(r["floor"], r["closed"]) for r in out] == [(0, True), (5, False), (5, False), (5, True), (5, True), (5, False)]


def test_eviction_and_idleness_start_afresh():
    s, lane, out = run([(0, *request(number=3)), (1, *request(key="k", place=9)), (2, *usage()), (3, "evict", {}), (4, *usage())])
    assert s.turn == 1 and not lane and out[3]["turn"] == 0 and out[3]["closed"] and out[4]["turn"] == 1
    s, lane, out = run([(0, *request(number=3)), (1, *request(key="k", place=9)), (2, *usage()), (500_001, *usage()), (1_000_001, *usage())])
    assert [r["kind"] for r in out] == ["request", "request", "usage", "usage", "expired", "usage"] and s.turn == 1 and not lane
    assert out[4]["seq"] == 3
    assert run([(0, *usage()), (1, *usage(0, 0)), (2, "evict", {}), (70_000, *usage())])[2][-1]["kind"] == "usage"  # no closing of a lost breaker


def test_batch_equals_a_walk_with_odd_rows(spark):
    rng, rows = random.Random(8), []
    for seq in range(600):
        kind = rng.choice(["request", "usage", "usage", "plan", "bypass", "evict" if rng.random() < 0.1 else "request"])
        maybe = lambda n: None if rng.random() < 0.2 else rng.randrange(n)
        rows.append((rng.randrange(9), seq, rng.randrange(3_000_000), kind, maybe(9), maybe(300), maybe(12), rng.choice([None, "a", "b"]), rng.choice([None, True, True, False])))
    rows += [(None, 1, 1, "usage", 1, 1, 1, None, None), (3, 1, None, "usage", 1, 1, 1, None, None), rows[0]]
    df = spark.createDataFrame(rows, L.EVENT).repartition(3)
    water = spark.createDataFrame([(2_900_000,)], "until long")
    got = sorted((r["session_id"], r["seq"], r["kind"], str(tuple(r))) for r in L.batch_log(df, water, LIMITS).collect())
    want = []
    for session in range(9):
        s, lane = L.Session(), set()
        for r in sorted((r for r in rows if r[0] == session and r[2] is not None), key=lambda r: (r[2], r[1])):
            s, out = L.step(session, s, lane, L.Event(r[1], r[2], *r[3:]), LIMITS)
            want += out
        s, out = L.closes(session, s, 2_900_000)
        want += out + ([L.row(session, L.Session(), s.last_seq, s.last_at, "expired")] if L.expired(s, 2_900_000, LIMITS) else [])
    assert [x[3] for x in got] == [x[3] for x in sorted((r[0], r[1], r[2], str(r)) for r in want)]
    assert L.batch_log(df.limit(0), water, LIMITS).count() == 0


class Counted:
    """A map state that counts what is asked of it."""

    def __init__(self, *keys):
        self.held, self.calls = set(keys), []

    def keys(self):
        self.calls.append("keys")
        return iter([(k,) for k in self.held])

    def containsKey(self, key):
        self.calls.append("contains")
        return key[0] in self.held

    def updateValue(self, key, value):
        self.calls.append("update")
        self.held.add(key[0])

    def removeKey(self, key):
        self.calls.append("remove")
        self.held.discard(key[0])


def test_a_lane_is_read_once_and_its_changes_written_once():
    """Every call is a round trip to the JVM: they are not as many as the events."""
    state = Counted("a", "b")
    lane = L.Lane(state, 2)
    for _ in range(100):
        assert "a" in lane and "c" not in lane
        lane.add("c")
        lane.discard("c")
    lane.discard("a")
    lane.add("d")
    lane.write()
    assert sorted(state.calls) == ["keys", "remove", "update"] and state.held == {"b", "d"}
    empty = Counted()
    lane = L.Lane(empty, 0)
    assert "a" not in lane
    lane.write()
    assert empty.calls == []


def test_timers_follow_from_the_state():
    s = L.Session(last_at=100, open_until=700, tripped_by=3)
    assert L.due(s, LIMITS) == {500_100, 700} and L.due(L.closes(7, s, 700)[0], LIMITS) == {500_100} and L.due(L.Session(), LIMITS) == set()


def test_a_stream_takes_events_at_and_before_zero(spark):
    """Its watermark starts at 0, which the first events are not later than; its timers fire there too."""
    rows = [(k, 10 * k + i, at, *e) for k in range(3) for i, (at, *e) in enumerate([
        (-900_000, "usage", 10, 0, 1, None, None), (-899_999, "usage", 0, 0, 1, None, None), (k - 1, "request", 3, 100, 5, None, True), (0, "plan", 5, None, None, "a", None), (70_000, "request", 4, 90, 6, "b", True),
    ])]
    rows.append((9, 99, 2_000_000, "bypass", None, None, None, None, None))
    df = spark.createDataFrame(rows, L.EVENT)
    water = spark.createDataFrame([(1_999_000,)], "until long")
    got = run_in_slices(spark, [df.where("at < 0"), df.where("at >= 0")], lambda s: L.stream_log(s, limits=LIMITS), L.ROW, "append")[0].drop("batch")
    want = spark_rows(L.batch_log(df, water, LIMITS))
    assert spark_rows(got) == want and len(want) == len(rows) + 3 + 6


def test_log_equals_sql_from_the_first_event_on_and_near_halves(spark, tmp_path):
    """An event in the first 0.6 s is at 0; 0.7 * 90 / 512 + 0.3 * 7 / 512 is 0.1271484375, which SQL rounds down."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT k::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(us::BIGINT) AS ts, u::BIGINT AS user_id, type AS event_type, v::DOUBLE AS value, '{}' AS props FROM (VALUES
      (0, 0, 1, 'error', 1.5), (1, 0, 2, 'click', 2.5), (2, 599999, 2, 'view', 3.5), (3, 600000, 1, 'signup', 4.5), (4, 1200000000000, 2, 'click', 5.5),
      (462, 1200000600000, 3, 'click', 1.0), (463, 1200001200000, 3, 'purchase', 8.1), (962, 1200001800000, 3, 'click', 1.0), (963, 1200002400000, 3, 'view', 3.0)) AS t(k, us, u, type, v)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    for name in ("session_log", "stream_session_log", "calibration_taken"):
        out = con.execute(event_queries.ORACLES[name])
        want = rows_of([c[0] for c in out.description], out.fetchall())
        assert spark_rows(event_queries.QUERIES[name](spark, str(tmp_path))) == want and "0.127148437" in str(want), name
