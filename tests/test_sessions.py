"""Segments, bodies, stored references and session state against plain models."""

import json
import random

from pyspark.sql import functions as F

from driftloom.operators import budget, scoring, segments
from driftloom.plans import passes
from driftloom.sources import refs, settings, wire
from driftloom.streaming import session_state as S

SCHEMA = "session_id long, msg_index long, role string, content_kind string, rendered string, raw_len long, use_ids array<string>, result_ids array<string>"


def model_segments(messages):
    out, generation, i, offset = [], 0, 0, 0
    while i < len(messages):
        m = messages[i]
        nxt = messages[i + 1] if i + 1 < len(messages) else None
        pair = m["role"] == "assistant" and nxt and nxt["role"] == "user" and set(m["use_ids"]) & set(nxt["result_ids"])
        used = [m, nxt] if pair else [m]
        kind = "tool_pair" if pair else {"assistant": "assistant_turn", "user": "user_turn", "system": "system"}[m["role"]]
        generation += kind == "user_turn"
        out.append((kind, generation, offset, kind == "assistant_turn" and bool(m["use_ids"]), [x["msg_index"] for x in used]))
        offset += sum(x["raw_len"] for x in used)
        i += len(used)
    kind, g, o, _, s = out[-1]
    return [*out[:-1], (kind, g, o, True, s)]


def test_segments_equal_a_sequential_walk(spark):
    rng, rows, want = random.Random(4), [], {}
    for sid in range(120):
        messages = []
        for i in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "user"])
            ids = lambda: [rng.choice("abc") for _ in range(rng.randint(0, 2))]
            messages.append({"session_id": sid, "msg_index": i, "role": role, "content_kind": "blocks", "rendered": "x" * rng.randint(0, 9), "raw_len": rng.randint(1, 9), "use_ids": ids() if role == "assistant" else [], "result_ids": ids() if role == "user" else []})
        rows += messages
        want[sid] = model_segments(messages)
    got = segments.segment_table(spark.createDataFrame(rows, SCHEMA)).orderBy("session_id", "seg_index").collect()
    found = {}
    for r in got:
        found.setdefault(r["session_id"], []).append((r["kind"], r["generation"], r["byte_offset"], r["pinned"], r["source_msgs"]))
    assert found == want


BODY = """{ "model":"m", "max_tokens": 100, "zeta": 1.10, "tools":[ {"name":"t"} ],
 "messages": [ {"role":"user","content":"hi é"},
  {"role":"assistant", "content": [ {"type":"thinking","thinking":"a  b"}, {"type":"tool_use","id":"u1","name":"run","input":{ "q": 1E6 }} ] },
  {"role":"user","content":[{"type":"tool_result","tool_use_id":"u1","content":"%s"}]} ] }""" % ("r" * 900)


def test_body_spans_are_verbatim():
    p = wire.parse_body(BODY)
    assert p["tools"] == '[ {"name":"t"} ]' and p["system"] is None
    blocks = p["messages"][1]["blocks"]
    assert blocks[1]["raw"] == '{"type":"tool_use","id":"u1","name":"run","input":{ "q": 1E6 }}' and blocks[1]["id"] == "u1"
    assert p["messages"][2]["blocks"][0]["text"] == "r" * 900
    for bad in ("", "[]", "{}", BODY[:-2], BODY.replace('"user"', '"owner"')):
        assert wire.parse_body(bad) is None
    assert wire.block_of('{"type":"tool_use","id":"a\\n","name":"n"}')["name"] is None


def test_splice_and_gate():
    target = [{"message": 2, "block": 0, "json": json.dumps({"type": "tool_result", "tool_use_id": "u1", "content": "short"})}]
    new, over = wire.splice(BODY, target, [2])
    assert over == 0 and '"zeta":1.10' in new and '{"type":"thinking","thinking":"a  b"}' in new and wire.gate(new, BODY) is None
    assert wire.splice(BODY, [target[0] | {"block": 4}], []) is None
    cases = {"reparse": new[:-1], "unpaired_tools": new.replace('"tool_use_id":"u1"', '"tool_use_id":"u2"'), "grew": BODY, "thinking_changed": new.replace("a  b", "a b"), "too_many_hints": new.replace('"short"', '"' + '\\"cache_control\\"' * 0 + 'short"').replace('"zeta":1.10', '"zeta":["cache_control","cache_control","cache_control","cache_control"]')}
    for why, body in cases.items():
        assert wire.gate(body, BODY) == why, why
    assert wire.gate(new.replace('"tools":', '"toolz":'), BODY) == "key_dropped"


def test_read_bodies_and_targets(spark):
    bodies = spark.createDataFrame([(1, BODY), (2, "junk"), (3, None)], "session_id long, body string")
    m = wire.read_bodies(bodies)
    s = segments.segment_table(m)
    assert [(r["seg_index"], r["kind"]) for r in s.orderBy("seg_index").collect()] == [(0, "tools"), (1, "user_turn"), (2, "tool_pair")]
    found = wire.replaceable_blocks(s, m).collect()
    assert [(r["seg_index"], r["msg_index"], r["block_index"], r["slot"], r["original_tokens"]) for r in found] == [(2, 2, 0, "tool_result", 258)]


def test_drop_ladder_order(spark):
    kinds = ["system", "user_turn", "tool_pair", "tool_pair", "assistant_turn", "user_turn"]
    rows = [(1, i, k, 100, False, i == 5, False, None) for i, k in enumerate(kinds)]
    s = spark.createDataFrame(rows, "session_id long, seg_index long, kind string, token_estimate long, pinned boolean, is_current boolean, salient boolean, shed long")
    out = budget.drop_ladder(s, F.lit(350)).orderBy("rung", "seg_index").collect()
    assert [(r["rung"], r["seg_index"]) for r in out] == [(2, 2), (2, 3), (3, 1)]


def test_decision_repair(spark):
    rows = [("truncate", 0, None), ("truncate", 2, None), ("summarize", 0, ""), ("summarize", 0, None), ("keep", 0, None)]
    df = spark.createDataFrame(rows, "c string, n int, s string").select(scoring.repaired(F.col("c"), F.col("n"), F.col("s")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["keep", "truncate", "compress", "compress", "keep"]


def test_put_and_collect_garbage(spark):
    schema = "ref_id string, byte_len long, token_estimate long, source_uuid string, session_id string, kind string, created_at double, last_access_at double, access_count long, pinned boolean"
    rng = random.Random(5)
    rows = [(f"r{i}", rng.randint(1, 50), 1, f"m{i}", "s", "k", float(rng.randint(0, 100)), float(rng.randint(0, 9)), 0, rng.random() < 0.1) for i in range(80)]
    store = spark.createDataFrame(rows, schema)
    reachable = {f"r{i}" for i in range(0, 80, 9)}
    loose = [r for r in rows if not r[9] and r[0] not in reachable]
    live, gone = sum(r[1] for r in loose), []
    for r in sorted((r for r in loose if 700.0 - r[6] > 640), key=lambda r: (r[7], r[0])):
        if live > 300:
            gone.append(r[0])
            live -= r[1]
    out = refs.collect_garbage(store, spark.createDataFrame([(x,) for x in reachable], "ref_id string"), now=700.0, grace=640.0, most=300)
    assert sorted(r["ref_id"] for r in out.collect()) == sorted(gone)
    new = spark.createDataFrame([("r1", 1, 1, "z", "s", "k", 1.0, 1.0, 0, False), ("n", 1, 1, "b", "late", "k", 2.0, 1.0, 0, False), ("n", 1, 1, "a", "early", "k", 1.0, 1.0, 0, False)], schema)
    assert [(r["ref_id"], r["session_id"]) for r in refs.put(store, new).collect()] == [("n", "early")]


def test_breaker_and_scale():
    s = S.State()
    for at, creation, read, estimated in ((0.0, 0, 0, 100), (1.0, 0, 0, None), (30.0, 0, 0, None), (61.0, 5, 5, 20), (62.0, 0, 0, None)):
        s = S.observed(s, at, creation, read, 10, estimated, None, 3)
    assert (s.turn, s.trips, s.open_until, s.floor) == (5, 2, 122.0, 3)
    assert abs(s.scale - (0.7 * 0.1 + 0.3 * 1.0)) < 1e-12


def test_plan_reverts_twice_at_most(spark):
    seen = []

    def note(name):
        return passes.Pass(name, lambda df: (seen.append(name), df)[1], passes.ON_PATH)

    plan = passes.Plan() >> passes.Checkpoint("start") >> note("a") >> note("b")
    plan.run(spark.range(1), revert=lambda name, df: "start" if name == "b" else "unknown")
    assert seen == ["a", "b"] * 3
    assert len((plan >> passes.Pass("off", lambda d: d)).on_path().stages) == 3


def test_settings(tmp_path):
    (tmp_path / "s.toml").write_text("schema_version = 1\n[policy]\nrecency_window_n = 5\n")
    assert settings.from_toml(str(tmp_path / "s.toml")).policy.recency_window_n == 5
    for bad in ({}, {"schema_version": 1, "x": 1}, {"schema_version": 1, "policy": {"y": 1}}):
        try:
            settings.from_mapping(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_ref_store(spark, tmp_path):
    store = refs.RefStore(spark, str(tmp_path / "store"))
    rows = [(bytearray(b"alpha beta\ngamma\nbeta"), "m1", "s1", "k", 1.0), (bytearray(b"alpha beta\ngamma\nbeta"), "m0", "s2", "k", 5.0), (bytearray(b"other"), "m2", "s1", "k", 2.0)]
    store.put(spark.createDataFrame(rows, "original binary, source_uuid string, session_id string, kind string, created_at double"))
    held = {r["source_uuid"]: r["ref_id"] for r in store.rows().collect()}
    assert set(held) == {"m1", "m2"}  # the first writer of an address wins
    assert store.retrieve("s2", held["m1"], now=9.0) is None
    assert store.retrieve("s1", held["m1"], now=9.0) == "alpha beta\ngamma\nbeta"
    assert store.retrieve("s1", held["m1"], now=8.0, query="gamma") == "gamma"
    counted = store.rows().where(F.col("ref_id") == held["m1"]).first()
    assert (counted["access_count"], counted["last_access_at"]) == (2, 9.0)
    assert [r["ref_id"] for r in refs.hot_refs(store.rows()).collect()] == [held["m1"]]
    store.pin(held["m1"])
    store.collect(spark.createDataFrame([], "ref_id string"), now=9_999.0, grace=1.0, most=0)
    assert [r["source_uuid"] for r in store.rows().collect()] == ["m1"]


def test_summarizer_folds_and_summarises(spark):
    from driftloom.operators.summarizer import Extractive

    df = spark.sql("select named_struct('in_flight', 'old', 'x', 1) as state, array('a', 'fix it\nnow') as turns, cast(array() as array<string>) as none")
    out = df.select(Extractive().fold(F.col("state"), F.col("turns")).alias("a"), Extractive().fold(F.col("state"), F.col("none")).alias("b")).first()
    assert (out["a"]["in_flight"], out["b"]["in_flight"], out["a"]["x"]) == ("fix it", "old", 1)
    text = "first line\n" + "word " * 80 + "extraordinary\nlast line"
    d = spark.createDataFrame([(text,)], "t string").select(Extractive().decide(F.col("t"), F.expr("cast(array() as array<string>)")).alias("d")).first()["d"]
    assert d["choice"] == "summarize" and d["summary_content"].startswith("first line\nabout: extraordinary") and d["summary_content"].endswith("last line")


def test_usage_needs_its_model_and_all_counts(spark):
    from driftloom.sources import events

    full = '{"message":{"model":"m","usage":{"input_tokens":1,"cache_creation_input_tokens":2,"cache_read_input_tokens":3}}}'
    start = "event: message_start\n"
    cases = {
        f"{start}data: {full}\n": ("m", 2, 3, 1),
        f"event:message_start\r\ndata:{full}\r\n": ("m", 2, 3, 1),
        f"{start}data: {{}}\ndata: {full.replace('m', 'm', 1)}": ("m", 2, 3, 1),
        f"{start}data: {full.replace('model', 'other')}\n": None,
        f"{start}data: {full.replace('input_tokens', 'output', 1)}\n": None,
        f"event: ping\ndata: {full}\n": None,
        f"{start}event: ping\ndata: {full}\n": None,
        f"x{start}data: {full}\n": None,
        ": " + "é" * 32_600 + f"\n{start}data: {full}\n": ("m", 2, 3, 1),
        ": " + "é" * 32_760 + f"\n{start}data: {full}\n": None,  # past the cap in bytes, not in characters
        "": None,
        None: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, body string")
    out = {r["k"]: r["u"] for r in df.select("k", events.usage(F.col("body")).alias("u")).collect()}
    assert [tuple(out[k]) if out[k] else None for k in range(len(cases))] == list(cases.values())


def test_store_appends(spark, tmp_path):
    store = refs.RefStore(spark, str(tmp_path / "store"))
    put = lambda *texts: store.put(spark.createDataFrame([(bytearray(t.encode()), t, "s", "k", 1.0) for t in texts], "original binary, source_uuid string, session_id string, kind string, created_at double"))
    put("a", "b")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("originals/*.parquet")}
    ref = store.rows().where("source_uuid = 'a'").first()["ref_id"]
    store.retrieve("s", ref, now=3.0)
    store.pin(ref)
    store.pin(ref, False)
    put("a", "c")
    assert all(p.stat().st_mtime_ns == t for p, t in files.items()) and store.generation() == 1
    assert {(r["source_uuid"], r["access_count"], r["pinned"]) for r in store.rows().collect()} == {("a", 1, False), ("b", 0, False), ("c", 0, False)}
    store.pin(ref)
    for _ in range(3):
        store.collect(spark.createDataFrame([], "ref_id string"), now=99.0, grace=1.0, most=1)
    left = {r["source_uuid"] for r in store.rows().collect()}
    assert len(left) == 2 and "a" in left and store.generations() == [3, 4]
    put("a", "b", "c")
    assert store.rows().count() == 3
