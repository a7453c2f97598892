"""Control frames that grow, retrieval in SQL, and the status snapshot."""

import json
import os
import random
import stat

import pytest
from pyspark.sql import functions as F

from driftloom.operators.search import search_within
from driftloom.sources import control, retrieval, status

GOOD = [
    ({"type": "register", "protocol": 1, "port": 1, "mcp_port": 2, "version": "a", "pid": 3}, None), ({"type": "mint", "protocol": 1, "token": "t", "config": {}}, None), ({"type": "evict", "protocol": 1, "token": "t"}, None), ({"type": "gc", "protocol": 1}, None),
    ({"type": "shadow", "protocol": 1, "on": False}, None), ({"type": "mint", "protocol": 1, "token": "", "config": {}}, "bad value"), ({"type": "mint", "protocol": 1, "token": "t", "config": []}, "bad value"), ({"type": "register", "protocol": 1, "port": 0, "mcp_port": 2, "version": "a", "pid": 3}, "bad value"),
    ({"type": "kill", "protocol": 1, "on": 1}, "bad value"), ({"type": "kill", "protocol": 1}, "other fields"), ({"type": "gc", "protocol": 1, "more": 1}, "other fields"), ({"type": "gc", "protocol": 2}, "other protocol"), ({"type": "gc", "protocol": True}, "other protocol"), ({"type": "gc", "protocol": 1.0}, "other protocol"), ({"type": "gc"}, "other protocol"), ({"type": "what", "protocol": 1}, "unknown type"), ({"protocol": 1}, "unknown type"), ({"type": ["gc"], "protocol": 1}, "unknown type"), ([], "no object"),
]


def test_frames_are_read_strictly():
    for frame, error in GOOD:
        assert control.parsed(json.dumps(frame).encode())[4] == error, frame
    for line in (b'{"type": "gc", "protocol": 1} {}', b"", b"\xff", b"{"):
        assert control.parsed(line)[4] == "no json"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("file", "pos", "kind", "token", "on", "config", "error").collect())


def test_growing_files_in_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(control.ControlFrames)
    folder, out = tmp_path / "in", tmp_path / "out"
    os.makedirs(folder / "sub")
    (folder / "_hidden").write_text('{"type": "gc", "protocol": 1}\n')

    def add(name, text):
        with open(folder / name, "ab") as f:
            f.write(text)

    def step():
        save = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/rows/batch={k}")
        spark.readStream.format("control_frames").load(str(folder)).writeStream.option("checkpointLocation", str(out / "log")).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
        return rows_of(spark.read.schema(control.FRAME).parquet(f"{out}/rows"))

    def batch():
        return rows_of(spark.read.format("control_frames").load(str(folder)))

    gc, kill = b'{"type": "gc", "protocol": 1}', b'{"type": "kill", "protocol": 1, "on": true}'
    long = json.dumps({"type": "mint", "protocol": 1, "token": "t", "config": {"é": "x" * 150_000}}).encode()
    add("a", gc + b"\n" + kill + b"\n" + gc[:10])
    add("sub/b", b"torn from the start")
    assert batch() == step() == [("a", 0, "gc", None, None, None, None), ("a", len(gc) + 1, "kill", None, True, None, None)]
    add("a", gc[10:] + b"\n\n" + long)  # the torn line is finished; an empty line is none; the next is torn
    add("sub/b", b"\n" + kill + b"\n")
    add("c", b"")
    second = batch()
    assert step() == second and [(r[0], r[2], r[6]) for r in second] == [("a", "gc", None), ("a", "kill", None), ("a", "gc", None), ("sub/b", None, "no json"), ("sub/b", "kill", None)]
    add("a", b"\n" + gc + b"\n")
    third = batch()
    assert step() == third and len(third) == 7
    assert [r for r in third if r[2] == "mint"] == [("a", 2 * len(gc) + len(kill) + 4, "mint", "t", None, json.dumps({"é": "x" * 150_000}, ensure_ascii=False), None)]
    assert step() == third
    assert [(r[0], r[2]) for r in rows_of(spark.read.format("control_frames").load(str(folder / "a")))] == [("a", "gc"), ("a", "kill"), ("a", "gc"), ("a", "mint"), ("a", "gc")]
    assert spark.read.format("control_frames").load(str(tmp_path / "nowhere")).count() == 0


def test_a_connection_ends_with_a_bad_frame_or_a_shutdown(spark):
    rows = [("a", 0, "gc", None), ("a", 9, None, "no json"), ("a", 12, "kill", None), ("b", 0, "gc", None), ("b", 5, "shutdown", None), ("b", 9, "gc", None), ("c", 0, None, "no json"), ("d", 3, "evict", None)]
    df = spark.createDataFrame(rows, "file string, pos long, kind string, error string")
    assert sorted((r["file"], r["kind"]) for r in control.in_force(df).collect()) == [("a", "gc"), ("b", "gc"), ("b", "shutdown"), ("d", "evict")]


def test_retrieval_in_sql_equals_the_dataframe(spark):
    rng = random.Random(6)
    words = ["cat", "Dog", "bird", "naïve", "x1", "the", "of"]
    text = lambda: rng.choice(["\n", " ", "\r\n"]).join(rng.choices(words, k=rng.randint(0, 120)))
    kept = [(f"r{k}", f"s{k % 4}", text()) for k in range(40)] + [("r0", "s9", "of another session"), ("r41", "s1", None)]
    calls = [(k, f"r{rng.randrange(45)}", f"s{rng.randrange(4)}", rng.choice([None, "", "cat dog", "cat cat bird", "zebra", "THE of"])) for k in range(200)] + [(500, None, "s1", "cat"), (501, "r1", None, "cat"), (502, "r0", "s0", "bird")]
    spark.createDataFrame(kept, "ref_id string, session_id string, doc string").createOrReplaceTempView("test_kept")
    spark.createDataFrame(calls, "id int, ref_id string, session_id string, query string").createOrReplaceTempView("test_calls")
    retrieval.register(spark, "test_kept")
    got = {r["id"]: r["found"] for r in spark.sql("SELECT c.id, f.found FROM test_calls c LEFT JOIN LATERAL stored(c.ref_id, c.session_id) o JOIN LATERAL found_in(o.doc, c.query) f").collect()}
    held = {(r, s): d for r, s, d in kept}
    searched = spark.createDataFrame([(k, held[(r, s)], q) for k, r, s, q in calls if held.get((r, s)) is not None and q is not None], "id int, doc string, query string")
    want = {k: held.get((r, s)) if held.get((r, s)) is not None else retrieval.HINT for k, r, s, _ in calls}
    want |= {r["id"]: r["found"] for r in search_within(searched).collect()}
    assert len(got) == len(calls) and got == want
    assert sum(v == retrieval.HINT for v in got.values()) > 50 and searched.count() > 20
    ranked = spark.sql("SELECT p.* FROM VALUES ('a cat\nno\ncat cat', 'cat'), (NULL, 'cat'), ('x', NULL), ('x', 'y') AS t(doc, query) JOIN LATERAL ranked_in(t.doc, t.query) p").collect()
    assert [(r["nth"], r["idx"], r["passage"]) for r in ranked] == [(1, 2, "cat cat"), (2, 0, "a cat")]


def test_snapshot_is_observed_published_and_read_strictly(spark, tmp_path):
    path = str(tmp_path / "status.json")
    df, seen = status.observing(spark.range(1_000).where("id % 3 = 0"), n=F.count(F.lit(1)), most=F.max("id"))
    assert df.where("id > 5").count() == 332
    fields = {"n": int, "most": int}
    status.publish(spark, path, seen.get)
    assert status.snapshot(spark, path, fields) == {"n": 334, "most": 999}
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    status.publish(spark, path, {"n": 1, "most": 2})
    assert status.snapshot(spark, path, fields) == {"n": 1, "most": 2} and [x for x in os.listdir(tmp_path) if not x.endswith(".crc")] == ["status.json"]
    for asked in ({"n": int}, fields | {"x": int}, {"n": int, "most": str}):
        with pytest.raises(ValueError):
            status.snapshot(spark, path, asked)
    for text in ('{"schema_version": 2, "n": 1, "most": 2}', '{"n": 1, "most": 2}', '{"schema_version": 1, "n": true, "most": 2}', "[]", "{"):
        for name in (path, str(tmp_path / ".status.json.crc")):
            if os.path.exists(name):
                os.unlink(name)
        with open(path, "w") as f:
            f.write(text)
        with pytest.raises(ValueError):
            status.snapshot(spark, path, fields)
    with pytest.raises(ValueError):
        status.publish(spark, path, {"schema_version": 3})


def test_what_becomes_of_a_request(spark):
    from driftloom.operators import relay

    rows = [(1, "x" * 11, "new", False, False), (2, "x" * 5, "new", True, False), (3, "x" * 9, "new", False, False), (4, "x" * 5, None, False, True), (5, "xxxxx", "new", False, True), (6, "xxxxx", "é", False, False), (7, None, "new", None, None), (8, "x" * 11, "new", True, True), (9, "x" * 8, "n", None, None), (10, "x" * 10, "n", False, False)]
    df = spark.createDataFrame(rows, "id int, b string, r string, k boolean, s boolean")
    log = relay.relayed(df, F.col("b"), F.col("r"), F.col("k"), F.col("s"), most=10, most_rewrite=8)
    got = {r["id"]: (r["status"], r["outcome"], r["forwarded"], r["bytes_in"], r["bytes_out"]) for r in log.collect()}
    assert got == {
        1: (502, "refused", None, 11, 0), 2: (200, "killed", "x" * 5, 5, 5), 3: (200, "passed", "x" * 9, 9, 9), 4: (200, "kept", "x" * 5, 5, 5), 5: (200, "shadow", "x" * 5, 5, 5),
        6: (200, "rewritten", "é", 5, 2), 7: (200, "rewritten", "new", 0, 3), 8: (502, "refused", None, 11, 0), 9: (200, "rewritten", "n", 8, 1), 10: (200, "passed", "x" * 10, 10, 10),
    }
    assert {r["outcome"]: r["requests"] for r in relay.totals(log).collect()} == {"refused": 2, "killed": 1, "passed": 2, "kept": 1, "shadow": 1, "rewritten": 3}
    assert sum(r["requests"] for r in relay.totals(log.limit(0)).collect()) == 0
