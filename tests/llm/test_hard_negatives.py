"""Hard negatives against brute force, and on null, odd, repeated and clashing input."""

import random

import duckdb
import numpy as np
from harness import DATA, spark_rows, sql_rows
from pyspark.sql import functions as F

from driftloom.llm import hard_negatives as H
from driftloom.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, low=80, high=100, k=5):
    """rows: (id, vector or None, label or None)."""
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        held[i] = min(held.get(i, (str(label), q)), (str(label), q))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        scored = sorted((-score(v, w), i, other) for i, (other, w) in held.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            good = [(i, -t) for t, i, other in scored if other != label and low * -s <= 100 * -t <= high * -s][:k]
            out += [(a, p, r, i, -s, t) for r, (i, t) in enumerate(good, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def fixture():
    rng = random.Random(3)
    rows = [(i, [round(rng.uniform(-1, 1), 1) + 0.4 for _ in range(70)], rng.randrange(4)) for i in range(-100, 500)]
    hot = [0.5] * 70
    rows += [(1000 + i, hot, 1) for i in range(150)]  # ties: one vector many times
    rows += [(600, hot, 2), (600, hot, 1), (600, hot, 1), (700, [], 1), (701, [0.5] * 3, 2), (800, None, 1), (801, hot, None), (None, hot, 1), (802, [0.5, None], 1), (900, [float("nan")] * 70, 1), (901, [float("inf")], 2), (2000, [-1.0] * 70, 3)]
    return rows


def test_equals_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    got = rows_of(H.mine(df))
    assert len(want) > 100 and got == want


def test_many_small_shards(spark, monkeypatch):
    """Shards, chunks and cells of a few rows, and windows that are joined, give the same."""
    for name, value in {"ROWS": 7, "ANCHORS": 2, "CELL_ROWS": 3, "CELL_ANCHORS": 2, "BROADCAST_ANCHORS": 0}.items():
        monkeypatch.setattr(H, name, value)
    rows = fixture()[::2]
    got = rows_of(H.mine(spark.createDataFrame(rows, SCHEMA).repartition(2), every=50))
    assert got == brute(rows, every=50) and got


def test_blocks_are_never_broadcast(spark):
    """Their copies in all cells grow with the square of the table, and the driver would hold them."""
    df = spark.createDataFrame(fixture(), SCHEMA)
    rows = H.written(H.packed(H.partakers(df, "vec_id", "label", "embedding", 256), 64), "rows")
    tiles = H.partial_tiles(rows, rows, 3, 2)
    assert tiles.count() > 100
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_clashes_empties_and_too_large(spark):
    rows = fixture()[:200]
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.withColumns({c: F.lit("mine") for c in ("id", "shard", "chunk", "i", "j", "n", "vector", "part", "rank", "score", "group", "cell", "_j")})
    assert rows_of(H.mine(more)) == brute(rows)
    assert H.mine(df.limit(0)).count() == 0
    assert H.mine(df.where("vec_id % 100 <> 0")).count() == 0
    try:
        H.mine(spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)], SCHEMA)).collect()
        raise AssertionError("components beyond exact sums are an error")
    except Exception as e:
        assert "too large" in str(e)


def test_query_equals_sql_and_brute_force(spark):
    got = queries.op12_hard_negatives(spark, f"{DATA}/sf0.01")
    assert spark_rows(got) == sql_rows(queries.OP12_SQL, "sf0.01")
    rows = duckdb.sql(f"SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END FROM '{DATA}/sf0.01/embeddings.parquet'").fetchall()
    assert rows_of(got) == brute(rows)
