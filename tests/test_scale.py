"""What keeps the work in proportion: inputs read once, and Python objects of one chunk at a time."""

import tracemalloc

import pyarrow as pa
from harness import DATA

from driftloom import scratch
from driftloom.operators import search
from driftloom.plans import body_queries, pass_queries, passes
from driftloom.sources import wire


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_read_once(spark):
    for name in ("tool_names", "squash_targets", "reasoning_shed", "fallback_rungs"):
        assert "MapInArrow" not in plan(body_queries.QUERIES[name](spark, f"{DATA}/sf0.001")), name


def test_passes_are_run_once(spark, monkeypatch):
    """Neither a filter on their result nor its second reader repeats them."""
    made = []
    monkeypatch.setattr(passes, "written", lambda df, label: made.append(plan(df)) or scratch.written(df, label))
    for name, most in (("fast_lane", 12), ("recode_chain", 150)):
        made.clear()
        assert plan(pass_queries.QUERIES[name](spark, f"{DATA}/sf0.001")).count("minify_udf") == 0, name
        assert len(made) == 1 and made[0].count("minify_udf(") == 1 and made[0].count("regexp_replace") <= most, name


def peak(f, *columns):
    tracemalloc.start()
    out = f(*columns)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, held


def test_functions_hold_a_chunk_of_a_batch():
    """20 MB of texts in one batch are not 20 MB of Python strings."""
    text = "word " * 2_000
    scores, held = peak(search.scores_udf.func, pa.array([[text[:5_000], text[5_000:]]] * 2_000), pa.array(["word"] * 2_000))
    assert len(scores) == 2_000 and all(len(x) == 2 for x in scores.to_pylist()) and held < 8 << 20
    body = '{"model":"m","max_tokens":1,"messages":[{"role":"user","content":"%s"}]}' % text
    none = pa.array([None] * 2_000, pa.list_(pa.int32()))
    made, held = peak(wire.rewrite_udf.func, pa.array([body] * 2_000), pa.array([[]] * 2_000, pa.list_(pa.null())), none)
    assert len(made) == 2_000 and set(made.field("error").to_pylist()) == {"grew"} and held < 8 << 20
