"""Prices worked out by hand."""

import pytest
from pyspark.sql import functions as F

from driftloom.functions import economics as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("w", "ttl", "now", "bust", "turns"),
    [(2.0, 3600.0, 0.0, 0.019, 38.0), (2.0, 3600.0, 1800.0, 0.0095, 38.0), (1.25, 300.0, 0.0, 0.0115, 23.0)],
)
def test_bust_and_break_even(spark, w, ttl, now, bust, turns):
    lit = F.lit
    alive, cold = E.p_alive(lit(0.0), lit(ttl), lit(now)), E.is_cold(lit(0.0), lit(ttl), lit(now))
    assert one(spark, E.bust_cost(lit(2000), lit(5e-6), lit(w), lit(0.1), alive, cold)) == pytest.approx(bust)
    assert one(spark, E.break_even_turns(lit(2000), lit(1000), lit(w), lit(0.1), cold)) == pytest.approx(turns)


def test_saving_and_sign_of_npv(spark):
    lit = F.lit
    assert one(spark, E.recurring_saving(lit(1.0), lit(1000), lit(5e-6), lit(0.1))) == pytest.approx(0.0005)
    for n, positive in ((40.0, True), (30.0, False)):
        value = one(spark, E.npv(E.recurring_saving(lit(n), lit(1000), lit(5e-6), lit(0.1)), lit(0.0), lit(0.019)))
        assert (value > 0) is positive


def test_cold_is_inclusive_and_free(spark):
    lit = F.lit
    assert one(spark, E.is_cold(lit(0.0), lit(300.0), lit(300.0))) is True
    assert one(spark, E.bust_cost(lit(9), lit(1.0), lit(2.0), lit(0.1), lit(1.0), lit(True))) == 0.0
    assert one(spark, E.break_even_turns(lit(9), lit(0), lit(2.0), lit(0.1), lit(False))) == float("inf")


@pytest.mark.parametrize(
    ("n", "floor", "cold", "free", "npv", "want"),
    [(0, True, True, True, 1.0, "hold:warm_deep"), (1, True, True, True, 1.0, "hold:sub_floor"), (1, False, True, True, 1.0, "ride:cold"), (1, False, False, True, 1.0, "ride:model_switch"), (1, False, False, False, 1.0, "flush"), (1, False, False, False, 0.0, "hold:warm_deep")],
)
def test_decision_order(spark, n, floor, cold, free, npv, want):
    assert one(spark, E.decision(F.lit(n), F.lit(floor), F.lit(cold), F.lit(free), F.lit(npv), F.lit(0.0))) == want


def test_vetoes_and_targets(spark):
    lit = F.lit
    assert one(spark, E.score_value(lit(1.0), lit(0.0), *[lit(0.5)] * 4, lit(0.0))) == float("-inf")
    assert one(spark, E.quality_gain(lit(float("-inf")))) == 0.0
    assert one(spark, E.hard_target(lit(4000), lit(4000))) == 256
    assert one(spark, E.soft_pressure(lit(1000), lit(400))) is False


def test_digits_are_those_of_sql(spark):
    """Folded ratios end near halves of the last digit; F.round differs from SQL on some of them."""
    import duckdb

    near = [0.1271484375, 0.16636718749999999, 1.0364383485, 1.1287890624999999]
    folded = [0.7 * (a / 512) + 0.3 * (b / 512) for a in range(0, 2000, 7) for b in range(0, 2000, 13)]
    values = near + folded + [-x for x in near] + [0.0, 1e-12, 2.5e-9, -2.5e-9, 123456789.0123456785, 1e18, float("inf"), float("-inf"), None]
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest(?::DOUBLE[]) AS x", [values])
    want = [r[0] for r in con.execute("SELECT round(x, 9) FROM v").fetchall()]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select(E.to_digits("x", 9).alias("to"), F.round("x", 9).alias("by_decimal")).collect()
    assert [r["to"] for r in rows] == want and [r["by_decimal"] for r in rows] != want
