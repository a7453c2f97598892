"""Prices of cached prompts: what an edit costs now and saves later. Doubles keep this order of
operations, so that results agree to the last bit with the formulas as written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dollars a token, write and read multipliers, least cached prefix, by tier (fixed values).
TIERS = {"large": (5e-6, 2.0, 0.1, 1024), "middle": (3e-6, 2.0, 0.1, 1024), "small": (1e-6, 2.0, 0.1, 4096)}
#: Write multiplier and lifetime of entries where short entries are forced (fixed values).
FORCED_WRITE, FORCED_TTL, AUTO_TTL = 1.25, 300.0, 3600.0
KIND_SIGNAL = {"tool_pair": 1.0, "assistant_turn": 0.6, "system": 0.3, "tools": 0.3, "user_turn": 0.1}
TAU, SIZE_FULL, QUALITY_DOLLARS = 4.0, 4096.0, 5e-4
SCALE_FRESH, TURN_FRESH, TURN_SEED = 0.3, 0.3, 4.0


def price_table(spark: SparkSession, models: dict[str, str]) -> DataFrame:
    """(model, base, w, r, floor) for models by tier. Broadcast: as many rows as models priced."""
    rows = [(m, *TIERS[t]) for m, t in models.items()]
    return spark.createDataFrame(rows, "model string, base double, w double, r double, floor long")


def to_digits(x: Column | str, digits: int) -> Column:
    """x to so many decimal digits as SQL rounds a double: its product with the power of ten goes to the nearest
    whole number, halves away from zero. F.round takes the shortest decimal of x instead, and differs near a half."""
    x, power = F.col(x) if isinstance(x, str) else x, F.lit(10.0**digits)
    return F.round(x * power) / power


def idle_seconds(last_ts: Column, now: Column) -> Column:
    return now - last_ts


def p_alive(last_ts: Column, ttl: Column, now: Column) -> Column:
    return F.least(F.greatest(F.lit(1.0) - (now - last_ts) / ttl, F.lit(0.0)), F.lit(1.0))


def is_cold(last_ts: Column, ttl: Column, now: Column) -> Column:
    return (now - last_ts) >= ttl


def bust_cost(suffix: Column, base: Column, w: Column, r: Column, alive: Column, cold: Column) -> Column:
    return F.when(cold, F.lit(0.0)).otherwise(suffix.cast("double") * base * (w - r) * alive)


def recurring_saving(n_turns: Column, removed: Column, base: Column, r: Column) -> Column:
    return n_turns * removed.cast("double") * base * r


def break_even_turns(suffix: Column, removed: Column, w: Column, r: Column, cold: Column) -> Column:
    """Turns after which an edit pays; 0 when cold, infinite if nothing is removed."""
    per_turn = removed.cast("double") * r
    cost = suffix.cast("double") * (w - r)
    return F.when(cold, F.lit(0.0)).when(per_turn == 0, F.lit(float("inf"))).otherwise(F.try_divide(cost, per_turn))


def npv(recurring: Column, quality: Column, bust: Column) -> Column:
    return recurring + quality - bust


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def freshness_signal(gap: Column) -> Column:
    return unit(F.lit(1.0) - F.exp(-gap.cast("double") / F.lit(TAU)))


def economics_signal(tokens: Column, pinned: Column, base: Column, w: Column, r: Column, alive: Column) -> Column:
    saving = tokens.cast("double") * base * r
    bust = tokens.cast("double") * base * (w - r) * alive
    tiny = F.lit(2.2250738585072014e-308)
    return F.when(pinned, F.lit(0.0)).otherwise(logistic((saving - bust) / F.greatest(saving, tiny)))


def size_signal(tokens: Column) -> Column:
    return unit(tokens.cast("double") / F.lit(SIZE_FULL))


def kind_signal(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in KIND_SIGNAL.items() for x in kv]), kind)


def score_value(salience: Column, recency: Column, freshness: Column, economics: Column, size: Column, content: Column, access: Column) -> Column:
    """Minus infinity for a vetoed segment, else the sum of its signals, at least 0."""
    total = unit(freshness) + unit(economics) + unit(size) + unit(content) - unit(access)
    return F.when((salience >= 1) | (recency >= 1), F.lit(float("-inf"))).otherwise(F.greatest(total, F.lit(0.0)))


def quality_gain(value: Column) -> Column:
    q = value * F.lit(QUALITY_DOLLARS)
    return F.when(F.isnan(q) | (F.abs(q) == float("inf")), F.lit(0.0)).otherwise(F.greatest(q, F.lit(0.0)))


def admitted(value: Column, floor: float = float("-inf")) -> Column:
    return value >= F.lit(floor)


def scaled(tokens: Column, scale: Column) -> Column:
    return F.greatest(F.round(tokens * scale), F.lit(0.0)).cast("long")


def scaled_signed(delta: Column, scale: Column) -> Column:
    return F.round(delta * scale).cast("long")


def fold_scale(observations: Column) -> Column:
    """The token scale after array<struct<observed, estimated>> in order, from 1.0: the first ratio
    replaces 1.0, later ones move it by 0.3; pairs that are not both finite and positive are ignored."""

    def step(scale, o):
        bad = ~((o["observed"] > 0) & (o["estimated"] > 0)) | F.isnan(o["observed"]) | F.isnan(o["estimated"]) | (o["observed"] == float("inf")) | (o["estimated"] == float("inf"))
        ratio = F.try_divide(o["observed"], o["estimated"])
        return F.when(F.coalesce(bad, F.lit(True)), scale).when(scale == 1.0, ratio).otherwise(F.lit(1 - SCALE_FRESH) * scale + F.lit(SCALE_FRESH) * ratio)

    return F.aggregate(observations, F.lit(1.0), step)


def fold_turns(n: Column) -> Column:
    """Expected remaining turns after turns 1..n: 0.3 * turn + 0.7 * before, from 4."""
    turns = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(turns, F.lit(TURN_SEED), lambda acc, t: F.lit(TURN_FRESH) * t.cast("double") + F.lit(1 - TURN_FRESH) * acc)


def soft_pressure(window: Column, added: Column) -> Column:
    return added.cast("double") > F.lit(0.4) * window.cast("double")


def hard_target(window: Column, max_output: Column) -> Column:
    return F.greatest(F.lit(256), window - max_output - 1024).cast("long")


def decision(n: Column, sub_floor: Column, cold: Column, free_bust: Column, value: Column, floor: Column) -> Column:
    """What to do with a batch of candidates; the first that holds."""
    return (
        F.when(n == 0, F.lit("hold:warm_deep"))
        .when(sub_floor, F.lit("hold:sub_floor"))
        .when(cold, F.lit("ride:cold"))
        .when(free_bust, F.lit("ride:model_switch"))
        .when(value > floor, F.lit("flush"))
        .otherwise(F.lit("hold:warm_deep"))
    )
