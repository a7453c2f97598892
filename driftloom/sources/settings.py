"""Settings: a TOML file or a mapping, closed against unknown keys; and a control table."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Economics:
    npv_floor: float = 0.0
    ttl_auto_s: float = 3600.0
    ttl_forced_s: float = 300.0


@dataclass(frozen=True)
class Policy:
    recency_window_n: int = 3
    human_verbatim_max: int = 16_384
    pre_gate_min_chars: int = 256
    cache_hint_cap: int = 4
    lookback_positions: int = 20


@dataclass(frozen=True)
class Settings:
    economics: Economics = field(default_factory=Economics)
    policy: Policy = field(default_factory=Policy)


def from_mapping(values: dict) -> Settings:
    """Settings from {"schema_version": 1, "economics": {...}, "policy": {...}}; unknown keys are errors."""
    values = dict(values)
    if values.pop("schema_version", None) != 1:
        raise ValueError("schema_version must be 1")
    made = {}
    for name, kind in (("economics", Economics), ("policy", Policy)):
        given = values.pop(name, {})
        if unknown := set(given) - {f.name for f in fields(kind)}:
            raise ValueError(f"unknown {name}: {sorted(unknown)}")
        made[name] = kind(**given)
    if values:
        raise ValueError(f"unknown: {sorted(values)}")
    return Settings(**made)


def from_toml(path: str) -> Settings:
    with open(path, "rb") as f:
        return from_mapping(tomllib.load(f))


def flags(commands: DataFrame) -> DataFrame:
    """(name, value) of each flag after commands (seq, name, value): the latest of a name holds."""
    return commands.groupBy("name").agg(F.max_by("value", "seq").alias("value"))


def routed(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests (method, path) with token and inspected: only a POST of messages under a known token
    is looked into, all else passes. sessions: token. Known tokens are joined, not collected."""
    split = requests.withColumn("token", F.regexp_extract("path", r"\A/s/([^/]+)(/.*)?\z", 1))
    rest = F.when(F.col("token") != "", F.regexp_extract("path", r"\A/s/([^/]+)(/.*)?\z", 2)).otherwise(F.col("path"))
    known = sessions.select("token").distinct().withColumn("_known", F.lit(True))
    joined = split.withColumn("rest", rest).join(known, "token", "left")
    return joined.withColumn("inspected", (F.col("method") == "POST") & (F.col("rest") == "/v1/messages") & F.coalesce("_known", F.lit(False))).drop("_known", "rest")
