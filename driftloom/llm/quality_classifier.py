"""A quality classifier: random Fourier features of document statistics, ridge regression by
partition-summed normal equations, and isotonic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, checkpointed, with_text_columns, without, written

STATS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "repeat_next", "repeat_pairs", "upper", "digits",
    "symbols", "bars", "bangs", "stops", "commas", "other_marks", "wide", "repeat_lines", "log_lines", "ends_marked", "capital_words",
)
#: Random features, and the width of their Gaussian kernel in standard deviations of a statistic.
FEATURES, WIDTH = 384, 4.0
#: Labelled rows that are learned from at most; of more, those with the least hash of their id.
LEARNED_ROWS = 400_000
#: Partitions whose normal equations (FEATURES squared) are summed; bounds what the driver gets.
SUMS = 12
#: Steps of the raw score in which labels are counted for calibration.
STEPS = 2_000
#: The range of the raw score in which it is calibrated; labels are 0 and 1.
LOW, HIGH = -1.0, 2.0
CLASSES = {"upper": range(0x41, 0x5B), "digits": range(0x30, 0x3A), "symbols": b"#*$%&<>@_=+~^\\", "bars": b"|", "bangs": b"!", "stops": b".?", "commas": b",;:", "other_marks": b"\"'()[]{}-/`", "wide": range(0x80, 0x100)}


def class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for i, members in enumerate(CLASSES.values()):
        table[list(members)] = i
    return table


def text_stats(data: bytes, table: np.ndarray) -> list[float]:
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [float(np.log1p(size))] + [0.0] * (len(STATS) - 1)
    classes = np.bincount(table[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[:-1] / size
    share = dict(zip(CLASSES, classes.tolist(), strict=True))
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(size)), float(np.log1p(n)), sum(map(len, words)) / n, len(seen) / n, max(seen.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, 1 - pairs / (n - 1) if n > 1 else 0.0,
        share["upper"], share["digits"], share["symbols"], share["bars"], share["bangs"], share["stops"], share["commas"], share["other_marks"], share["wide"],
        1 - len(set(lines)) / len(lines), float(np.log1p(len(lines))),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), sum(w[:1].isupper() for w in words) / n,
    ]


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add stats, an array of the numbers named in STATS; zeros for null and empty texts."""

    def build():
        table = class_table()
        return lambda texts: {"stats": [text_stats(t, table) for t in texts.cast(pa.binary()).to_pylist()]}

    return with_text_columns(df, [T.StructField("stats", T.ArrayType(T.DoubleType()))], build, text_col)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def batch_stats(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index("stats"))
    return col.flatten().to_numpy().reshape(batch.num_rows, len(STATS))


def isotonic(totals: np.ndarray, counts: np.ndarray) -> list[tuple[float, float, int]]:
    """Blocks (total, count, members) whose means rise, nearest totals / counts: neighbours that are out
    of order are pooled."""
    pool: list[tuple[float, float, int]] = []
    for t, c in zip(totals.tolist(), counts.tolist(), strict=True):
        k = 1
        while pool and pool[-1][0] * c >= t * pool[-1][1]:
            u, d, m = pool.pop()
            t, c, k = t + u, c + d, k + m
        pool.append((t, c, k))
    return pool


def calibration(at: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a raw score and the share of ones there, for interpolation: each isotonic block counts at
    its mean, with half a row of either label more, so that no level is certain; pooled again, as
    that may put small blocks out of order. Beyond the outermost blocks levels go half the way to
    0 and 1 at the ends of the range, so that unlike documents score unlike there too."""
    blocks = isotonic(ones, counts)
    if not blocks:
        return np.array([LOW, HIGH]), np.array([0.0, 1.0])
    edges = np.cumsum([0, *(k for _, _, k in blocks)])
    n = np.array([c for _, c, _ in blocks])
    mean = np.add.reduceat(at * counts, edges[:-1]) / n
    again = isotonic((np.array([t for t, _, _ in blocks]) + 0.5) / (n + 1) * n, n)
    edges = np.cumsum([0, *(k for _, _, k in again)])
    knots = np.add.reduceat(mean * n, edges[:-1]) / np.add.reduceat(n, edges[:-1])
    levels = np.array([t / c for t, c, _ in again])
    return np.concatenate([[LOW], np.clip(knots, LOW, HIGH), [HIGH]]), np.concatenate([[levels[0] / 2], levels, [(1 + levels[-1]) / 2]])


def step_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOW) / (HIGH - LOW) * STEPS).astype(int), 0, STEPS - 1)


def fit(rows: DataFrame, seed: int = 11) -> Model:
    """Learn from rows (stats, label 0 or 1, fold): fold 0 calibrates, the others fit the ridge.

    Each of SUMS partitions gives one sum of outer products, and labels are counted in STEPS steps
    of the raw score, so the driver gets as much at any size. Without rows every score is 0.5.
    """
    d = len(STATS)
    rows = checkpointed(rows.select("stats", F.col("label").cast("double").alias("label"), "fold").repartition(SUMS))
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("stats")[i] * F.col("stats")[i]).alias(f"q{i}") for i in range(d)]
    total = rows.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    n = total["n"]
    rng = np.random.default_rng(seed)
    waves, phases = rng.normal(size=(d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    if not n:
        return Model(np.zeros(d), np.ones(d), waves, phases, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    mean = np.array([total[f"s{i}"] for i in range(d)]) / n
    scale = np.sqrt(np.maximum(np.array([total[f"q{i}"] for i in range(d)]) / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), waves, phases, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))

    def normal(batches):
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z, y = model.features(batch_stats(batch)), batch.column(1).to_numpy()
            a += z.T @ z
            b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([a, b]).tobytes()], pa.binary())], names=["sums"])

    parts = sorted(bytes(r["sums"]) for r in rows.where("fold <> 0").select("stats", "label").mapInArrow(normal, "sums binary").collect())
    both = sum((np.frombuffer(p).reshape(FEATURES + 2, FEATURES + 1) for p in parts), np.zeros((FEATURES + 2, FEATURES + 1)))
    ridge = np.eye(FEATURES + 1) * (1e-4 * n + 0.1)
    ridge[-1, -1] = 1e-6
    model.weights = np.linalg.solve(both[:-1] + ridge, both[-1])

    def steps(batches):
        for batch in batches:
            raw = model.raw(batch_stats(batch))
            yield pa.RecordBatch.from_arrays([pa.array(step_of(raw), pa.int32()), pa.array(raw), batch.column(1)], names=["step", "raw", "label"])

    counted = rows.where("fold = 0").select("stats", "label").mapInArrow(steps, "step int, raw double, label double")
    counted = counted.groupBy("step").agg(F.avg("raw").alias("at"), F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("step")
    model.knots, model.levels = calibration(*(counted[c].to_numpy(float) for c in ("at", "ones", "n")))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """Replace stats by score (0 to 1) and predicted (1 if score >= 0.5)."""
    kept = [f for f in stats.schema.fields if f.name not in ("stats", "score", "predicted")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            s = model.score(batch_stats(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return stats.mapInArrow(run, schema)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Add held_out, score and predicted to every row of df (without its text).

    Ids whose crc32 as text leaves 1 modulo 3 are held out: nothing is learned from their labels.
    Of the other labelled rows at most LEARNED_ROWS are learned from, chosen by a hash of the id;
    a score depends on the text alone. Labels of one id are averaged and rounded, null labels
    ignored. Null texts count as empty and are scored like them; rows with a null id are scored and
    not held out; repeated rows get equal scores; whole texts of any length count; an empty table gives an empty table; without any
    label every score is 0.5; columns named like an added one are replaced.
    """
    df, back, (id_col, text_col) = aside(df, {"stats"}, id_col, text_col)
    stats = written(without(with_stats(df, text_col), {text_col, "held_out", "score", "predicted"}), "stats")
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    marks = marks.withColumn("_crc", F.crc32(F.col("_id").cast("string").cast("binary"))).where("_crc % 3 <> 1")
    n = marks.count()
    if n > LEARNED_ROWS:
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * LEARNED_ROWS / n))
    rows = stats.select(F.col(id_col).alias("_i"), "stats").join(marks, F.col("_i") == F.col("_id"))
    rows = rows.select("stats", "label", (F.floor(F.col("_crc") / 3) % 5).cast("int").alias("fold"))
    model = fit(rows)
    held = F.coalesce(crc % 3 == 1, F.lit(False))
    return score(stats, model).withColumn("held_out", held).withColumnsRenamed(back)
