"""Mixing sources to target weights by repeating and thinning documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, without

#: Sources up to which their table is broadcast; beyond, the join is left to the planner.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def coin(id_col: str) -> Column:
    """A document's coin: 32 bits of a hash of its id, as a number from 0 up to 1."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def numbered(per: DataFrame) -> DataFrame:
    """Add nth, the place of each source from 0 in order of code points, null last. Sources are ordered
    by ranges, each numbered by its own task; only the sizes of the ranges meet in one."""
    ranged = checkpointed(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.join(F.broadcast(starts), "range").withColumn("nth", F.col("start") + own).drop("range", "start")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row a source: its size, its target in words and the rate of repetition.

    Targets divide share * (all words) by weight; one that would be above most * (its source's size)
    stops there, and what is left is divided among the rest. All targets that do not stop are the same
    multiple, the level, of their weights. A level found without some stops is too low, so it rises
    step by step to the one at which no further source stops; each step is one sum over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = checkpointed(numbered(per).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).drop("nth"))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = None, -1
    while True:
        stops = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * F.lit(level)
        n, caps, open_weights = per.agg(F.count_if(stops), F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("weight")))).first()
        if n == stopped or not open_weights:
            break
        level, stopped = (total * share - (caps or 0)) / open_weights, n
    reached = F.col("cap") if level is None else F.col("weight") * F.lit(level)
    target = F.least(F.col("cap"), reached) if n == stopped else F.col("cap")
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def mix_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """Add size, source_size, target, copies and taken to every row of df.

    A document is taken floor(rate) times, and once more if its coin falls below the fraction of the
    rate. The coin is a hash of its id: reruns agree, and each document has the extra copy with a
    probability equal to the fraction. A source's words are near its target as far as its documents
    are many.

    Null text has no words, whole texts of any length are counted; a null source is a source, last in
    order; null ids share one coin, and so do repeated rows; sources without words have target 0; an
    empty table gives an empty table; columns named like an added one are replaced, after the id,
    text and source were read from them.
    """
    added = {"size", "source_size", "target", "copies", "taken"}
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    per = checkpointed(source_targets(df.select(F.col(source_col).cast("string").alias("source"), size.alias("size")), weights, share, most))
    few = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    # names that no column has, so that columns of df may be called anything
    n, c, s, ps, pn, pt, pr = fresh(df, "words", "coin", "name", "source", "n", "target", "rate")
    per = per.toDF(ps, pn, pt, pr)
    rows = without(df.withColumns({n: size, c: coin(id_col), s: F.col(source_col).cast("string")}), added)
    rows = rows.join(F.broadcast(per) if few else per, F.col(s).eqNullSafe(F.col(ps)))
    whole = F.floor(F.col(pr))
    copies = (whole + (F.col(c) < F.col(pr) - whole).cast("long")).cast("long")
    rows = rows.withColumns({"size": F.col(n), "source_size": F.col(pn), "target": F.col(pt), "copies": copies, "taken": (F.col(n) * copies).cast("long")})
    return rows.drop(n, c, s, ps, pn, pt, pr)


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of df as often as it is taken, with the columns of df."""
    row, nth = fresh(df, "row", "nth")
    counted = mix_counts(df.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in df.columns])), **options)
    return counted.where("copies > 0").select(row, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(nth)).select(f"{row}.*")
