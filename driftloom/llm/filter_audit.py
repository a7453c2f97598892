"""How filters act on each other: every order of them replayed over every document.

The flags of a document meet all orders (a broadcast table of fixed size), the steps of an order are
exploded, the first failing step decides where the document goes, and conditional counts are combined
in each task before they are shuffled: a task gives out parts x orders x steps rows, whatever it reads.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .exact_dedup import exact_groups

#: White space between words, and the shortest text with words enough.
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 200
LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> dict[str, Column]:
    """The conditions that need nothing but the text; each is true where the filter rejects it."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 3 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """One row for each document: part, mask (bit k for a failure of filter k), good, toxic.

    Words and characters are counted where the document is read, so no text moves for them; copies
    are found by exact_groups, and marks join by id in narrow rows.
    """
    t = F.col("text")
    own = docs.select(F.col("doc_id"), text_or_empty().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    bits = [F.when(c, 1 << LETTERS.index(k)).otherwise(0) for k, c in failures(t).items()]
    own = own.withColumn("mask", reduce(lambda a, b: a + b, bits))
    copies = exact_groups(own, keep="min")
    again = F.coalesce(F.col("keep_id") < F.col("doc_id"), F.lit(False))
    own = copies.select("doc_id", "part", (F.col("mask") + F.when(again, 16).otherwise(0)).cast("int").alias("mask"))
    known = (
        marks.where("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy(F.col("doc_id").alias("_of"))
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    )
    return own.join(known, F.col("doc_id") == F.col("_of"), "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark, letters: str = LETTERS) -> DataFrame:
    """All orders of the letters: (filter_order, bits), bits holding the mask of each step's filter."""
    rows = [("".join(p), [1 << letters.index(x) for x in p]) for p in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>").coalesce(1)


def replayed(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, the counts of COUNTS and shapley, for every order and step.

    flags: part, mask, good, toxic of each document. A document leaves at the first step whose filter
    it fails. shapley is what the step's filter removes from the part, summed over all orders.
    """
    mask, bit, step, first = F.col("mask"), F.col("bit"), F.col("step"), F.col("first")
    n = len(letters)
    leaves = reduce(lambda rest, k: F.when(mask.bitwiseAND(F.get("bits", F.lit(k))) != 0, k + 1).otherwise(rest), reversed(range(n)), F.lit(n + 1))
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession, letters))).withColumn("first", leaves)
    steps = crossed.select("part", "filter_order", "mask", "good", "toxic", "first", F.posexplode("bits").alias("_at", "bit")).withColumn("step", F.col("_at") + 1)
    here = first == step
    when = {
        "kept": first > step, "removed": here, "redundant": (mask.bitwiseAND(bit) != 0) & (first < step),
        "unique_fails": mask == bit, "good_lost": here & F.col("good"), "toxic_lost": here & F.col("toxic"),
    }
    counted = steps.groupBy("part", "filter_order", "step").agg(*[F.sum(F.when(when[c], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias(c) for c in COUNTS])
    named = counted.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    # a part has orders x steps rows by now, however many documents it has
    whole = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return named.withColumn("shapley", whole).select("part", "filter_order", "step", "filter", *COUNTS, "shapley")


def audit(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Replay the five filters over whole texts in all 120 orders.

    docs: doc_id, text, lang; marks: doc_id, quality, toxic. Other columns are not read, whatever
    their names. A null text counts as empty: it fails A only, and E if an empty text has a smaller
    id. A null lang is the part "", as an empty one. A row without an id is never a copy and has no
    marks; an id that is repeated with one text is no copy of itself, and each of its rows counts.
    Of several marks of an id any 1 holds; null marks count as 0. An empty table gives no rows. Texts
    of any length are worked on whole.
    """
    return replayed(flagged(docs, marks))
