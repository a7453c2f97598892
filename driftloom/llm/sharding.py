"""Balanced shards: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, without

#: Rows or groups that are numbered by one task.
ROWS_PER_CELL = 200_000
MOST_CELLS = 65_536
#: Rows up to which the schedule is broadcast; beyond, the join is left to the planner.
BROADCAST_ROWS = 500_000


def longest_first(items: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, shard, first, n): longest-processing-time scheduling of items (size, how many of it).

    The largest item goes first, each to the least loaded shard, equal loads by shard number. Items of
    one size differ in nothing, so of those the ones numbered first to first + n - 1 go to a shard.
    A size with many items is dealt at once up to the greatest load that all of them reach, which
    is where the heap would lead, one by one; only the last few go through it.
    """
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, count in sorted(items, reverse=True):
        given: dict[int, int] = {}
        left = count
        if count > 4 * shards and size:
            turns = lambda level: sum(max(0, -((load - level) // size)) for load, _ in heap)
            lo, hi = heap[0][0], heap[0][0] + size * (count + 1)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if turns(mid) <= count else (lo, mid - 1)
            for k, (load, s) in enumerate(heap):
                if (n := max(0, -((load - lo) // size))):
                    given[s] = n
                    heap[k] = (load + n * size, s)
            heapq.heapify(heap)
            left -= sum(given.values())
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            given[s] = given.get(s, 0) + 1
        first = 0
        for s, n in sorted(given.items()):
            out.append((size, s, first, n))
            first += n
    return out


def cells_of(rows: int, parts: int) -> int:
    return max(8, min(MOST_CELLS // parts, rows // (parts * ROWS_PER_CELL) + 1))


def numbered(df: DataFrame, by: str, cell: str, order: list[str], out: str) -> DataFrame:
    """Add out: the place from 0 of each row among those of equal `by`. Every cell is numbered by its own
    task and starts where the cells before it end; a value of `by` may have any share of the rows."""
    b, c, start, n = fresh(df, "by", "cell", "start", "n")
    ends = Window.partitionBy(b).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(F.col(by).alias(b), F.col(cell).alias(c)).agg(F.count(F.lit(1)).alias(n))
    starts = checkpointed(starts.select(b, c, F.coalesce(F.sum(n).over(ends), F.lit(0)).alias(start)))
    few = starts.count() <= BROADCAST_ROWS
    rows = df.join(F.broadcast(starts) if few else starts, (F.col(by) == F.col(b)) & (F.col(cell) == F.col(c)))
    nth = F.row_number().over(Window.partitionBy(by, cell).orderBy(*order)) - 1
    return rows.withColumn(out, (F.col(start) + nth).cast("long")).drop(b, c, start)


def shard_by_bytes(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Add size, text_crc32, law ("bytes"), shard, slot and grown_shard (null) to every row.

    A row weighs the UTF-8 bytes of its text plus overhead. Rows of equal text form a group that is
    never divided, and every group is an item of the schedule: by size, to the least loaded shard
    through a heap. Groups of one size are alike, so the driver gets sizes and how many groups have
    each; different sizes that add up to S bytes are fewer than sqrt(2 S), 14 million for 100 TB.
    Groups of one size are numbered by the hash of the text and take the shards in that order. Slots
    number a shard's rows from 0 without a gap.

    Null text counts as empty, in its group and size; a text of any length is weighed whole; rows with
    null ids are numbered first in their cell; repeated rows get slots of their own; an empty table
    gives an empty table; columns named like an added one are replaced, all others may be called anything.
    """
    spark = df.sparkSession
    added = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    g, cell, gg, gs = fresh(df, "g", "cell", "group", "group_shard")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    marked = without(df.withColumn(g, F.md5(text)), added)
    marked = marked.withColumns({"size": (F.octet_length(text) + overhead).cast("long"), "text_crc32": F.crc32(text).cast("long")})
    groups = checkpointed(marked.groupBy(F.col(g).alias("g")).agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")))
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    sizes = groups.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).toArrow()
    plan = longest_first(list(zip(sizes["weight"].to_pylist(), sizes["n"].to_pylist(), strict=True)), shards)
    names = ["size", "s", "first", "many"]
    columns = [pa.array(c, pa.int64()) for c in (zip(*plan, strict=True) if plan else ((),) * 4)]
    schedule = spark.createDataFrame(pa.table(columns, names))
    hash32 = F.conv(F.substring("g", 1, 8), 16, 10).cast("long")
    ranked = numbered(groups.select("g", "weight", F.pmod(hash32, F.lit(cells_of(n_groups, 1))).alias("cell")), "weight", "cell", ["g"], "rank")
    placed = ranked.join(F.broadcast(schedule) if len(plan) <= BROADCAST_ROWS else schedule, (F.col("weight") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("many")))
    placed = checkpointed(placed.select(F.col("g").alias(gg), F.col("s").cast("int").alias(gs)))
    rows = marked.join(placed, F.col(g) == F.col(gg)).withColumn("shard", F.col(gs)).drop(g, gg, gs)
    rows = rows.withColumn(cell, F.pmod(F.xxhash64(F.col(id_col), F.col("text_crc32")), F.lit(cells_of(n_rows or 0, shards))).cast("int"))
    rows = numbered(rows, "shard", cell, [id_col, "text_crc32"], "slot")
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).drop(cell)
