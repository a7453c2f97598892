"""Hard negatives: a matrix multiplication in two dimensions of blocks, reduced tile by tile.

Rows and anchors are packed into shards, and shards into chunks of dimensions. Cells of a grid of row
shards and groups of anchor shards multiply their chunks; the partial tiles of a pair of shards meet in
a shuffle and are added as 64-bit integers, one tile at a time. A sum gives out the best rows of the
anchor's own label at once; what is best among all tiles sets the windows, and a second pass over the
written sums gives out the best rows of other labels inside each window.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, release, written

#: Rows and anchors of a shard, and dimensions of a chunk: a tile has half a MB.
ROWS, ANCHORS, DIMENSIONS = 512, 128, 32
#: Row shards and anchor shards that meet in one cell of the grid.
CELL_ROWS, CELL_ANCHORS = 8, 16
#: Up to so many anchors their windows (120 bytes each) are broadcast; beyond, they are joined.
BROADCAST_ANCHORS = 100_000

BLOCK = "shard long, chunk int, n int, ids binary, labels array<string>, part binary"
PARTIAL = "i long, j long, chunk int, ids binary, labels array<string>, anchors binary, kinds array<string>, tile binary"
SUMMED = "i long, j long, ids binary, labels array<string>, anchors binary, kinds array<string>, tile binary, best array<struct<anchor_id: bigint, positive_id: bigint, score: bigint>>"
FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def partakers(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """One row (id, label, vector) for each id: rows that lack an id, a label, a vector or a finite
    component are out; of rows that repeat an id the least takes part, found by a combined aggregate."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    whole = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).where(~odd)
    rows = whole.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), quantised(x, scale).alias("vector"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")


def packed(rows: DataFrame, most: int, chunk: int = DIMENSIONS) -> DataFrame:
    """Shards of up to `most` rows in the order of their ids, one row for each chunk of dimensions. A
    shorter vector counts as padded with zeros. Ids and labels are on the first chunk."""

    def block(shard: int, ids: np.ndarray, labels: list, vectors: list) -> Iterator[pa.RecordBatch]:
        width = max(max(map(len, vectors)), 1)
        values = np.zeros((len(vectors), width), np.int64)
        for k, v in enumerate(vectors):
            values[k, : len(v)] = v
        if values.size and max(int(values.max()), -int(values.min())) > isqrt((2**63 - 1) // width):
            raise ValueError("components are too large for an exact 64-bit inner product")
        order = np.argsort(ids, kind="stable")
        ids, values, labels = ids[order], values[order], [labels[k] for k in order]
        for c, lo in enumerate(range(0, width, chunk)):
            part = np.ascontiguousarray(values[:, lo : lo + chunk]).tobytes()
            meta = (ids.tobytes(), labels) if c == 0 else (None, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([c], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([meta[0]], pa.binary()), pa.array([meta[1]], pa.list_(pa.string())), pa.array([part], pa.binary())],
                names=["shard", "chunk", "n", "ids", "labels", "part"],
            )

    def run(batches):
        shard, ids, labels, vectors = TaskContext.get().partitionId() << 32, [], [], []
        for batch in batches:
            for i, label, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(i)
                labels.append(label)
                vectors.append(v)
                if len(ids) == most:
                    yield from block(shard, np.array(ids, np.int64), labels, vectors)
                    shard, ids, labels, vectors = shard + 1, [], [], []
        if ids:
            yield from block(shard, np.array(ids, np.int64), labels, vectors)
        release()

    return rows.select("id", "label", "vector").mapInArrow(run, BLOCK)


def partial_tiles(rows: DataFrame, anchors: DataFrame, cells: int, groups: int) -> DataFrame:
    """The product of every row shard and anchor shard, chunk by chunk of their dimensions.

    A row shard goes to one of `cells` and to every group of anchor shards, an anchor shard to its group
    in every cell: so a task holds a few anchor shards, and row shards stream past them. Blocks are always
    shuffled: the planner knows the size of the anchors' file, not that of their copies in all cells, and
    would broadcast those through the driver.
    """
    left = rows.select(F.col("shard").alias("i"), "chunk", "n", "ids", "labels", "part", F.pmod(F.xxhash64("shard"), F.lit(cells)).alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    right = anchors.select(
        F.col("shard").alias("j"), F.col("chunk").alias("_chunk"), F.col("n").alias("m"), F.col("ids").alias("anchors"), F.col("labels").alias("kinds"), F.col("part").alias("other"),
        F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("_group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("_cell"),
    )
    met = left.join(right.hint("merge"), (F.col("chunk") == F.col("_chunk")) & (F.col("cell") == F.col("_cell")) & (F.col("group") == F.col("_group")))
    kept = ["i", "j", "chunk", "ids", "labels", "anchors", "kinds"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64).reshape(batch.column(n)[k].as_py(), -1) for c, n in (("part", "n"), ("other", "m")))
                both = min(a.shape[1], b.shape[1])  # a shorter shard is padded with zeros
                tile = b[:, :both] @ a[:, :both].T
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*map(row.column, kept), pa.array([tile.tobytes()], pa.binary())], names=[*kept, "tile"])
        release()

    return met.select(*kept, "n", "m", "part", "other").mapInArrow(run, PARTIAL)


def label_codes(labels: list[str], kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    known = {x: k for k, x in enumerate(dict.fromkeys([*labels, *kinds]))}
    return np.array([known[x] for x in labels], np.int64), np.array([known[x] for x in kinds], np.int64)


def best_of_tile(tile: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, kinds: np.ndarray, most: int) -> list[dict]:
    """For each anchor the `most` best other rows of its label; ids ascend, so a stable order has ties right."""
    out = []
    for k in range(len(anchors)):
        own = np.flatnonzero((labels == kinds[k]) & (ids != anchors[k]))
        for at in own[np.argsort(-tile[k, own], kind="stable")[:most]].tolist():
            out.append({"anchor_id": int(anchors[k]), "positive_id": int(ids[at]), "score": int(tile[k, at])})
    return out


def summed_tiles(partials: DataFrame, positives: int) -> DataFrame:
    """Partial tiles of a pair of shards added up, with the best positives of each of its anchors."""
    names = [x.split()[0] for x in SUMMED.split(", ")[:7]] + ["best"]

    def finished(key, meta, total):
        ids, anchors = np.frombuffer(meta[0], np.int64), np.frombuffer(meta[2], np.int64)
        codes = label_codes(meta[1], meta[3])
        best = best_of_tile(total.reshape(len(anchors), len(ids)), ids, codes[0], anchors, codes[1], positives)
        kind = pa.list_(pa.struct([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())]))
        cols = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([meta[0]], pa.binary()), pa.array([meta[1]], pa.list_(pa.string())), pa.array([meta[2]], pa.binary()), pa.array([meta[3]], pa.list_(pa.string())), pa.array([total.tobytes()], pa.binary()), pa.array([best], kind)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        key = meta = total = None
        for batch in batches:
            tiles = batch.column("tile")
            for k in range(batch.num_rows):
                here = batch.column("i")[k].as_py(), batch.column("j")[k].as_py()
                tile = np.frombuffer(tiles[k].as_buffer(), np.int64)
                if here != key:
                    if key is not None:
                        yield finished(key, meta, total)
                    key, total = here, tile.copy()
                    meta = [batch.column(c)[k].as_py() for c in ("ids", "labels", "anchors", "kinds")]
                else:
                    total += tile
        if key is not None:
            yield finished(key, meta, total)
        release()

    # dealt by a hash of the pair and streamed in order of the chunks, the first with its ids: a task holds one sum
    return partials.repartition(F.xxhash64("i", "j")).sortWithinPartitions("i", "j", "chunk").mapInArrow(run, SUMMED)


def in_windows(tiles: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """Of each tile the `most` best rows of other labels in each window: low * positive <= 100 * score <= high * positive."""

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                ids, anchors = np.frombuffer(batch.column("ids")[k].as_py(), np.int64), np.frombuffer(batch.column("anchors")[k].as_py(), np.int64)
                labels, kinds = label_codes(batch.column("labels")[k].as_py(), batch.column("kinds")[k].as_py())
                tile = np.frombuffer(batch.column("tile")[k].as_buffer(), np.int64).reshape(len(anchors), len(ids))
                place = {int(a): p for p, a in enumerate(anchors)}
                asked: dict[int, list] = {}
                for w in batch.column("windows")[k].as_py():
                    asked.setdefault(w["anchor_id"], []).append((w["positive_id"], w["score"]))
                for anchor, windows in asked.items():
                    row, p = tile[place[anchor]], place[anchor]
                    # bounds of the score in whole numbers, so that nothing is multiplied in 64 bits
                    bounds = [(-(-low * s // 100), high * s // 100) for _, s in windows]
                    near = np.flatnonzero((labels != kinds[p]) & (row >= min(b[0] for b in bounds)) & (row <= max(b[1] for b in bounds)))
                    falling = near[np.argsort(-row[near], kind="stable")]
                    keys = -row[falling]
                    for (positive, s), (least, greatest) in zip(windows, bounds, strict=True):
                        at = int(np.searchsorted(keys, -greatest))
                        for f in falling[at : at + most].tolist():
                            if row[f] < least:
                                break
                            out.append((anchor, positive, s, int(ids[f]), int(row[f])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])
        release()

    return tiles.mapInArrow(run, FOUND)


def first_of(df: DataFrame, by: list[str], score: str, tie: str, most: int, name: str) -> DataFrame:
    """The `most` best rows of each group, numbered; groups are cut in each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most)


def mine(
    df: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by `every`. Scores are inner products of floor(scale * x), in
    exact 64-bit integers; larger components than that allows are an error. Higher scores come
    first, ties by the smaller id. An anchor's positives are its first `positives` other rows of equal
    label; the negatives of a positive are the first `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score, so a negative positive_score has none.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part.
    Of rows that repeat an id the least (label as text, then vector) takes part. Vectors of unequal length
    count as padded with zeros; an empty one scores 0. Other columns are not read, whatever their names. An
    empty table, or one without anchors, gives no rows.
    """
    whole = partakers(df, id_col, label_col, vector_col, scale)
    chosen = partakers(df.where(F.col(id_col) % every == 0), id_col, label_col, vector_col, scale)
    rows = written(packed(whole, ROWS), "rows")
    shards, count = rows.where("chunk = 0").count(), chosen.count()
    anchors = written(packed(chosen.repartition(max(1, ceil(count / ANCHORS))), ANCHORS), "anchors")
    cells, groups = max(1, ceil(shards / CELL_ROWS)), max(1, ceil(count / (ANCHORS * CELL_ANCHORS)))
    tiles = written(summed_tiles(partial_tiles(rows, anchors, cells, groups), positives), "tiles")
    best = tiles.select("j", F.explode("best").alias("b")).select("j", "b.*")
    best = first_of(best, ["anchor_id"], "score", "positive_id", positives, "nth")
    windows = checkpointed(best.groupBy(F.col("j").alias("_j")).agg(F.collect_list(F.struct("anchor_id", "positive_id", "score")).alias("windows")))
    small = count <= BROADCAST_ANCHORS
    asked = tiles.drop("best").join(F.broadcast(windows) if small else windows, F.col("j") == F.col("_j"))
    found = in_windows(asked.select("ids", "labels", "anchors", "kinds", "tile", "windows"), negatives, low, high)
    ranked = first_of(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives, "rank")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
