"""Stored originals: a table keyed by content address, put, fetched and collected by size."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

GRACE_SECONDS, MOST_BYTES, HOT_COUNT = 600.0, 256 << 20, 2
SCHEMA = "ref_id string, original binary, byte_len long, token_estimate long, source_uuid string, session_id string, kind string, created_at double, last_access_at double, access_count long, pinned boolean"


def put(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: of new addresses the earliest writer; those already stored stay as they are.

    Both have the columns of SCHEMA. The least (created_at, source_uuid) of an address is combined
    before the shuffle, so one that very many rows carry is no hot group."""
    first = incoming.groupBy("ref_id").agg(F.min(F.struct("created_at", "source_uuid", "session_id", "kind", "byte_len", "token_estimate", "last_access_at", "access_count", "pinned")).alias("f"))
    return first.select("ref_id", "f.*").join(store.select("ref_id"), "ref_id", "left_anti")


def retrieve(store: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ref_id, session_id, now) with the stored row, or nulls: a miss. Both keys must agree."""
    return requests.join(store, ["ref_id", "session_id"], "left").withColumn("hit", F.col("byte_len").isNotNull())


def touched(store: DataFrame, requests: DataFrame) -> DataFrame:
    """The store with accesses counted and the latest of them noted, as hits do."""
    hits = requests.groupBy("ref_id", "session_id").agg(F.count(F.lit(1)).alias("_n"), F.max("now").alias("_now"))
    joined = store.join(hits, ["ref_id", "session_id"], "left")
    return joined.withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_access_at": F.coalesce(F.greatest("_now", "last_access_at"), "last_access_at")}).drop("_n", "_now")


def hot_refs(store: DataFrame, least: int = HOT_COUNT) -> DataFrame:
    return store.where(F.col("access_count") >= least).select("session_id", "ref_id")


def running_total(df: DataFrame, order: list[str], size: str, out: str, partitions: int | None = None) -> DataFrame:
    """Add the sum of `size` over all rows before a row in the whole order, without one task seeing
    all rows: ranges of the order are summed, and each starts where the ranges before it end. There are
    as many ranges as the session has shuffle partitions, or `partitions`, and as many rows are broadcast."""
    ranged = df.repartitionByRange(*[partitions] * (partitions is not None), *order)
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(F.col("_range").alias("_r")).agg(F.sum(size).alias("_sum"))
    starts = starts.select("_r", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_range", "_r", "_start")


def collect_garbage(store: DataFrame, reachable: DataFrame, now: float, grace: float = GRACE_SECONDS, most: int = MOST_BYTES, order: tuple[str, ...] = ("last_access_at", "ref_id")) -> DataFrame:
    """The rows to delete: of unpinned rows that nothing reaches and that are past their grace, the
    least recently used, while the unreachable bytes that are left exceed `most`."""
    loose = store.where("not pinned").join(reachable.select("ref_id").distinct(), "ref_id", "left_anti")
    live = loose.agg(F.coalesce(F.sum("byte_len"), F.lit(0)).cast("long").alias("_live"))
    old = loose.where(F.lit(now) - F.col("created_at") > grace)
    ordered = running_total(old, list(order), "byte_len", "_before")
    return ordered.join(F.broadcast(live)).where(F.col("_live") - F.col("_before") > most).drop("_live", "_before")


PARTS = {"originals": SCHEMA, "accesses": "ref_id string, session_id string, at double", "pins": "ref_id string, pinned boolean, nth long"}


class RefStore:
    """A store in a folder of Parquet files, in generations of three tables: originals, accesses and pins.

    A put appends the originals that are new, an access or a pin appends one row beside them; no
    original is written again for that. Collection folds the tables into a new generation and removes
    those before the one it replaces. Originals carry a Bloom filter of the address, so that fetching
    one reads the files that may have it."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """Those whose originals were written in full."""
        Path, fs = self._fs()
        if not fs.exists(Path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(Path(self.path)) if s.isDirectory()]
        return sorted(int(n[4:]) for n in names if n.startswith("gen=") and fs.exists(Path(f"{self.path}/{n}/originals/_SUCCESS")))

    def generation(self) -> int:
        """The latest generation; 0 for none."""
        return max(self.generations(), default=0)

    def table(self, part: str) -> DataFrame:
        Path, fs = self._fs()
        folder = f"{self.path}/gen={self.generation()}/{part}"
        return self.spark.read.schema(PARTS[part]).parquet(folder) if fs.exists(Path(folder)) else self.spark.createDataFrame([], PARTS[part])

    def append(self, part: str, rows: DataFrame, generation: int | None = None) -> None:
        rows = rows.select(*self.spark.createDataFrame([], PARTS[part]).columns)
        rows.write.mode("append").option("parquet.bloom.filter.enabled#ref_id", "true").parquet(f"{self.path}/gen={generation or max(1, self.generation())}/{part}")

    def rows(self) -> DataFrame:
        """The originals with their accesses and pins, in the columns of SCHEMA."""
        seen = self.table("accesses").groupBy("ref_id", "session_id").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
        pins = self.table("pins").groupBy("ref_id").agg(F.max(F.struct("nth", "pinned")).alias("_pin"))
        own = self.table("originals")
        joined = own.join(seen, ["ref_id", "session_id"], "left").join(pins, "ref_id", "left")
        joined = joined.withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_access_at": F.coalesce(F.greatest("_at", "last_access_at"), "last_access_at"), "pinned": F.coalesce("_pin.pinned", "pinned")})
        return joined.select(*own.columns)

    def put(self, incoming: DataFrame) -> None:
        """incoming: original, source_uuid, session_id, kind, created_at."""
        text = F.col("original")
        full = incoming.withColumns(
            {"ref_id": F.concat(F.lit("sha256:"), F.sha2(text, 256)), "byte_len": F.octet_length(text).cast("long"), "token_estimate": F.ceil(F.char_length(F.decode(text, "UTF-8")) / F.lit(3.5)).cast("long"), "last_access_at": F.col("created_at"), "access_count": F.lit(0).cast("long"), "pinned": F.lit(False)}
        )
        first = full.groupBy("ref_id").agg(F.min(F.struct("created_at", "source_uuid", "session_id", "kind", "byte_len", "token_estimate", "last_access_at", "access_count", "pinned", "original")).alias("f")).select("ref_id", "f.*")
        self.append("originals", first.join(self.table("originals").select("ref_id"), "ref_id", "left_anti"))

    def retrieve(self, session_id: str, ref_id: str, now: float, query: str | None = None) -> str | None:
        """The original, or its passages that suit the query; None for a miss. A hit is counted."""
        from ..operators.search import search_within

        found = self.table("originals").where((F.col("ref_id") == ref_id) & (F.col("session_id") == session_id)).select(F.decode("original", "UTF-8").alias("doc")).first()
        if found is None:
            return None
        self.append("accesses", self.spark.createDataFrame([(ref_id, session_id, now)], PARTS["accesses"]).coalesce(1))
        if query is None:
            return found["doc"]
        return search_within(self.spark.createDataFrame([(found["doc"], query)], "doc string, query string")).first()["found"]

    def pin(self, ref_id: str, pinned: bool = True) -> None:
        self.append("pins", self.spark.createDataFrame([(ref_id, pinned, time.time_ns())], PARTS["pins"]).coalesce(1))

    def collect(self, reachable: DataFrame, now: float, grace: float = GRACE_SECONDS, most: int = MOST_BYTES) -> None:
        gone = collect_garbage(self.rows().drop("original"), reachable, now, grace, most).select("ref_id")
        k = self.generation()
        self.append("originals", self.rows().join(gone, "ref_id", "left_anti"), k + 1)
        Path, fs = self._fs()
        for old in [g for g in self.generations() if g < k]:
            fs.delete(Path(f"{self.path}/gen={old}"), True)
