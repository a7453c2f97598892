"""Driving a stream over a table slice by slice, as if it arrived in parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..scratch import scratch_path
from .session_state import PROVIDER, ROCKS


def run_in_slices(spark: SparkSession, slices: list[DataFrame], build: Callable[[DataFrame], DataFrame], schema: str, mode: str = "update") -> tuple[DataFrame, str]:
    """(all rows that the stream gave, with the number of their micro-batch; where its checkpoint lies).

    Each slice is appended to the input folder, and the stream is started again from its checkpoint and
    reads what is new, so state outlives restarts. A micro-batch that is run again replaces what it wrote.
    All lies in the shared folder.
    """
    own = scratch_path(spark, "slices")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for part in slices:
            part.write.mode("append").parquet(f"{own}/in")
            out = build(spark.readStream.schema(part.schema).parquet(f"{own}/in"))
            save = lambda df, k: df.write.mode("overwrite").parquet(f"{own}/out/batch={k}")
            out.writeStream.outputMode(mode).option("checkpointLocation", f"{own}/log").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(f"{schema}, batch long").parquet(f"{own}/out"), f"{own}/log"
