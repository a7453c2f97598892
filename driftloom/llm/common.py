"""What the operators of this subpackage share: reading, scratch tables, text passes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..scratch import shared_folder

#: Bytes of text that a Python worker unfolds into words at a time.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: What tasks of a Python worker remember; cleared when a task ends.
REMEMBERING: list = []


def release() -> None:
    """Give memory back when a task ends: idle workers of a past stage count against the executor."""
    for memo in REMEMBERING:
        memo.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only in some C libraries
        pass


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session. A temporary one, made once, only where none is set and all runs in
    one process, as in tests; on a cluster that is an error."""
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders that written() made in this process, for clear_scratch().
SCRATCH: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of results that are no longer needed."""
    jvm = spark.sparkContext._jvm
    while SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Small tables of an iteration: a reliable checkpoint in the shared folder cuts the lineage."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Larger intermediate tables: Parquet in the shared folder, read back with its schema known."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    SCRATCH.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: set[str]) -> DataFrame:
    """df without the columns that an operator is about to add; its own columns replace clashing ones."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def aside(df: DataFrame, names: set[str], *used: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """df with those of its columns that have one of the names put under fresh ones; how to name them back; and what
    the used columns are called now."""
    low = {n.lower() for n in names}
    clashing = [c for c in df.columns if c.lower() in low]
    moved = dict(zip(clashing, fresh(df, *[f"own{k}" for k in range(len(clashing))]), strict=True))
    found = [next((m for c, m in moved.items() if c.lower() == u.lower()), u) for u in used]
    return df.withColumnsRenamed(moved) if moved else df, {m: c for c, m in moved.items()}, found


def chunks(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row is a range of its own, never cut."""
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def with_text_columns(
    df: DataFrame,
    fields: list[StructField],
    build: Callable[[], Callable[[pa.Array], dict]],
    text_col: str = "text",
) -> DataFrame:
    """Add columns worked out from whole texts, Arrow batch by Arrow batch, without a shuffle.

    build() runs once in each task and returns a function from an array of texts (null read as
    empty) to the lists of the new columns. Added columns replace columns of the same name.
    """
    names = {f.name.lower() for f in fields}
    place = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]
    at = [f.name.lower() for f in df.schema.fields].index(text_col.lower())
    schema = StructType([df.schema.fields[i] for i in place] + fields)

    def run(batches):
        work = None
        for batch in batches:
            texts = batch.column(at)
            texts = pc.fill_null(texts, "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(sizes):
                work = work or build()
                new = work(texts.slice(lo, hi - lo))
                kept = [batch.column(i).slice(lo, hi - lo) for i in place]
                made = [new[f.name] if isinstance(new[f.name], pa.Array) else pa.array(new[f.name], type=arrow_type(f)) for f in fields]
                yield pa.RecordBatch.from_arrays(kept + made, names=schema.names)
        work = None
        release()

    return df.mapInArrow(run, schema)


def flat_text_rows(
    df: DataFrame,
    schema: StructType,
    build: Callable[[], Callable[[pa.Array, pa.RecordBatch], dict]],
    text_col: str = "text",
) -> DataFrame:
    """Any number of rows for each chunk of texts (null read as empty): build() returns a function
    from the texts and the chunk's batch to the lists of schema's columns."""
    at = [f.name.lower() for f in df.schema.fields].index(text_col.lower())

    def run(batches):
        work = None
        for batch in batches:
            texts = pc.fill_null(batch.column(at).cast(pa.binary()), b"")
            for lo, hi in chunks(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                work = work or build()
                new = work(texts.slice(lo, hi - lo), batch.slice(lo, hi - lo))
                cols = [new[f.name] if isinstance(new[f.name], pa.Array) else pa.array(new[f.name], type=arrow_type(f)) for f in schema]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                del new, cols
        work = None
        release()

    return df.mapInArrow(run, schema)


def arrow_type(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)
