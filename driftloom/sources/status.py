"""A status snapshot: what was observed while a query ran, written at once and read strictly."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

VERSION = 1


def observing(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """(df with its metrics, where they are after an action). Aggregates without distinct, of one pass."""
    seen = Observation(f"status-{uuid.uuid4().hex}")
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, values: dict) -> None:
    """Write a snapshot so that a reader sees the old one or the new one, whole; for its owner alone."""
    if set(values) & {"schema_version"}:
        raise ValueError("the version is set here")
    jvm, target, fs = files(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(json.dumps({"schema_version": VERSION, **values}, sort_keys=True).encode()))
    finally:
        out.close()
    fs.setPermission(fresh, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, target, how)


def snapshot(spark: SparkSession, path: str, fields: dict[str, type]) -> dict:
    """The snapshot at path: of this version, with these fields, each of its type, and no others."""
    jvm, target, fs = files(spark, path)
    stream = fs.open(target)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    found = json.loads(text)
    if not isinstance(found, dict) or found.pop("schema_version", None) != VERSION:
        raise ValueError(f"no snapshot of version {VERSION}")
    if set(found) != set(fields):
        raise ValueError(f"fields: {sorted(set(found) ^ set(fields))}")
    if bad := [k for k, t in fields.items() if not isinstance(found[k], t) or (t is int and isinstance(found[k], bool))]:
        raise ValueError(f"not of their type: {bad}")
    return found
