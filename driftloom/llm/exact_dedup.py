"""Exact deduplication with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, without


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Add keep_id, group_size, kept and text_sha256 to every row.

    Rows are grouped by the 128-bit hash of their text and, inside a hash group, by the bytes
    themselves, so texts that merely collide stay apart. The grouping is combined on the map side,
    so a group holding a third of all rows is one row of each task, and each distinct text is
    shuffled once for each task that has it. Rows then find their group by (hash, SHA-256) in a join
    of narrow rows whose hot keys adaptive execution may split.

    keep: "min" or "max", which stable id of a group stays. Null text counts as empty. Rows that
    repeat an id and a text are one document and share its verdict. A null id stays only where no
    row of its group has an id (keep_id is then null). An empty table gives an empty table. Input
    columns named like an added one are replaced.
    """
    added = {"keep_id", "group_size", "kept", "text_sha256"}
    h, gh, gs, gb, gn = fresh(df, "h", "gh", "gs", "best", "n")
    text = F.coalesce(F.col(text_col), F.lit(""))
    best = {"min": F.min, "max": F.max}[keep]
    groups = (
        df.select(F.md5(text.cast("binary")).alias("h"), text.alias("t"), F.col(id_col).alias("i"))
        .groupBy("h", "t")
        .agg(best("i").alias(gb), F.count(F.lit(1)).alias(gn))
        .where(F.col(gn) > 1)
        .select(F.col("h").alias(gh), F.sha2(F.col("t").cast("binary"), 256).alias(gs), gb, gn)
    )
    rows = without(df, added).withColumns({h: F.md5(text.cast("binary")), "text_sha256": F.sha2(text.cast("binary"), 256)})
    joined = rows.join(groups, (F.col(h) == F.col(gh)) & (F.col("text_sha256") == F.col(gs)), "left")
    keep_id = F.when(F.col(gn).isNull(), F.col(id_col)).otherwise(F.col(gb))
    return joined.withColumns({"keep_id": keep_id, "group_size": F.coalesce(F.col(gn), F.lit(1)).cast("long"), "kept": F.col(id_col).eqNullSafe(keep_id)}).drop(h, gh, gs, gb, gn)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of each group of equal texts, that of the smallest or largest id, with the columns of df.

    The rows come out of the grouping by (hash, text) itself, so each text is shuffled once for each task
    that has it. Rows without an id stay only where no row of their group has one. Of rows that repeat
    an id and a text one stays, the least or largest in its other columns. A null text is a copy of an
    empty one, and stays null. An empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in df.columns if c != text_col]
    own = F.struct(F.col(text_col).isNull().alias("void"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)])
    key = [(F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull()).alias("known"), F.col(id_col).alias("id")]
    if any("map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() for f in df.schema.fields):
        by = F.struct(*key, F.to_json(own))  # such columns have no order of their own
        best = {"min": F.min_by, "max": F.max_by}[keep](own, by)
    else:
        best = {"min": F.min, "max": F.max}[keep](F.struct(*key, own.alias("own")))["own"]
    marked = df.withColumns(dict(zip(fresh(df, "h", "t"), (F.md5(text.cast("binary")), text), strict=True)))
    one = marked.groupBy(*fresh(df, "h", "t")).agg(best.alias("own"))
    t = F.col(fresh(df, "t")[0])
    back = {c: F.col(f"own.c{k}").alias(c) for k, c in enumerate(rest)} | {text_col: F.when(~F.col("own.void"), t).alias(text_col)}
    return one.select(*[back[c] for c in df.columns])
