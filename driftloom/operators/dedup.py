"""Repeats inside a session: the first occurrence of a text and references back to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import backref, content_address

LEAST_BYTES = 1_024


def should_dedupe(role: Column, size: Column, forced: Column, assistant_allowed: Column) -> Column:
    return ~forced & (size >= LEAST_BYTES) & ((role != "assistant") | assistant_allowed)


def can_refer_back(before: Column, now: Column) -> Column:
    """The same role, or a user to an assistant."""
    return (before == now) | ((before == "assistant") & (now == "user"))


def first_occurrences(leaves: DataFrame) -> DataFrame:
    """Add ref_id and first_seq to leaves (session_id, seq, content). Least sequence numbers are
    combined before the shuffle and joined back, so a text repeated very often is not one task's."""
    rows = leaves.withColumn("ref_id", content_address(F.col("content")))
    first = rows.select("session_id", "ref_id", "seq").groupBy("session_id", "ref_id").agg(F.min("seq").alias("first_seq"))
    return rows.join(first, ["session_id", "ref_id"])


def backrefs(leaves: DataFrame) -> DataFrame:
    """(session_id, seq, first_seq, marker) of later occurrences of texts of LEAST_BYTES or more."""
    long = leaves.where(F.octet_length("content") >= LEAST_BYTES)
    later = first_occurrences(long).where("seq > first_seq")
    return later.select("session_id", "seq", "first_seq", backref(F.col("ref_id")).alias("marker"))
