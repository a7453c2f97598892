"""What becomes of a request: refused, passed on as it is, or passed on rewritten; a row of the log for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Larger bodies are refused, and bodies over the second size are not rewritten.
MOST_BODY, MOST_REWRITE = 16 << 20, 4 << 20
OUTCOMES = ("refused", "killed", "passed", "kept", "shadow", "rewritten")


def relayed(requests: DataFrame, body: Column, rewritten: Column, killed: Column, shadow: Column, most: int = MOST_BODY, most_rewrite: int = MOST_REWRITE) -> DataFrame:
    """Add status, outcome, forwarded (null where refused), bytes_in and bytes_out.

    A body over `most` is refused with 502. The kill switch comes before all inspection; a body over `most_rewrite`
    is passed on; one whose rewrite is null (there was nothing to do, or a gate held it) is kept; in shadow the
    original goes out although a rewrite was made. A null body counts as empty."""
    own = F.coalesce(body, F.lit(""))
    size = F.octet_length(own).cast("long")
    outcome = (
        F.when(size > most, "refused").when(F.coalesce(killed, F.lit(False)), "killed").when(size > most_rewrite, "passed").when(rewritten.isNull(), "kept").when(F.coalesce(shadow, F.lit(False)), "shadow").otherwise("rewritten")
    )
    out = requests.withColumns({"outcome": outcome, "bytes_in": size})
    sent = F.when(F.col("outcome") == "rewritten", rewritten).when(F.col("outcome") != "refused", own)
    out = out.withColumns({"forwarded": sent, "status": F.when(F.col("outcome") == "refused", 502).otherwise(200)})
    return out.withColumn("bytes_out", F.coalesce(F.octet_length("forwarded"), F.lit(0)).cast("long"))


def totals(log: DataFrame) -> DataFrame:
    """Requests and bytes by outcome, combined before the shuffle; outcomes that did not occur have zeros."""
    names = log.sparkSession.createDataFrame([(x,) for x in OUTCOMES], "outcome string")
    found = log.groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))
    zero = F.lit(0).cast("long")
    return names.join(found, "outcome", "left").select("outcome", *[F.coalesce(c, zero).alias(c) for c in ("requests", "bytes_in", "bytes_out")])
