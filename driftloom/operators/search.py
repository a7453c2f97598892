"""BM25 retrieval inside a document, row by row and without a shuffle.

Passages are cut by built-in functions. Scores come from one Arrow function over whole batches: as
nested column lambdas every passage would be counted anew for each term of the query.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chunks import by_chunks
from ..functions.text import passages

K1, B = 1.2, 0.75
TOP = 5
SCORES = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("idx", T.IntegerType())]))
TERM = regex.compile(r"[\p{L}\p{N}]+")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def passage_scores(found: list[str], query: str) -> list[dict]:
    """Passages with a score above 0; a term asked for twice counts twice."""
    asked = Counter(terms(query))
    counts = [Counter(terms(p)) for p in found]
    total = sum(c.total() for c in counts)
    if not asked or not total:
        return []
    n, average = len(counts), total / len(counts)
    out = []
    within = Counter(t for c in counts for t in c if t in asked)
    for i, c in enumerate(counts):
        norm = K1 * (1 - B + B * c.total() / average)
        score = sum(k * math.log((n - within[t] + 0.5) / (within[t] + 0.5) + 1) * c[t] * (K1 + 1) / (c[t] + norm) for t, k in asked.items() if t in c)
        if score > 0:
            out.append({"score": score, "idx": i})
    return out


@F.arrow_udf(SCORES)
def scores_udf(found: pa.Array, queries: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("score", pa.float64()), ("idx", pa.int32())]))
    return by_chunks(lambda p, q: passage_scores(p or [], q or ""), kind, found, queries)


def with_scores(docs: DataFrame, doc: str = "doc", query: str = "query") -> DataFrame:
    """Add passages and scores (array of score and idx, those above 0) to rows of a document and a query."""
    return docs.withColumn("passages", passages(F.col(doc))).withColumn("scores", scores_udf("passages", F.col(query)))


def ranked(scores):
    """The scores, rounded to 9 places, best first and of equals the earlier passage first."""
    keys = F.array_sort(F.transform(scores, lambda s: F.struct((-F.round(s["score"], 9)).alias("minus"), s["idx"].alias("idx"))))
    return F.transform(keys, lambda s: F.struct((-s["minus"]).alias("score"), s["idx"].alias("idx")))


def search_within(docs: DataFrame, doc: str = "doc", query: str = "query", top: int = TOP) -> DataFrame:
    """Add found: the best passages in the order of the document, one to a line; the first passages
    where none scores."""
    d = with_scores(docs, doc, query).withColumn("_best", F.slice(ranked(F.col("scores")), 1, top))
    order = F.array_sort(F.transform("_best", lambda s: s["idx"]))
    chosen = F.transform(order, lambda i: F.get("passages", i))
    return d.withColumn("found", F.array_join(F.when(F.size("_best") > 0, chosen).otherwise(F.slice("passages", 1, top)), "\n")).drop("scores", "passages", "_best")
