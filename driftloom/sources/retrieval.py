"""Retrieval in SQL: stored originals by address and session, and what in them suits a query.

    SELECT r.id, o.doc IS NOT NULL AS hit, f.found
    FROM requests r
    LEFT JOIN LATERAL stored(r.ref_id, r.session_id) o
    JOIN LATERAL found_in(o.doc, r.query) f

stored is a SQL table function over a view of the store: Spark turns the lateral join into a join by
address and session, so nothing is fetched row by row. found_in is a Python table function that gives one
row for each of its calls. ranked_in gives the best passages themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.text import PASSAGE_WORDS
from ..operators.search import TOP, passage_scores

#: What a miss gives in place of a text.
HINT = "[the original is no longer stored; ask for the source again or go on without it]"
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def cut(text: str) -> list[str]:
    """Passages as functions.text.passages cuts them."""
    lines = [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")]
    whole = [x for x in lines if x.strip(" ")]
    if len(whole) > 1:
        return whole
    words = [w for w in SPACE.split(text) if w]
    if len(words) > PASSAGE_WORDS:
        return [" ".join(words[k : k + PASSAGE_WORDS]) for k in range(0, len(words), PASSAGE_WORDS)]
    return [text]


def best(doc: str, query: str) -> tuple[list[str], list[tuple[int, float]]]:
    """(all passages, (place, score) of the best ones from the best on)."""
    parts = cut(doc)
    scored = [(s["idx"], round(s["score"], 9)) for s in passage_scores(parts, query)]
    return parts, sorted(scored, key=lambda s: (-s[1], s[0]))[:TOP]


@udtf(returnType="found string")
class FoundIn:
    """The whole text without a query, the best passages in the order of the text with one, the first ones
    where none scores, and a hint where there is no text."""

    def eval(self, doc: str, query: str):
        if doc is None:
            yield (HINT,)
        elif query is None:
            yield (doc,)
        else:
            parts, chosen = best(doc, query)
            yield ("\n".join(parts[k] for k in sorted(k for k, _ in chosen)) if chosen else "\n".join(parts[:TOP]),)


@udtf(returnType="nth int, idx int, score double, passage string")
class RankedIn:
    """The best passages of a text, best first; none where nothing scores or there is no text or query."""

    def eval(self, doc: str, query: str):
        if doc is not None and query is not None:
            parts, chosen = best(doc, query)
            for nth, (k, score) in enumerate(chosen, 1):
                yield nth, k, score, parts[k]


def register(spark: SparkSession, store: str) -> None:
    """Make stored, found_in and ranked_in known to SQL. store: a view with ref_id, session_id and doc.

    An address that is stored for another session is a miss. A null address or session is a miss."""
    spark.udtf.register("found_in", FoundIn)
    spark.udtf.register("ranked_in", RankedIn)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION stored(ref STRING, owner STRING) RETURNS TABLE (doc STRING) RETURN SELECT s.doc FROM {store} s WHERE s.ref_id = ref AND s.session_id = owner")
