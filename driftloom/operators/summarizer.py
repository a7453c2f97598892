"""Deciding what to do with a long segment, and what a session is about.

A summariser is anything with decide() and fold(). The one here is local and deterministic, and works
on columns: it keeps the ends of a text and the rarest words of its middle.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

ENDS, KEYWORDS = 3, 8


class Summarizer(Protocol):
    def decide(self, content: Column, tags: Column) -> Column:
        """struct<choice string, ranges_to_keep array<struct<start int, end int>>, summary_content string>"""

    def fold(self, state: Column, turns: Column) -> Column:
        """The working state after more turns."""


class Extractive:
    """Tagged segments are kept. Texts of many lines are cut to their ends, other long ones are
    summarised by their ends and most telling words, short ones are kept."""

    def __init__(self, least_chars: int = 256, lines: int = X.HEAD_LINES + X.TAIL_LINES):
        self.least_chars, self.lines = least_chars, lines

    def decide(self, content: Column, tags: Column) -> Column:
        ls = X.lines(content)
        n = F.size(ls)
        kept = F.array(F.struct(F.lit(1).alias("start"), F.lit(X.HEAD_LINES).alias("end")), F.struct((n - X.TAIL_LINES + 1).alias("start"), n.alias("end")))
        none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
        choice = F.when((F.size(tags) > 0) | (F.char_length(content) < self.least_chars), "keep").when(n > self.lines, "truncate").otherwise("summarize")
        return F.struct(choice.alias("choice"), F.when(choice == "truncate", kept).otherwise(none).alias("ranges_to_keep"), F.when(choice == "summarize", self.summary(content)).alias("summary_content"))

    def summary(self, content: Column) -> Column:
        ls = F.filter(X.lines(content), lambda x: F.trim(x) != "")
        first, last = F.substring(F.get(ls, 0), 1, 80), F.substring(F.element_at(ls, -1), 1, 80)
        words = F.array_sort(F.array_distinct(F.filter(X.tokenize(content), lambda w: F.length(w) > 3)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
        return F.concat_ws("\n", first, F.concat(F.lit("about: "), F.array_join(F.slice(words, 1, KEYWORDS), ", ")), F.when(F.size(ls) > 1, last))

    def fold(self, state: Column, turns: Column) -> Column:
        """The task in flight is the first line of the latest turn; all else stays."""
        latest = X.first_line(F.element_at(turns, -1))
        return F.when(F.size(turns) > 0, state.withField("in_flight", latest)).otherwise(state)
