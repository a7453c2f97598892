"""The filter audit against a plain replay, and on null, empty, repeated and clashing input."""

import re
from itertools import permutations

from harness import DATA, spark_rows, sql_rows
from pyspark.sql import functions as F

from driftloom.llm import filter_audit, queries

DOCS = "doc_id long, text string, lang string"
MARKS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_flags(rows):
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        bad = set()
        if len(w) < 200:
            bad.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            bad.add("C")
        if re.search(r"[#$%&*|]", t):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            bad.add("E")
        out.append(bad)
    return out


def plain_audit(rows, marks):
    flags = plain_flags(rows)
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, x in marks if x == 1 and i is not None}
    out, whole = {}, {}
    for order in permutations("ABCDE"):
        for (i, _, lang), bad in zip(rows, flags, strict=True):
            first = next((k for k, x in enumerate(order) if x in bad), 5)
            for k, x in enumerate(order):
                key = (lang or "", "".join(order), k + 1)
                c = out.setdefault(key, [0] * 6)
                here = first == k
                for n, yes in enumerate((first > k, here, x in bad and first < k, bad == {x}, here and i in good, here and i in toxic)):
                    c[n] += yes
                whole[(lang or "", x)] = whole.get((lang or "", x), 0) + here
    return sorted((*key, *c, whole[key[0], key[1][key[2] - 1]]) for key, c in out.items())


def fixture():
    long = " ".join(f"w{k}" for k in range(300))
    texts = [None, "", "", long, long, long + " #", "a b " * 150, "A B " * 150, long + " X" * 40, "\x0b\x0c \t", " ".join(f"ü{k}\x85" for k in range(250)), "word " * 20_000, "PLAIN"]
    langs = ["en", None, "", "de"]
    rows = [(i * 3, t, langs[i % 4]) for i, t in enumerate(texts)]
    rows += [rows[3], (None, long, "en"), (None, None, None), (1, long, "en")]
    marks = [(9, 1, 0), (9, 0, 1), (12, None, 1), (None, 1, 1), (6, 1, None), (33, 0, 1), (18, 1, 1), (777, 1, 1)]
    return rows, marks


def rows_of(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", *filter_audit.COUNTS, "shapley").collect())


def test_equals_a_plain_replay(spark):
    rows, marks = fixture()
    got = rows_of(filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, MARKS)))
    assert got == plain_audit(rows, marks)
    assert len(got) == 600 * 3


def test_clashing_columns_and_empty_tables(spark):
    rows, marks = fixture()
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, MARKS)
    more = {c: F.lit("mine") for c in ("mask", "part", "step", "first", "bits", "bit", "_at", "good", "toxic", "quality", "keep_id", "_h", "_gh", "_of", "kept", "text_sha256", "filter_order")}
    got = rows_of(filter_audit.audit(docs.withColumns(more), known.withColumns({c: v for c, v in more.items() if c not in ("quality", "toxic")})))
    assert got == plain_audit(rows, marks)
    assert filter_audit.audit(docs.limit(0), known).count() == 0
    assert rows_of(filter_audit.audit(docs, known.limit(0))) == plain_audit(rows, [])


def test_query_equals_sql(spark):
    got = queries.op13_filter_audit(spark, f"{DATA}/sf0.001")
    assert spark_rows(got) == sql_rows(queries.OP13_SQL, "sf0.001")


def test_counts_are_combined_before_the_shuffle(spark):
    plan = filter_audit.replayed(spark.createDataFrame([("en", 3, True, False)], "part string, mask int, good boolean, toxic boolean"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "BroadcastNestedLoopJoin" in plan
