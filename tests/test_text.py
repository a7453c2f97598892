"""Text functions against plain models, on chosen and on random strings."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from driftloom.functions import jsontext, markup
from driftloom.functions import text as X
from driftloom.operators import near_diff, search


def apply(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def random_texts(pool, n, seed=1, most=40):
    rng = random.Random(seed)
    return ["", *("".join(rng.choices(pool, k=rng.randint(1, most))) for _ in range(n))]


def model_ansi(t):
    out, i = [], 0
    while i < len(t):
        c = t[i]
        if c == "\x1b":
            i += 1
            if i < len(t) and t[i] == "[":
                i += 1
                while i < len(t) and not "@" <= t[i] <= "~":
                    i += 1
            i += 1
            continue
        if c in "\n\t" or not (ord(c) < 32 or 127 <= ord(c) < 160):
            out.append(c)
        i += 1
    return "".join(out)


def test_strip_ansi(spark):
    texts = random_texts("ab\x1b[[0;mK@~\r\n\t\x07\x9bé", 800)
    assert apply(spark, texts, X.strip_ansi) == [model_ansi(t) for t in texts]


def model_space(t):
    lines = [x.rstrip() for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    out = []
    for k, x in enumerate(lines):
        last = k == len(lines) - 1
        if x or last or not (out and out[-1] == ""):
            out.append(x)
    text = re.sub(r"\A\n{2,}", "\n", re.sub(r"\n{3,}", "\n\n", "\n".join(lines)))
    return text if t.endswith("\n") else text.rstrip("\n")


def test_normalize_space(spark):
    texts = random_texts("ab \t\n\n\n\r", 800)
    assert apply(spark, texts, X.normalize_space) == [model_space(t) for t in texts]


def test_head_tail_and_lines(spark):
    long = "\n".join(f"l{i}" for i in range(100))
    got = apply(spark, [long, long + "\n", "a\nb", "\n".join("x" * 60)], X.head_tail)
    assert got[0] == got[1] == "\n".join([f"l{i}" for i in range(40)] + ["[... 40 lines left out ...]"] + [f"l{i}" for i in range(80, 100)])
    assert got[2] is None and got[3] is None
    assert apply(spark, ["a\r\nb\n", ""], X.lines) == [["a", "b"], []]


def test_longest_blob_first_of_equals(spark):
    a, b = "A" * 600, "B" * 600
    assert apply(spark, [f"x {a} y {b} z", "short"], X.extract_blob) == [f"x [blob of 600 bytes left out] y {b} z", None]


def test_markers(spark):
    ref = "sha256:" + "a" * 64
    mark = spark.range(1).select(X.placeholder(F.lit(ref), F.lit(3), F.lit(9), F.lit("sum")).alias("m"), X.backref(F.lit(ref)).alias("b")).first()
    texts = [mark["m"] + " " + mark["b"], "ref=" + ref, mark["b"].replace("]", "0]")]
    assert apply(spark, texts, X.extract_refs) == [[ref, ref], [], []]
    assert apply(spark, [ref, ref.upper(), ref + "a", ref + "\n"], X.is_content_address) == [True, False, False, False]


PAGES = [
    ("<p>A &amp; B</p><p>C&nbsp;D</p>", "A & B\nC D"),
    ("<div>a</div>\n\n\n<div>b<br>c</div>", "a\n\nb\nc"),
    ("<td>x</td><td>y</td><td>z</td>", "x y z"),
    ("a<script>if (a < b) { x('</p>') }</script >b<style>p{}</style>", "ab"),
    ("<!-- c --><b>t</b><pre>  a\n\n\n\nb &lt; c</pre>after", "t  a\n\n\n\nb < c\nafter"),
    ("<a title='x > y'>q</a> 1 < 2", "q 1 < 2"),
    ("<p>open <", None),
    ("<p " + "x" * 300 + ">y</p>", None),
    ("no markup", None),
    ("<p>a<!-- never closed", None),
    ("", None),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_strip_html(page, want):
    assert markup.strip_html(page) == want


def test_html_detector(spark):
    code = "<div>" * 9
    mixed = "<div><p><span>" * 3
    texts = ["<!DOCTYPE HTML><p>", "  <html>", "<?xml version='1'?><html>", code, mixed, "x" + mixed, "<divx>" * 9]
    assert apply(spark, texts, markup.looks_like_html) == [True, True, False, False, True, False, False]


def test_minify_keeps_lexemes_and_order():
    text = '{ "b" : 1.10 , "a" : [1E6, 12345678901234567890 , " x  y "] }'
    assert jsontext.minify(text) == '{"b":1.10,"a":[1E6,12345678901234567890," x  y "]}'
    assert jsontext.minify('{"a": 1}\n{"a": 2}\n') == '[{"a":1},{"a":2}]'
    assert jsontext.minify("{a: 1}") is None and jsontext.minify("") is None and jsontext.minify("[NaN]") is None


def test_leanest_is_never_longer():
    rng = random.Random(2)
    for _ in range(200):
        rows = [{"id": i, "name": rng.choice(["x", "y,z", "a|b", "t\tt"]), "v": rng.choice([1.5, None, True, "é"])} for i in range(rng.randint(0, 6))]
        text = json.dumps(rows, ensure_ascii=False)
        assert len(jsontext.leanest(text).encode()) <= len(jsontext.minify(text).encode())
    assert jsontext.leanest("nope") is None


def read_cell(c):
    return json.loads(c) if re.fullmatch(r'".*"|true|false|null|-?[0-9.]+', c, re.S) else c


def read_toon(lines, at, depth):
    """A plain reader: (value, line after it) of what begins at a line, whose indentation is gone."""
    key = r'(?:"(?:[^"\\\\]|\\\\.)*"|[A-Za-z_][A-Za-z0-9_.]*)'
    name = lambda k: json.loads(k) if k[0] == '"' else k
    level = lambda k: len(lines[k]) - len(lines[k].lstrip(" ")) if k < len(lines) else -1

    def array(rest, at, depth):
        n, fields, cells = re.fullmatch(r"\[(\d+)\t\](?:\{(.*)\})?:(?: (.*))?", rest, re.S).groups()
        if fields is not None:
            rows = [lines[at + 1 + i].strip(" ").split("\t") for i in range(int(n))]
            return [dict(zip(map(name, fields.split("\t")), map(read_cell, r), strict=True)) for r in rows], at + 1 + int(n)
        if cells is not None or n == "0":
            return [] if n == "0" else list(map(read_cell, cells.split("\t"))), at + 1
        out, at = [], at + 1
        for _ in range(int(n)):
            item = lines[at].strip(" ")[2:]
            if not item:
                out, at = [*out, {}], at + 1
            elif item[0] == "[":
                v, at = array(item, at, depth + 2)
                out.append(v)
            elif re.match(key + r"(?::|\[\d+\t\])", item):
                lines[at] = " " * (depth + 4) + item
                v, at = read_toon(lines, at, depth + 4)
                out.append(v)
            else:
                out, at = [*out, read_cell(item)], at + 1
        return out, at

    if lines[at].lstrip(" ").startswith("["):
        return array(lines[at].lstrip(" "), at, depth)
    out = {}
    while level(at) == depth:
        k, rest = re.fullmatch(f"({key})(.*)", lines[at].lstrip(" "), re.S).groups()
        if rest[0] == "[":
            out[name(k)], at = array(rest, at, depth)
        elif rest != ":":
            out[name(k)], at = read_cell(rest[2:]), at + 1
        elif level(at + 1) > depth:
            out[name(k)], at = read_toon(lines, at + 1, depth + 2)
        else:
            out[name(k)], at = {}, at + 1
    return out, at


def read_tron(text):
    """Calls of a class become objects of its keys."""
    heads, body = text.split("\n\n", 1)
    classes = {m[1]: json.loads("[" + re.sub(r"(^|,)([A-Za-z_]\w*)(?=,|$)", r'\1"\2"', m[2]) + "]") for m in re.finditer(r"^class (\w+): (.*)$", heads, re.M)}
    marked = re.sub(r'("(?:[^"\\]|\\.)*")|([A-Z]\d*)\(|\)', lambda m: m[1] or (f'{{"class":"{m[2]}","values":[' if m[2] else "]}"), body)
    made = lambda o: dict(zip(classes[o["class"]], o["values"], strict=True)) if list(o) == ["class", "values"] else o
    return json.loads(marked, object_hook=made)


def random_value(rng, depth):
    kind = rng.randint(0, 3 if depth else 1)
    if kind < 2:
        return rng.choice(["x", "", "a b", " pad", "null", "12", "-", "a:b", "q\"\\", "é\n", "t\tt", "[1]", 0, -5, 1.5, 100, True, False, None])
    if kind == 2:
        return {k: random_value(rng, depth - 1) for k in rng.sample(["id", "a b", "x.y", "", "n-1", "k", "2"], rng.randint(0, 3))}
    if rng.random() < 0.4:
        return [{"id": random_value(rng, 0), "a:b": random_value(rng, 0)} for _ in range(rng.randint(2, 4))]
    return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def test_toon_and_tron_round_trip():
    rng, both = random.Random(5), [0, 0]
    for _ in range(3_000):
        value = random_value(rng, 4)
        if not isinstance(value, dict | list) or not value:
            continue
        parsed = jsontext.LOSSLESS.decode(json.dumps(value, ensure_ascii=False))
        said = jsontext.toon(parsed)
        assert read_toon(said.split("\n"), 0, 0)[0] == value, said
        if (said := jsontext.tron(parsed)) is not None:
            assert read_tron(said) == value, said
            both[1] += 1
        both[0] += 1
    assert both[0] > 500 and both[1] > 100


def test_leanest_encodings():
    assert jsontext.toon(jsontext.DECODER.decode('{"a":{"b":[1,"x y"]},"r":[{"i":1,"n":"u"},{"i":2,"n":"v"}]}')) == "a:\n  b[2\t]: 1\tx y\nr[2\t]{i\tn}:\n  1\tu\n  2\tv"
    assert jsontext.tron(jsontext.DECODER.decode('[{"i":1.0,"n":[]},{"i":2,"n":{"z":0}}]')) == 'class A: i,n\n\n[A(1.0,[]),A(2,{"z":0})]'
    for number in ("1E6", "1.0", "-0", "12345678901234567890"):  # would not come back as they were written
        assert jsontext.toon(jsontext.DECODER.decode(f"[{number}]")) is None
    for text in ('{"a":1,"a":2}', '[{"a":"\\ud800"},{"a":"\\ud800"}]', "[]", "{}", "3", '"x"', "[" * 400 + "]" * 400):
        assert len(jsontext.leanest(text)) <= len(text)
    assert jsontext.leanest('{"a":1,"a":2}') == '{"a":1,"a":2}'


def test_difference_rebuilds():
    rng = random.Random(3)
    made = 0
    for _ in range(60):
        base = [f"line {i} {rng.random()}" for i in range(rng.randint(60, 160))]
        target = list(base)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(target))
            target[k : k + rng.randint(0, 2)] = [f"new {rng.random()}"] * rng.randint(0, 2)
        a, b = "\n".join(base), "\n".join(target)
        if (d := near_diff.difference(a, b, "tool", "7")) is not None:
            made += 1
            assert near_diff.rebuilt(a, d) == b and 2 * len(d.encode()) <= len(b.encode())
    assert made > 40
    assert near_diff.difference("short", "short", "t", "1") is None


def test_differences_follow_bases(spark):
    text = lambda k: "\n".join(f"{i} {'x' * 30}" + ("!" if i == k else "") for i in range(60))
    rows = [("s", k, "t", text(k)) for k in range(4)] + [("s", 9, "other", text(1)), ("q", 1, "t", text(2)), ("s", 10, "t", None)]
    out = near_diff.sequential_diffs(spark.createDataFrame(rows, "session_id string, seq long, tool string, content string")).where("diff is not null")
    assert sorted((r["session_id"], r["seq"], r["base_seq"]) for r in out.collect()) == [("s", 1, 0), ("s", 2, 0), ("s", 3, 0)]


def test_search_within(spark):
    doc = "\n".join(["alpha beta", "gamma", "beta beta", "delta", "", "epsilon beta", "zeta"])
    rows = [(1, doc, "beta"), (2, doc, ""), (3, doc, "nothing here"), (4, "", "beta")]
    out = search.search_within(spark.createDataFrame(rows, "id int, doc string, query string")).orderBy("id").collect()
    assert [r["found"] for r in out] == ["alpha beta\nbeta beta\nepsilon beta", "alpha beta\ngamma\nbeta beta\ndelta\nepsilon beta", "alpha beta\ngamma\nbeta beta\ndelta\nepsilon beta", ""]
