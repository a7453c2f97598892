"""JSON as text: minified without touching number lexemes or key order, and leaner encodings."""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LEXEME = re.compile(r'"(?:[^"\\]|\\.)*"|[ \t\n\r]+', re.S)
SPACE = re.compile(r"[ \t\n\r]*")


class Number(str):
    """A number as it was written."""


def _refuse(name: str):
    raise ValueError(name)


def _unique(pairs: list) -> dict:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a key twice")
    return found


DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)
#: The same where re-encoding must not lose a key that occurs twice.
LOSSLESS = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse, object_pairs_hook=_unique)
#: What TOON writes without quotes (fixed by the format): keys, and no string that reads as anything else.
BARE_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
NOT_BARE = re.compile(r'[:"\\\[\]{}\x00-\x1f]|^-|^\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$')
UNESCAPED = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
SAFE_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d*[1-9])?")


def documents(text: str) -> list[tuple[int, int]] | None:
    """Where each of the JSON documents of a text starts and ends; None if it is anything else."""
    found, at = [], SPACE.match(text).end()
    while at < len(text):
        try:
            _, end = DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            return None
        found.append((at, end))
        at = SPACE.match(text, end).end()
    return found or None


def compact(text: str) -> str:
    return LEXEME.sub(lambda m: m[0] if m[0][0] == '"' else "", text)


def minify(text: str) -> str | None:
    """Without white space between tokens; several documents become one array. None if not JSON."""
    spans = documents(text)
    if spans is None:
        return None
    parts = [compact(text[a:b]) for a, b in spans]
    return parts[0] if len(parts) == 1 else "[" + ",".join(parts) + "]"


def written(value) -> str:
    if isinstance(value, Number):
        return str(value)
    return json.dumps(value, ensure_ascii=False) if not isinstance(value, dict | list) else None


def table_of(value) -> tuple[list[str], list[list[str]]] | None:
    """Keys and written cells of an array of objects with the same keys and plain values."""
    if not isinstance(value, list) or len(value) < 2 or not all(isinstance(r, dict) and r for r in value):
        return None
    keys = list(value[0])
    if any(list(r) != keys for r in value):
        return None
    rows = [[written(r[k]) for k in keys] for r in value]
    return None if any(c is None for r in rows for c in r) else (keys, rows)


def delimited(keys: list[str], rows: list[list[str]], sep: str) -> str | None:
    """Cells as JSON scalars, so that reading them back gives the values; separators inside refuse."""
    cells = [[json.dumps(k, ensure_ascii=False) for k in keys], *rows]
    return None if any(sep in c or "\n" in c for r in cells for c in r) else "\n".join(sep.join(r) for r in cells)


def markdown(keys: list[str], rows: list[list[str]]) -> str | None:
    if any("|" in c or "\n" in c for r in [keys, *rows] for c in r):
        return None
    line = lambda cells: "|" + "|".join(cells) + "|"
    return "\n".join([line(keys), line(["-"] * len(keys)), *map(line, rows)])


def toon_cell(value) -> str:
    """A plain value for TOON. Numbers that a reader may write differently, and control characters without an
    escape there, are refused."""
    if isinstance(value, Number):
        if not SAFE_NUMBER.fullmatch(value) or value == "-0" or sum(map(str.isdigit, value)) > 15:
            raise ValueError(value)
        return str(value)
    if not isinstance(value, str):
        return json.dumps(value)
    if not (value == "" or value != value.strip() or value in ("true", "false", "null") or NOT_BARE.search(value)):
        return value
    if UNESCAPED.search(value):
        raise ValueError(value)
    return json.dumps(value, ensure_ascii=False)


def toon_key(key: str) -> str:
    return key if BARE_KEY.fullmatch(key) else toon_cell(key) if NOT_BARE.search(key) or not key else json.dumps(key, ensure_ascii=False)


def toon_lines(head: str, value, pad: str):
    """The lines of a value under a key, an item or nothing."""
    if isinstance(value, dict):
        if head:
            yield f"{pad}{head}:"
        for k, v in value.items():
            yield from toon_lines(toon_key(k), v, pad + "  " if head else pad)
    elif not isinstance(value, list):
        yield f"{pad}{head}: {toon_cell(value)}" if head else pad + toon_cell(value)
    elif not any(isinstance(v, dict | list) for v in value):
        yield f"{pad}{head}[{len(value)}\t]:" + (" " if value else "") + "\t".join(map(toon_cell, value))
    elif table_of(value) is not None:
        yield f"{pad}{head}[{len(value)}\t]{{" + "\t".join(map(toon_key, value[0])) + "}:"
        for row in value:
            yield f"{pad}  " + "\t".join(map(toon_cell, row.values()))
    else:
        yield f"{pad}{head}[{len(value)}\t]:"
        for v in value:
            inner = pad + ("    " if isinstance(v, dict) else "  ")
            lines = list(toon_lines("", v, inner))
            yield f"{pad}  - {lines[0][len(inner):]}" if lines else f"{pad}  -"
            yield from lines[1:]


def toon(value) -> str | None:
    """Indented by two spaces, tabs between cells, keys of equal rows once. None where a value does not fit."""
    try:
        return "\n".join(toon_lines("", value, ""))
    except (ValueError, RecursionError):
        return None


def shapes(value, seen: Counter) -> Counter:
    """How often objects of the same keys in the same order occur."""
    if isinstance(value, dict):
        if value:
            seen[tuple(value)] += 1
        value = value.values()
    elif not isinstance(value, list):
        return seen
    for v in value:
        shapes(v, seen)
    return seen


def tron(value) -> str | None:
    """JSON with a class for every shape that objects repeat: its keys once at the top, then calls of it."""
    try:
        named = {keys: class_name(i) for i, keys in enumerate(k for k, n in shapes(value, Counter()).items() if n > 1)}
        if not named:
            return None
        quoted = lambda k: json.dumps(k, ensure_ascii=False)

        def said(v) -> str:
            if isinstance(v, list):
                return "[" + ",".join(map(said, v)) + "]"
            if not isinstance(v, dict):
                return written(v)
            if name := named.get(tuple(v)):
                return f"{name}(" + ",".join(map(said, v.values())) + ")"
            return "{" + ",".join(f"{quoted(k)}:{said(x)}" for k, x in v.items()) + "}"

        heads = [f"class {name}: " + ",".join(k if BARE_KEY.fullmatch(k) and "." not in k else quoted(k) for k in keys) for keys, name in named.items()]
        return "\n".join([*heads, "", said(value)])
    except RecursionError:
        return None


def class_name(i: int) -> str:
    """A to Z, then A1 to Z1, and so on."""
    return chr(65 + i % 26) + (str(i // 26) if i >= 26 else "")


def sized(text: str | None) -> int | None:
    """Its UTF-8 bytes; None for no text, and for halves of surrogate pairs, which have none."""
    try:
        return None if text is None else len(text.encode())
    except UnicodeEncodeError:
        return None


def leanest(text: str) -> str | None:
    """The shortest of the compact, the tabular, the indented and the class-table encodings, never longer
    than compact; None if the text is not JSON. Objects that repeat a key stay compact, as do halves of
    surrogate pairs."""
    small = minify(text)
    if small is None:
        return None
    options = [small]
    try:
        value = LOSSLESS.decode(small)
    except (ValueError, RecursionError):
        return small
    if isinstance(value, list) and value:
        spans, at = [], 1
        while at < len(small) - 1:
            _, end = DECODER.raw_decode(small, at)
            spans.append(small[at:end])
            at = end + 1
        if len(spans) > 1:
            options.append("\n".join(spans))
    if (found := table_of(value)) is not None:
        options += [delimited(*found, ","), delimited(*found, "\t"), markdown(*found)]
    options += [toon(value), tron(value)] if isinstance(value, dict | list) and value else []
    return min((x for x in options if x is small or sized(x) is not None), key=lambda x: sized(x) or 0)


@F.arrow_udf(StringType())
def minify_udf(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else minify(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def leanest_udf(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else leanest(t) for t in texts.to_pylist()], pa.string())
