"""Asking a remote model from Arrow workers: what to do with a segment, and what a session is about.

A call has a deadline that holds for all its attempts and waits together. Only an overloaded or
limiting answer is tried again. Whatever goes wrong, the row keeps its text (or its earlier state), and
says how many attempts were made and why it kept it. Rows too short to be worth a call make none.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scoring

#: Answers that are tried again, the waits between attempts where the answer names none, and the deadline.
AGAIN, WAITS, DEADLINE_S = (429, 529), (2.0, 8.0), 120.0
DECISION_TOKENS, FOLD_TOKENS, LEAST_CHARS = 10_240, 16_384, 256

DECIDE = """You decide how one segment of a long conversation is kept. Answer with one JSON object:
{"choice": "keep" | "truncate" | "summarize" | "compress", "ranges_to_keep": [{"start": 1, "end": 3}], "summary_content": "..."}.
Ranges are lines counted from 1 and go with "truncate"; summary_content goes with "summarize". Segments tagged as constraints are kept."""
FOLD = """You keep the working state of a conversation. Answer with one JSON object that has "constraints" (text, source_message,
superseded_by), "decisions" (text, rationale, planned, superseded_by) and "in_flight" (task, last_safe_point, open_files, skill_paths).
Copy live constraints word for word; name in superseded_by the message that ended one."""


@dataclass(frozen=True)
class Request:
    """One attempt. timeout: what is left until the deadline; attempt counts from 1."""

    body: bytes
    timeout: float
    attempt: int


@dataclass(frozen=True)
class Answer:
    status: int
    body: bytes = b""
    retry_after: str | None = None


class CallFailed(Exception):
    """A transport error; Timeout where the deadline is over."""


Transport = Callable[[Request], Answer]


@dataclass
class Clock:
    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep


def http(url: str, headers: dict[str, str]) -> Callable[[], tuple[Transport, Clock]]:
    """Posts to url with the session's own headers. Made once in each task."""

    def make() -> tuple[Transport, Clock]:
        def send(r: Request) -> Answer:
            asked = urllib.request.Request(url, r.body, {**headers, "content-type": "application/json"}, method="POST")
            try:
                with urllib.request.urlopen(asked, timeout=max(r.timeout, 0.001)) as got:
                    return Answer(got.status, got.read(), got.headers.get("retry-after"))
            except urllib.error.HTTPError as e:
                return Answer(e.code, b"", e.headers.get("retry-after"))
            except TimeoutError as e:
                raise CallFailed("timeout") from e
            except OSError as e:
                raise CallFailed("timeout" if "timed out" in str(e) else "unreachable") from e

        return send, Clock()

    return make


@dataclass(frozen=True)
class Client:
    """connect: gives a transport and its clock, once in each task. parallel: calls open at once in a task."""

    connect: Callable[[], tuple[Transport, Clock]]
    model: str
    parallel: int = 4
    deadline: float = DEADLINE_S
    waits: tuple[float, ...] = WAITS
    again: tuple[int, ...] = field(default=AGAIN)


def wait_of(answer: Answer, usual: float) -> float:
    """Whole seconds that the answer asks for, else the usual wait."""
    asked = (answer.retry_after or "").strip()
    return float(asked) if asked.isascii() and asked.isdigit() else usual


def text_of(body: bytes) -> str:
    """The text blocks of an answer joined; anything else is an error."""
    blocks = json.loads(body)["content"]
    if any(b["type"] != "text" for b in blocks):
        raise ValueError("a block that is no text")
    return "".join(b["text"] for b in blocks)


def called(client: Client, transport: Transport, clock: Clock, system: str, user: str, most: int) -> tuple[str | None, int, str]:
    """(text, attempts, outcome). The text is null unless the outcome is "ok"."""
    body = json.dumps({"model": client.model, "max_tokens": most, "system": system, "messages": [{"role": "user", "content": user}]}, ensure_ascii=False).encode()
    ends, waits, attempt = clock.now() + client.deadline, iter(client.waits), 0
    while True:
        attempt += 1
        try:
            answer = transport(Request(body, ends - clock.now(), attempt))
        except CallFailed as e:
            return None, attempt, str(e)
        if clock.now() > ends:
            return None, attempt, "timeout"
        usual = next(waits, None)
        if answer.status not in client.again or usual is None:
            break
        wait = wait_of(answer, usual)
        if clock.now() + wait >= ends:  # the deadline would pass while waiting
            return None, attempt, "timeout"
        clock.sleep(wait)
    if not 200 <= answer.status < 300:
        return None, attempt, f"status {answer.status}"
    try:
        return text_of(answer.body), attempt, "ok"
    except (ValueError, KeyError, TypeError):
        return None, attempt, "malformed"


def object_in(text: str) -> dict:
    """The JSON object between the first and the last brace of a text."""
    first, last = text.find("{"), text.rfind("}")
    if first < 0 or last < first:
        raise LookupError("no JSON")
    found = json.loads(text[first : last + 1])
    if not isinstance(found, dict):
        raise ValueError("no object")
    return found


CHOICES = ("truncate", "summarize", "compress", "keep")


def is_count(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def decision_in(text: str) -> tuple[str, list[dict], str | None]:
    d = object_in(text)
    ranges, summary = d.get("ranges_to_keep", []), d.get("summary_content")
    if d.get("choice") not in CHOICES or not isinstance(ranges, list) or not (summary is None or isinstance(summary, str)):
        raise ValueError("no decision")
    if not all(isinstance(r, dict) and is_count(r.get("start")) and is_count(r.get("end")) for r in ranges):
        raise ValueError("no ranges")
    return d["choice"], [{"start": r["start"], "end": r["end"]} for r in ranges], summary


RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ASKED = [T.StructField("_choice", T.StringType()), T.StructField("_ranges", RANGES), T.StructField("_summary", T.StringType()), T.StructField("_attempts", T.IntegerType()), T.StructField("_outcome", T.StringType())]


def decided(df: DataFrame, client: Client, content: str = "content", tags: str | None = None, least: int = LEAST_CHARS) -> DataFrame:
    """Add decision: struct<choice, ranges_to_keep, summary_content, attempts, outcome>.

    Contents of fewer than `least` characters (null: none) are kept without a call: outcome "gated", no
    attempts. A failure keeps the row as well; its outcome is "status N", "timeout", "unreachable", "malformed"
    (no answer of the protocol), "no json" or "unparsed". A truncation without ranges keeps, a summary
    without text compresses, one longer than its original keeps. A row is asked once by each task that
    works it out, so write the result before using it twice. tags: an array column that is shown
    with the content. Rows are neither moved nor dropped; an empty table stays empty.
    """
    schema = T.StructType([*df.schema.fields, *ASKED])
    at = df.columns.index(content)
    shown = df.columns.index(tags) if tags else None

    def run(batches: Iterator[pa.RecordBatch]):
        transport, clock = client.connect()

        def one(text: str | None, marks: list | None):
            text = text or ""
            if len(text) < least:
                return "keep", [], None, 0, "gated"
            user = f"<tags>{', '.join(marks or [])}</tags>\n<content>\n{text}\n</content>"
            said, attempts, outcome = called(client, transport, clock, DECIDE, user, DECISION_TOKENS)
            if said is None:
                return "keep", [], None, attempts, outcome
            try:
                return *decision_in(said), attempts, "ok"
            except LookupError:
                return "keep", [], None, attempts, "no json"
            except ValueError:
                return "keep", [], None, attempts, "unparsed"

        with ThreadPoolExecutor(client.parallel) as pool:
            for batch in batches:
                marks = batch.column(shown).to_pylist() if shown is not None else [None] * batch.num_rows
                made = list(pool.map(one, batch.column(at).to_pylist(), marks))
                kinds = [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string(), pa.int32(), pa.string()]
                cols = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

    asked = df.mapInArrow(run, schema)
    chars = F.coalesce(F.char_length(F.col(content)), F.lit(0))
    whole = F.struct(
        chosen(F.col("_choice"), F.col("_ranges"), F.col("_summary"), chars, least).alias("choice"), F.col("_ranges").alias("ranges_to_keep"), F.col("_summary").alias("summary_content"), F.col("_attempts").alias("attempts"), F.col("_outcome").alias("outcome")
    )
    return asked.withColumn("decision", whole).drop(*[f.name for f in ASKED])


def chosen(choice: Column, ranges: Column, summary: Column, chars: Column, least: int) -> Column:
    return scoring.pre_gated(scoring.repaired(choice, F.size(ranges), summary), chars, summary, least)


# what a session is about

STATE = T.StructType(
    [
        T.StructField("constraints", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "source_message", "superseded_by")]))),
        T.StructField("decisions", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("rationale", T.StringType()), T.StructField("planned", T.BooleanType()), T.StructField("superseded_by", T.StringType())]))),
        T.StructField("in_flight", T.StructType([T.StructField("task", T.StringType()), T.StructField("last_safe_point", T.StringType()), T.StructField("open_files", T.ArrayType(T.StringType())), T.StructField("skill_paths", T.ArrayType(T.StringType()))])),
    ]
)
EMPTY: dict = {"constraints": [], "decisions": [], "in_flight": None}


def record(value, needed: dict[str, type], lists: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> dict:
    """The named fields of a JSON object: needed ones have their type, lists are of strings and may lack."""
    if not isinstance(value, dict) or any(not isinstance(value.get(k), kind) for k, kind in needed.items()):
        raise ValueError("a field is missing")
    out = {k: value[k] for k in needed}
    for k in lists:
        out[k] = value.get(k, [])
        if not isinstance(out[k], list) or not all(isinstance(x, str) for x in out[k]):
            raise ValueError(f"{k} is no list of strings")
    for k in optional:
        out[k] = value.get(k)
        if not (out[k] is None or isinstance(out[k], str)):
            raise ValueError(f"{k} is no string")
    return out


def state_in(text: str) -> dict:
    """The working state that an answer holds; unknown fields are passed over, a missing list is empty."""
    d = object_in(text)
    for k in ("constraints", "decisions"):
        if not isinstance(d.get(k, []), list):
            raise ValueError(f"{k} is no list")
    flying = d.get("in_flight")
    return {
        "constraints": [record(c, {"text": str, "source_message": str}, optional=("superseded_by",)) for c in d.get("constraints", [])],
        "decisions": [record(c, {"text": str, "rationale": str, "planned": bool}, optional=("superseded_by",)) for c in d.get("decisions", [])],
        "in_flight": None if flying is None else record(flying, {"task": str, "last_safe_point": str}, lists=("open_files", "skill_paths")),
    }


def folded_by(client: Client) -> Callable[[], Callable[[dict, str, str], str | None]]:
    """A folder for working_state: the state so far and a turn go to the model, and its answer comes back
    (null after a failure)."""

    def make():
        transport, clock = client.connect()

        def ask(state: dict, message: str, text: str) -> str | None:
            user = f"<state>\n{json.dumps(state, ensure_ascii=False, indent=1)}\n</state>\n<turns message={json.dumps(message)}>\n{text}\n</turns>"
            return called(client, transport, clock, FOLD, user, FOLD_TOKENS)[0]

        return ask

    return make
