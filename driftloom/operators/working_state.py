"""What a session is about: constraints, decisions and the work in flight, folded turn by turn.

A folder answers with the whole next state as JSON; an answer that is none leaves the state as it was.
Batch and stream call one function for each turn, in order, and hold one state at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decision_client import EMPTY, STATE, state_in

Ask = Callable[[dict, str, str], str | None]
KEPT = "state string, turns long, failed long"
ROW = f"session_id long, {KEPT}"


def folded(state: dict, message: str, text: str, ask: Ask) -> tuple[dict, bool]:
    """(the state after a turn, whether the answer was good). Any error gives the previous state."""
    try:
        answer = ask(state, message, text)
        return (state, False) if answer is None else (state_in(answer), True)
    except (ValueError, LookupError):
        return state, False


PATH = re.compile(r"[\w./-]*\w\.(?:py|sql|md|toml|json|txt)\b")


def first_sentence(text: str) -> str:
    return re.split(r"[.\n]", text, maxsplit=1)[0].strip()


def topic(text: str) -> str:
    return re.split(r"[ ,]", text.lower(), maxsplit=1)[0]


def noting() -> Ask:
    """A local folder without a model. A user's first sentence is a constraint and the task in flight,
    an assistant's is a decision, planned while it lists things (a comma), with its first line as the
    rationale. A new item ends the live ones that begin with the same word. Paths in a turn are open files,
    those of Markdown files skills; the last safe point is the latest message of the assistant. Messages
    are named "role:turn"; other roles, and turns without a first sentence, get no answer."""

    def ask(state: dict, message: str, text: str) -> str | None:
        role, said = message.partition(":")[0], first_sentence(text)
        if role not in ("user", "assistant") or not said:
            return None
        new = json.loads(json.dumps(state))
        kind, item = ("constraints", {"text": said, "source_message": message}) if role == "user" else ("decisions", {"text": said, "rationale": text.split("\n", 1)[0], "planned": "," in said})
        for old in new[kind]:
            if old["superseded_by"] is None and topic(old["text"]) == topic(said):
                old["superseded_by"] = message
        new[kind].append(item | {"superseded_by": None})
        flying = new["in_flight"] or {"task": "", "last_safe_point": "", "open_files": [], "skill_paths": []}
        if role == "user":
            flying["task"] = said
        else:
            flying["last_safe_point"] = message
        for path in PATH.findall(text):
            held = flying["skill_paths" if path.endswith(".md") else "open_files"]
            if path not in held:
                held.append(path)
        return "Here it is:\n" + json.dumps(new | {"in_flight": flying}, ensure_ascii=False)

    return ask


def with_state(kept: DataFrame) -> DataFrame:
    return kept.withColumn("state", F.from_json("state", STATE))


def batch_states(turns: DataFrame, connect: Callable[[], Ask] = noting) -> DataFrame:
    """session_id, state, turns and failed of every session after all its turns.

    turns: session_id, turn, message, text. A session is dealt by a hash of its key and read in order by one
    task, which holds one state at a time. Rows without a session or a turn take no part; a null text is empty;
    of rows that repeat a turn each is folded, in the order of message and text.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        ask, session, state, n, failed = connect(), None, EMPTY, 0, 0

        def done():
            return pa.RecordBatch.from_pydict({"session_id": [session], "state": [json.dumps(state, ensure_ascii=False)], "turns": [n], "failed": [failed]})

        for batch in batches:
            for sid, message, text in zip(*(batch.column(k).to_pylist() for k in ("session_id", "message", "text")), strict=True):
                if sid != session:
                    if session is not None:
                        yield done()
                    session, state, n, failed = sid, EMPTY, 0, 0
                state, good = folded(state, message, text, ask)
                n, failed = n + 1, failed + (not good)
        if session is not None:
            yield done()

    return with_state(ordered(turns).mapInArrow(run, ROW))


def ordered(turns: DataFrame) -> DataFrame:
    rows = known(turns)
    return rows.repartition(F.xxhash64("session_id")).sortWithinPartitions("session_id", "turn", "message", "text")


def known(turns: DataFrame) -> DataFrame:
    return turns.where("session_id is not null and turn is not null").select(F.col("session_id").cast("long"), F.col("turn").cast("long"), F.coalesce("message", F.lit("")).alias("message"), F.coalesce("text", F.lit("")).alias("text"))


def stream_states(turns: DataFrame, connect: Callable[[], Ask] = noting) -> DataFrame:
    """The same after each micro-batch, for the sessions that had turns in it; state as JSON."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Folding(StatefulProcessor):
        def init(self, handle):
            self.kept, self.ask = handle.getValueState("working", KEPT), connect()

        def handleInputRows(self, key, rows, timer_values):
            state, n, failed = self.kept.get() if self.kept.exists() else (json.dumps(EMPTY), 0, 0)
            state = json.loads(state)
            for r in pd.concat(list(rows)).sort_values(["turn", "message", "text"], kind="stable").itertuples(index=False):
                state, good = folded(state, r.message, r.text, self.ask)
                n, failed = n + 1, failed + (not good)
            held = json.dumps(state, ensure_ascii=False), n, failed
            self.kept.update(held)
            yield pd.DataFrame([(int(key[0]), *held)], columns=["session_id", "state", "turns", "failed"])

        def close(self):
            pass

    return known(turns).groupBy("session_id").transformWithStateInPandas(statefulProcessor=Folding(), outputStructType=ROW, outputMode="Update", timeMode="None")
