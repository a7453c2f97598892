"""The state of a session, folded over its usage observations: in a stream, or in a batch that gives
the same. Both call one pure function for each observation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.economics import SCALE_FRESH, TURN_FRESH, TURN_SEED
from ..scratch import scratch_path

WARM_TURNS, COOLDOWN_S, OVERRUN = 2, 60.0, 4
OBSERVATION = "session_id long, seq long, at double, creation long, read long, input long, estimated long, predicted long, messages long"


@dataclass
class State:
    turn: int = 0
    prefix: int = 0
    last_at: float = 0.0
    remaining: float = TURN_SEED
    scale: float = 1.0
    open_until: float = -1e18
    trips: int = 0
    floor: int = 0


STATE = ", ".join(f"{f.name} {'double' if f.type == 'float' else 'long'}" for f in fields(State))
ROW = f"session_id long, {STATE}"


def observed(s: State, at: float, creation: int, read: int, used: int, estimated: int | None, predicted: int | None, messages: int) -> State:
    """The state after one response: its cached prefix, turn, expected turns, token scale, breaker
    and message floor, in this order. An open breaker takes no notice until its time is over."""
    turn = s.turn + 1
    scale = s.scale
    total = read + creation + used
    if estimated is not None and estimated > 0 and total > 0:
        ratio = total / estimated
        scale = ratio if scale == 1.0 else (1 - SCALE_FRESH) * scale + SCALE_FRESH * ratio
    cold = creation == 0 and read == 0
    over = predicted is not None and creation > OVERRUN * predicted
    failed = turn >= WARM_TURNS and (cold or over)
    trips, open_until = s.trips, s.open_until
    if failed and at >= open_until:
        trips, open_until = trips + 1, at + COOLDOWN_S
    return State(turn, read + creation, at, TURN_FRESH * turn + (1 - TURN_FRESH) * s.remaining, scale, open_until, trips, max(s.floor, messages))


def batch_states(observations: DataFrame) -> DataFrame:
    """The last state of every session. Observations of a session are read in order by one task that
    holds one state at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        names = ["session_id", *(f.name for f in fields(State))]
        types = [pa.int64(), *(pa.float64() if f.type == "float" else pa.int64() for f in fields(State))]

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        session, state, done = None, State(), []
        for batch in batches:
            for sid, _, *rest in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if sid != session:
                    if session is not None:
                        done.append((session, *astuple(state)))
                    session, state = sid, State()
                state = observed(state, *rest)
            if done:
                yield rows(done)
                done = []
        if session is not None:
            yield rows([(session, *astuple(state))])

    ordered = observations.where("session_id is not null").repartition(F.xxhash64("session_id")).sortWithinPartitions("session_id", "at", "seq")
    return ordered.mapInArrow(run, ROW)


def stream_states(observations: DataFrame) -> DataFrame:
    """The state of every session after each micro-batch that has observations of it."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Sessions(StatefulProcessor):
        def init(self, handle):
            self.kept = handle.getValueState("state", STATE)

        def handleInputRows(self, key, rows, timer_values):
            state = State(*self.kept.get()) if self.kept.exists() else State()
            found = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
            for r in found.itertuples(index=False):
                none = lambda x: None if pd.isna(x) else int(x)
                state = observed(state, float(r.at), int(r.creation), int(r.read), int(r.input), none(r.estimated), none(r.predicted), int(r.messages))
            self.kept.update(astuple(state))
            yield pd.DataFrame([(int(key[0]), *astuple(state))], columns=["session_id", *(f.name for f in fields(State))])

        def close(self):
            pass

    return observations.where("session_id is not null").groupBy("session_id").transformWithStateInPandas(statefulProcessor=Sessions(), outputStructType=ROW, outputMode="Update", timeMode="None")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_stream(spark: SparkSession, observations: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream of observations over what is there now, and return the last state of each session.
    folder: shared by driver and executors; holds the stream's checkpoint and its output."""
    own = f"{folder}/sessions-{uuid.uuid4().hex}" if folder else scratch_path(spark, "sessions")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        states = stream_states(observations)
        # one folder for each batch: a batch that is run again replaces what it wrote before
        save = lambda df, k: df.write.mode("overwrite").parquet(f"{own}/out/batch={k}")
        started = states.writeStream.outputMode("update").option("checkpointLocation", f"{own}/log").trigger(availableNow=True).foreachBatch(save).start()
        started.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    out = spark.read.schema(ROW).parquet(f"{own}/out")
    last = out.groupBy("session_id").agg(F.max(F.struct("turn", *[f.name for f in fields(State) if f.name != "turn"])).alias("s"))
    return last.select("session_id", "s.*")


def lane_after(before, committed, uncommitted):
    """Keys rendered again each turn: those committed join first, then those uncommitted leave."""
    return F.array_except(F.array_union(before, committed), uncommitted)
