"""Everything that happens to a session, in one keyed state: requests, responses, plans, control.

Two inputs (what the relay saw, what was planned or commanded off its path) are one stream of events of a
session, told apart by kind:

    request  forwarded after inspection: number (messages, null if unreadable), size (estimated prefix),
             key and place (a leaf that may be cleaned, and its message), done (the rewrite held)
    bypass   forwarded without inspection
    usage    of a response: number, size and place are tokens created, read and fresh
    plan     staged for the next request, in place of an earlier one: key (what it covers), number (predicted tokens)
    evict    the session is over

One pure function is called for each event, by a stream and by a batch that gives the same rows. Times are
milliseconds of the events themselves, never of the clock, so a replay gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableSet
from dataclasses import astuple, dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.economics import SCALE_FRESH, TURN_FRESH, TURN_SEED
from .session_state import OVERRUN, WARM_TURNS

EVENT = "session_id long, seq long, at long, kind string, number long, size long, place long, key string, done boolean"
NEVER = -(10**15)
#: Event times as Spark sees them are so far ahead (317 years): its watermark starts at 0, and drops what is not later.
AHEAD = 10**13


@dataclass(frozen=True)
class Limits:
    """The breaker opens for so long, and a session without events for so long is forgotten."""

    cooldown_ms: int = 60_000
    idle_ms: int = 7 * 24 * 3_600_000


@dataclass
class Session:
    turn: int = 0
    prefix: int = 0
    last_at: int = NEVER
    last_seq: int = -1
    remaining: float = TURN_SEED
    scale: float = 1.0
    open_until: int = NEVER
    tripped_by: int = -1
    trips: int = 0
    floor: int = 0
    closed: bool = True
    estimated: int = -1
    predicted: int = -1
    plan: str = ""
    plan_seq: int = -1
    plan_tokens: int = -1
    lane: int = 0


KIND = {"int": "long", "float": "double", "bool": "boolean", "str": "string"}
STATE = ", ".join(f"{f.name} {KIND[f.type]}" for f in fields(Session))
ROW = (
    "session_id long, seq long, kind string, turn long, prefix long, remaining double, scale double, enabled boolean, trips long, floor long, closed boolean, "
    "used long, staged long, lane long, entered boolean, left boolean"
)
COLUMNS = [x.split()[0] for x in ROW.split(", ")]


@dataclass
class Event:
    seq: int
    at: int
    kind: str
    number: int | None
    size: int | None
    place: int | None
    key: str | None
    done: bool | None


def row(session: int, s: Session, seq: int, at: int, kind: str, used: int | None = None, entered: bool = False, left: bool = False) -> tuple:
    return (session, seq, kind, s.turn, s.prefix, s.remaining, s.scale, at >= s.open_until, s.trips, s.floor, s.closed, used, s.plan_seq if s.plan_seq >= 0 else None, s.lane, entered, left)


def closes(session: int, s: Session, until: int) -> tuple[Session, list[tuple]]:
    """The breaker closes by itself once its time is over, without another observation."""
    if s.tripped_by < 0 or until < s.open_until:
        return s, []
    shut = replace(s, tripped_by=-1)
    return shut, [row(session, shut, s.tripped_by, s.open_until, "breaker_closed")]


def expired(s: Session, until: int, limits: Limits) -> bool:
    return s.last_at != NEVER and until >= s.last_at + limits.idle_ms


def step(session: int, s: Session, lane: MutableSet[str], e: Event, limits: Limits) -> tuple[Session, list[tuple]]:
    """The state after an event, and the rows that it gives. lane: the keys of leaves that are cleaned each turn."""
    s, out = closes(session, s, e.at)
    if expired(s, e.at, limits):
        out.append(row(session, Session(), s.last_seq, s.last_at, "expired"))
        s = Session()
        lane.clear()
    s = replace(s, last_at=e.at, last_seq=e.seq)
    used, entered, left = None, False, False
    if e.kind == "request":
        if e.at >= s.open_until:  # an open breaker leaves the request, and the plan, as they are
            covered = s.plan
            if s.plan_seq >= 0:  # taken, whether the rewrite holds or not
                used = s.plan_seq
                s = replace(s, plan="", plan_seq=-1, plan_tokens=-1, predicted=s.plan_tokens if e.done else s.predicted)
            if e.key is not None and e.done:
                held = e.key in lane
                fresh = not held and covered != e.key and not s.closed and e.place is not None and e.place >= s.floor
                if fresh:
                    lane.add(e.key)
                    entered = True
                elif held and covered == e.key:
                    lane.discard(e.key)
                    left = True
                s = replace(s, lane=s.lane + entered - left)
        s = replace(s, estimated=max(e.size or 0, 0))
        if e.number is not None:
            s = replace(s, floor=max(s.floor, e.number), closed=False)
    elif e.kind == "bypass":
        s = replace(s, closed=True)
    elif e.kind == "plan":
        s = replace(s, plan=e.key or "", plan_seq=e.seq, plan_tokens=e.number or 0)
    elif e.kind == "usage":
        s = observed(s, e, limits)
    elif e.kind == "evict":
        s = Session()
        lane.clear()
    out.append(row(session, s, e.seq, e.at, e.kind, used, entered, left))
    return s, out


def observed(s: Session, e: Event, limits: Limits) -> Session:
    """A response: the cached prefix, the turn, the scale against the estimate of the request before it and the
    breaker against the prediction, both taken once."""
    creation, read, fresh = e.number or 0, e.size or 0, e.place or 0
    turn, total, scale = s.turn + 1, creation + read + fresh, s.scale
    if s.estimated > 0 and total > 0:
        ratio = total / s.estimated
        scale = ratio if scale == 1.0 else (1 - SCALE_FRESH) * scale + SCALE_FRESH * ratio
    failed = turn >= WARM_TURNS and ((creation == 0 and read == 0) or (s.predicted >= 0 and creation > OVERRUN * s.predicted))
    trips, until, by = s.trips, s.open_until, s.tripped_by
    if failed and e.at >= until:
        trips, until, by = trips + 1, e.at + limits.cooldown_ms, e.seq
    return replace(s, turn=turn, prefix=creation + read, remaining=TURN_FRESH * turn + (1 - TURN_FRESH) * s.remaining, scale=scale, estimated=-1, predicted=-1, trips=trips, open_until=until, tripped_by=by)


def known(events: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in EVENT.split(", ")]
    return events.where("session_id is not null and at is not null").select(*names)


def batch_log(events: DataFrame, watermark: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """The rows of all events, in one pass over each session.

    events: EVENT. Rows of a session are dealt by a hash of its key and read in the order of (at, seq) by one
    task that holds its state and its lane. watermark: one row (until) in milliseconds; timers up to
    then have fired, also for sessions whose events have ended. Rows without a session or a time take no part.
    """
    rows = known(events)
    rows = rows.crossJoin(F.broadcast(watermark.select(F.col("until").cast("long")))) if watermark is not None else rows.withColumn("until", F.lit(NEVER).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]):
        session, s, lane, last = None, Session(), set(), NEVER

        def ended():
            if session is None:
                return []
            after, out = closes(session, s, last)
            return out + ([row(session, Session(), after.last_seq, after.last_at, "expired")] if expired(after, last, limits) else [])

        def given(out):
            return pa.RecordBatch.from_pylist([dict(zip(COLUMNS, r, strict=True)) for r in out], schema=SCHEMA)

        for batch in batches:
            out = []
            for sid, *rest, until in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sid != session:
                    out += ended()
                    session, s, lane, last = sid, Session(), set(), until
                s, rows = step(sid, s, lane, Event(*rest), limits)
                out += rows
            if out:
                yield given(out)
        if out := ended():
            yield given(out)

    dealt = rows.repartition(F.xxhash64("session_id")).sortWithinPartitions("session_id", "at", "seq")
    return dealt.mapInArrow(run, ROW)


ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
SCHEMA = pa.schema([(x.split()[0], ARROW[x.split()[1]]) for x in ROW.split(", ")])


class Lane(MutableSet):
    """A session's map state as a set of keys: read whole at the first question, and only if it holds some;
    what has changed is written back at once."""

    def __init__(self, state, held: int):
        self.state, self.held = state, held

    def keys(self) -> set[str]:
        if not hasattr(self, "was"):
            self.was = {k[0] for k in self.state.keys()} if self.held else set()
            self.now = set(self.was)
        return self.now

    def __contains__(self, key):
        return key in self.keys()

    def add(self, key):
        self.keys().add(key)

    def discard(self, key):
        self.keys().discard(key)

    def clear(self):
        self.keys().clear()

    def __iter__(self):
        return iter(self.keys())

    def __len__(self):
        return len(self.keys())

    def write(self) -> None:
        if hasattr(self, "was"):
            for key in self.was - self.now:
                self.state.removeKey((key,))
            for key in self.now - self.was:
                self.state.updateValue((key,), (True,))


def due(s: Session, limits: Limits) -> set[int]:
    """The timers of a session: the end of its idle time, and that of an open breaker."""
    return set() if s.last_at == NEVER else {s.last_at + limits.idle_ms} | ({s.open_until} if s.tripped_by >= 0 else set())


def stream_log(events: DataFrame, delay: str = "1 second", limits: Limits = Limits()) -> DataFrame:
    """The same rows from a stream, as events come and timers fire.

    Scalars are one value state, the lane is a map state by key. A timer at the end of an open breaker, and one
    at the end of a session's idle time, fire when the watermark (the latest event less `delay`) has passed;
    until then the next event sees to it, by the same function. Events behind the watermark are dropped; times
    may be 0 or less, down to -AHEAD.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    made = Row(*COLUMNS)

    class Sessions(StatefulProcessor):
        """Every call to the state is a round trip to the JVM, so a session is read once and its changes are written
        once in a micro-batch. Its timers are told by its state, and are never listed."""

        def init(self, handle):
            self.handle = handle
            self.kept, self.lanes = handle.getValueState("session", STATE), handle.getMapState("lane", "key string", "held boolean")

        def held(self) -> tuple[Session, Lane]:
            values = self.kept.get()
            s = Session() if values is None else Session(*values)
            return s, Lane(self.lanes, s.lane)

        def keep(self, before: Session, s: Session, lane: Lane, fired: int | None = None) -> None:
            for t in due(before, limits) - due(s, limits) - {fired}:  # the one that fired is deleted after it
                self.handle.deleteTimer(t + AHEAD)
            for t in due(s, limits) - due(before, limits):
                self.handle.registerTimer(t + AHEAD)
            lane.write()
            if s.last_at != NEVER:
                self.kept.update(astuple(s))
            elif before.last_at != NEVER:
                self.kept.clear()

        def handleInputRows(self, key, rows, timerValues):
            before, lane = self.held()
            s, out = before, []
            for r in sorted(rows, key=lambda r: (r.at, r.seq)):
                s, more = step(key[0], s, lane, Event(r.seq, r.at, r.kind, r.number, r.size, r.place, r.key, r.done), limits)
                out += more
            self.keep(before, s, lane)
            return iter([made(*x) for x in out])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            at = expiredTimerInfo.getExpiryTimeInMs() - AHEAD
            before, lane = self.held()
            s, out = closes(key[0], before, at)
            if expired(s, at, limits):
                out.append(row(key[0], Session(), s.last_seq, s.last_at, "expired"))
                s = Session()
                lane.clear()
            self.keep(before, s, lane, at)
            return iter([made(*x) for x in out])

        def close(self):
            pass

    rows = known(events).withColumn("ts", F.timestamp_millis(F.col("at") + AHEAD)).withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithState(statefulProcessor=Sessions(), outputStructType=ROW, outputMode="Append", timeMode="EventTime")
