"""Removal of repeated passages: anchors, then a logarithmic family of suffix arrays."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, flat_text_rows, release, written

#: Bytes that are hashed to choose anchors. A window of `length` bytes holds length - GRAM + 1 grams.
GRAM = 32
INDEX_BITS = np.uint64(31)
#: Runs whose windows make one suffix array, and runs after which a task starts a new family.
BATCH_RUNS, FAMILY_RUNS = 1_024, 4_096
#: Runs of one anchor that a task holds; those of an anchor with more are settled in blocks of windows.
HOT = 1_000
#: Windows in a block, level by level; the last settles all.
STEPS = (16, 4, 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place, by doubling the hashed length."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        head = h[:-step] ^ (h[:-step] >> np.uint64(29))
        head *= np.uint64(m)
        head += h[step:]
        h, step = head, 2 * step
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[p : p + w]) for every p, from running minima of blocks of w in both directions."""
    n = len(v) - w + 1
    pad = -len(v) % w
    blocks = np.concatenate([v, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchored_runs(data: bytes, cuts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The runs of windows with one anchor, over texts that end at cuts: (text, first window, last
    window, anchor hash); places are in data.

    The anchor of a window is its gram of the least hash, the rightmost of equals. It depends on the
    window's bytes alone: equal windows have equal anchors at equal offsets, so they lie in runs of
    equal anchor hash.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64)
    h = gram_hashes(np.frombuffer(data, np.uint8))
    place = np.arange(len(h), dtype=np.uint64)
    top = (np.uint64(1) << INDEX_BITS) - np.uint64(1)
    m = sliding_min(((h >> INDEX_BITS) << INDEX_BITS) | (top - place), length - GRAM + 1)
    at = (top - (m & top)).astype(np.int64)
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[: len(at)]
    valid = np.arange(len(at)) + length <= cuts[text + 1]
    first = valid.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
    lo = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    hi = np.flatnonzero(last)
    return text[lo], lo, hi, h[at[lo]]


class SuffixFamily:
    """A logarithmic family of sparse suffix arrays over windows of `length` bytes.

    A new batch of windows is sorted into a suffix array of its own. It is merge-scanned against
    every level held, so that windows found twice are marked on both sides, and becomes a level;
    while the level before is no larger, both are merged. n windows are held in at most log2(n)
    levels, and a window is merged as often at most.
    """

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.marks: list[np.ndarray] = []
        self.n = 0

    def add(self, data: bytes, starts: np.ndarray) -> None:
        """Windows numbered on from those added before; starts: where they start in data."""
        if not len(starts):
            return
        flat = np.frombuffer(data, np.uint8)
        rows = np.lib.stride_tricks.sliding_window_view(flat, self.length)[starts]
        suffixes = np.ascontiguousarray(rows).view(f"S{self.length}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes, ids = suffixes[order], order + self.n
        mark = np.zeros(len(starts), bool)
        self.marks.append(mark)
        same = suffixes[1:] == suffixes[:-1]
        mark[order[1:][same]] = mark[order[:-1][same]] = True
        self.n += len(starts)
        everything = None
        for held, held_ids in self.levels:
            left = np.searchsorted(held, suffixes)
            inside = left < len(held)
            hit = np.zeros(len(suffixes), bool)
            hit[inside] = held[left[inside]] == suffixes[inside]
            if hit.any():
                mark[order[hit]] = True
                found = np.unique(left[hit])
                right = np.searchsorted(held, held[found], side="right")
                twice = held_ids[np.concatenate([np.arange(a, b) for a, b in zip(found, right, strict=True)])]
                everything = twice if everything is None else np.concatenate([everything, twice])
        self._mark(everything)
        while self.levels and len(self.levels[-1][0]) <= len(suffixes):
            held, held_ids = self.levels.pop()
            suffixes, ids = np.concatenate([held, suffixes]), np.concatenate([held_ids, ids])
            order = np.argsort(suffixes, kind="stable")  # merges two sorted parts
            suffixes, ids = suffixes[order], ids[order]
        self.levels.append((suffixes, ids))

    def _mark(self, ids: np.ndarray | None) -> None:
        if ids is None:
            return
        edges = np.cumsum([0, *map(len, self.marks)])
        part = np.searchsorted(edges, ids, side="right") - 1
        for k in np.unique(part):
            self.marks[k][ids[part == k] - edges[k]] = True

    def repeated(self) -> np.ndarray:
        """Of each window added, whether another one has the same bytes."""
        return np.concatenate(self.marks) if self.marks else np.zeros(0, bool)


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the maximal runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def covered(windows: list[tuple[int, int]], length: int, size: int) -> list[tuple[int, int]]:
    """The maximal spans of bytes that windows starting from first to last cover."""
    spans: list[list[int]] = []
    for a, b in sorted(windows):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + length)
        else:
            spans.append([a, b + length])
    return [(a, min(b, size)) for a, b in spans]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


RUNS = "i string, th long, ah long, rh long, lo int, hi int"
WINDOWS = "i string, th long, a int, b int"


def text_runs(rows: DataFrame, length: int) -> DataFrame:
    """The anchored runs of rows (i, th, text), with a hash of the bytes that a run's windows cover."""

    def build():
        def work(texts: pa.Array, batch: pa.RecordBatch) -> dict:
            raw = texts.to_pylist()
            data = b"".join(raw)
            cuts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
            text, lo, hi, ah = anchored_runs(data, cuts, length)
            digest = xxhash.xxh3_64_intdigest
            rh = np.fromiter((digest(data[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)), np.uint64, len(lo))
            own = pa.array(text)
            return {"i": batch.column("i").take(own), "th": batch.column("th").take(own), "ah": pa.array(ah.view(np.int64)), "rh": pa.array(rh.view(np.int64)), "lo": pa.array((lo - cuts[text]).astype(np.int32)), "hi": pa.array((hi - cuts[text]).astype(np.int32))}

        return work

    return flat_text_rows(rows, T._parse_datatype_string(RUNS), build)


def family_windows(pieces: DataFrame, length: int) -> DataFrame:
    """Of open runs, the windows (from a to b) that occur in another run of the same anchor."""

    def search(runs: list[tuple]):
        family = SuffixFamily(length)
        for k in range(0, len(runs), BATCH_RUNS):
            part = runs[k : k + BATCH_RUNS]
            size = np.array([len(r[5]) for r in part])
            first = np.cumsum(size) - size
            count = size - length + 1
            starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            family.add(b"".join([r[5] for r in part]), starts)
        flags, at = family.repeated(), 0
        out = []
        for _, i, th, lo, unsure, piece in runs:
            n = len(piece) - length + 1
            if unsure:
                out += [(i, th, lo + a, lo + b) for a, b in zip(*map(np.ndarray.tolist, ranges(flags[at : at + n])), strict=True)]
            at += n
        cols = zip(*out, strict=True) if out else ((),) * 4
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["i", "th", "a", "b"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if len(held) >= FAMILY_RUNS and row[0] != held[-1][0]:
                    yield search(held)
                    held = []
                held.append(row)
        if held:
            yield search(held)
        held.clear()
        release()

    # dealt by a hash of the anchor: a repartition by the anchor itself is left out of the plan where the rows
    # come from a join by it, and a join may then be split or read locally, which takes equal anchors apart
    return pieces.repartition(F.xxhash64("ah")).sortWithinPartitions("ah").mapInArrow(run, WINDOWS)


def anchor_of(piece: bytes, length: int) -> int:
    """Where in a run's bytes its anchor is."""
    h = gram_hashes(np.frombuffer(piece, np.uint8))[: length - GRAM + 1] >> INDEX_BITS
    return len(h) - 1 - int(np.argmin(h[::-1]))


BLOCK = "c1 long, c2 long, e1 long, e2 long, i string, th long, lo int, at int, open boolean, piece binary"


def window_blocks(rows: DataFrame, length: int, step: int) -> DataFrame:
    """Rows (i, th, lo, at, open, piece) cut into blocks of `step` windows by their offset from the
    anchor, with 128-bit hashes of the block's core and of all its bytes. The core is what every
    window of the block holds: windows that are equal lie in blocks with equal cores."""

    schema = to_arrow_schema(T._parse_datatype_string(BLOCK))

    def run(batches):
        for batch in batches:
            out = []
            for i, th, lo, at, unsure, piece in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                at = anchor_of(piece, length) if at is None else at
                n = len(piece) - length + 1
                for block in range((at - n + 1) // step, at // step + 1):
                    first, last = max(0, at - block * step - step + 1), min(n - 1, at - block * step)
                    core = piece[at - block * step : at - block * step - step + 1 + length]
                    part = piece[first : last + length]
                    hashes = np.frombuffer(xxhash.xxh3_128_digest(core) + xxhash.xxh3_128_digest(part), np.int64).tolist()
                    out.append((*hashes, i, th, lo + first, at - first, unsure, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.select("i", "th", "lo", "at", "open", "piece").mapInArrow(run, BLOCK)


def settled_blocks(pieces: DataFrame, length: int) -> DataFrame:
    """What family_windows gives, for anchors with too many runs for one task.

    Blocks whose core occurs once hold no repeat. Blocks with an equal repeat as a whole. What is
    left, blocks with a common core that differ around it, is cut into smaller blocks; blocks of one
    window are their own core. All counts are combined before the shuffle, and all joins are of
    tables, so that no core or anchor is one task's.
    """
    rows, found = pieces.withColumn("at", F.lit(None).cast("int")), []
    windows = ("i", "th", F.col("lo").alias("a"), (F.col("lo") + F.octet_length("piece") - length).cast("int").alias("b"))
    for step in STEPS:
        blocks = written(window_blocks(rows, length, step), "blocks")
        cores = blocks.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), *[f(e).alias(f"{name}_{e}") for e in ("e1", "e2") for name, f in (("low", F.min), ("high", F.max))])
        cores = cores.where("n > 1").select("c1", "c2", F.expr("low_e1 <> high_e1 or low_e2 <> high_e2").alias("mixed"))
        again = written(blocks.join(written(cores, "cores"), ["c1", "c2"]), "again")
        found.append(again.where("not mixed and open").select(*windows))
        mixed = again.where("mixed").withColumn("place", F.xxhash64("i", "th", "lo"))
        kinds = mixed.groupBy("c1", "c2", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
        both = mixed.join(written(kinds, "kinds"), ["c1", "c2", "e1", "e2"])
        found.append(both.where("open and n > 1").select(*windows))
        rows = both.where("n = 1 or place = first").withColumn("open", F.expr("open and n = 1"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def outcome(data: bytes, windows: list[tuple[int, int]], length: int, with_kept: bool) -> tuple:
    spans = covered(windows, length, len(data))
    kept = kept_bytes(data, spans)
    return len(data), len(data) - len(kept), len(spans), sha256(kept).hexdigest(), kept if with_kept else None


def pairs(runs: list[dict] | None) -> list[tuple[int, int]]:
    return [(r["a"], r["b"]) for r in runs or ()]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, with_kept: bool = False) -> DataFrame:
    """Remove each byte that lies in a `length`-byte string which also starts anywhere else.

    Returns a row for each row of df: its id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, and, with_kept, the remaining bytes as kept.

    Windows of `length` bytes are grouped into runs by a content-chosen anchor; equal windows lie in
    runs of one anchor hash. Anchors that occur once are dropped. If all runs of an anchor are
    equal, or a run has an equal, all its windows repeat. What is left, runs that share an anchor
    but differ, with one run of each kind of equal ones, goes to a SuffixFamily by anchor, which
    compares bytes; an anchor with more than HOT of them is settled in blocks instead. Counting is combined before shuffles; joins on hot anchors can be split.

    Texts are UTF-8 bytes, null is empty; matches never cross rows; rows shorter than `length` stay
    whole; repeated rows remove each other, also where their ids are null; an empty table gives an
    empty table; other columns of df are not returned.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    kind = df.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("string").alias("i"), F.xxhash64(text).alias("th"), text.alias("text"))
    runs = written(text_runs(rows, length), "runs")
    often = runs.groupBy("ah").agg(F.count(F.lit(1)).alias("n"), F.min("rh").alias("low"), F.max("rh").alias("high"))
    often = often.where("n > 1").select("ah", (F.col("low") != F.col("high")).alias("mixed"))
    # both counts are written before they are joined: in one stage with the aggregate, Spark could not
    # split the rows of a hot anchor
    again = written(runs.join(written(often, "anchors"), "ah"), "runs")
    place = F.xxhash64("i", "th", "lo")
    mixed = again.where("mixed").withColumn("place", place)
    kinds = mixed.groupBy("ah", "rh").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    # a run without an equal is open; of equal ones the first stands for all
    unsure = mixed.join(written(kinds, "kinds"), ["ah", "rh"]).select("i", "th", F.struct("lo", "hi", F.when(F.col("place") == F.col("first"), F.col("ah")).alias("ah"), (F.col("n") == 1).alias("open")).alias("run"))
    sure = again.where("not mixed").select("i", "th", F.struct("lo", "hi", F.lit(None).cast("long").alias("ah"), F.lit(False).alias("open")).alias("run"))
    # sets, combined before the shuffle: rows that repeat an id and a text have equal runs, and gather no more than one
    lists = unsure.union(sure).groupBy("i", "th").agg(F.collect_set("run").alias("runs"))
    lists = lists.select(F.col("i").alias("_i"), F.col("th").alias("_th"), "runs")
    joined = rows.join(lists, F.col("i").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_th")), "left").select("i", "th", "text", "runs")
    first = written(judged(joined, length, with_kept), "judged")
    pieces = first.where(F.size("pieces") > 0).select("i", "th", F.explode("pieces").alias("p")).select("p.ah", "i", "th", "p.lo", "p.open", "p.piece")
    hot = checkpointed(pieces.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("ah"))
    if hot.isEmpty():
        found = family_windows(pieces, length)
    else:
        found = family_windows(pieces.join(hot, "ah", "left_anti"), length).union(settled_blocks(pieces.join(hot, "ah", "left_semi").select(*pieces.columns), length))
    found = found.groupBy(F.col("i").alias("_i"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("a", "b")).alias("more"))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
    back = F.col("i").cast(kind).alias(id_col)
    done = first.where("text is null").select(back, *names)
    waiting = first.where("text is not null").select("i", "th", "text", "runs")
    waiting = waiting.join(found, F.col("i").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_th")), "left").select("i", "text", "runs", "more")
    return done.union(finished(waiting, length, with_kept).select(back, *names))


def judged(joined: DataFrame, length: int, with_kept: bool) -> DataFrame:
    """Rows without open runs are finished; others keep their text and the windows known to repeat.
    pieces: the bytes of the runs that have to be compared."""
    schema = T._parse_datatype_string(f"i string, th long, text binary, runs array<struct<a int, b int>>, pieces array<struct<ah long, lo int, open boolean, piece binary>>, {RESULT}")

    def build():
        def work(texts: pa.Array, batch: pa.RecordBatch) -> dict:
            new = {name: [] for name in schema.names}
            for data, runs in zip(texts.to_pylist(), batch.column("runs").to_pylist(), strict=True):
                runs = runs or []
                known = [(r["lo"], r["hi"]) for r in runs if not r["open"]]
                waits = len(known) < len(runs)
                new["text"].append(data if waits else None)
                new["runs"].append([{"a": a, "b": b} for a, b in known] if waits else None)
                new["pieces"].append([{"ah": r["ah"], "lo": r["lo"], "open": r["open"], "piece": data[r["lo"] : r["hi"] + length]} for r in runs if r["ah"] is not None])
                for name, x in zip(schema.names[5:], (None,) * 5 if waits else outcome(data, known, length, with_kept), strict=True):
                    new[name].append(x)
            return new | {"i": batch.column("i"), "th": batch.column("th")}

        return work

    return flat_text_rows(joined, schema, build)


def finished(waiting: DataFrame, length: int, with_kept: bool) -> DataFrame:
    schema = T._parse_datatype_string(f"i string, {RESULT}")

    def build():
        def work(texts: pa.Array, batch: pa.RecordBatch) -> dict:
            both = zip(texts.to_pylist(), batch.column("runs").to_pylist(), batch.column("more").to_pylist(), strict=True)
            made = [outcome(data, pairs(runs) + pairs(more), length, with_kept) for data, runs, more in both]
            cols = zip(*made, strict=True) if made else ((),) * 5
            return {"i": batch.column("i")} | dict(zip(schema.names[1:], map(list, cols), strict=True))

        return work

    return flat_text_rows(waiting, schema, build)
