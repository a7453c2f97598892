"""SimHash near-duplicates: fingerprints, bit-sliced comparison and connected components."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, checkpointed, fresh, release, with_text_columns, without, written
from .components import components

#: The fingerprints of one bucket that a task holds together; larger buckets are dealt in blocks.
BLOCK = 50_000
#: Rows of small buckets that are compared side by side.
BATCH = 200_000
#: Rows times distances between places that are compared at once.
SHIFTED = 1 << 20
ALL = np.uint64(2**64 - 1)


def shingle_hashes(data: bytes, shingle: int, distinct: bool) -> list[int]:
    words = data.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, 42)]
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return list(set(hashes)) if distinct else hashes


def shingle_set(data: bytes, shingle: int) -> set[bytes]:
    """The shingles that shingle_hashes hashes."""
    words = data.lower().split()
    if len(words) <= shingle:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}


def more_bits(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of each hash, by a public integer mixer."""
    if not k:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint_texts(texts: list[bytes], shingle: int, words: int, distinct: bool, total: bool = False) -> np.ndarray:
    """(texts, words) uint64: a bit is set if it is set in over half of the shingles' hashes.

    total: one more word, the sum of the hashes, which with the fingerprint tells sets apart."""
    out = np.zeros((len(texts), words + total), np.uint64)
    found = [shingle_hashes(t, shingle, distinct) for t in texts]
    size = np.fromiter(map(len, found), np.int64, len(found))
    full = np.flatnonzero(size)
    if not len(full):
        return out
    first = np.cumsum(size[full]) - size[full]
    flat = np.fromiter((h for hs in found for h in hs), np.uint64, int(size.sum()))
    for k in range(words):
        bits = np.unpackbits(more_bits(flat, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        major = 2 * votes > size[full][:, None]
        out[full, k] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    if total:
        out[full, words] = np.add.reduceat(flat, first)
    return out


def with_fingerprints(df: DataFrame, shingle: int = 3, words: int = 1, distinct: bool = False, text_col: str = "text", total: bool = False) -> DataFrame:
    """Add fp0, fp1, ... (64 bits each, as signed longs), all 0 for a text without words.

    total: also fp<words>, the sum of the shingles' hashes."""
    fields = [T.StructField(f"fp{k}", T.LongType()) for k in range(words + total)]

    def build():
        def work(texts: pa.Array) -> dict:
            fp = fingerprint_texts(texts.cast(pa.binary()).to_pylist(), shingle, words, distinct, total).view(np.int64)
            return {f"fp{k}": pa.array(fp[:, k]) for k in range(words + total)}

        return work

    return with_text_columns(df, fields, build, text_col)


class Planes:
    """The fingerprints of many rows stored vertically: bit b of all rows in one packed array."""

    def __init__(self, fps: np.ndarray):
        n, words = fps.shape
        self.words = (n + 63) // 64
        pad = np.zeros((64 * self.words + 128, words), np.uint64)
        pad[:n] = fps
        bits = np.unpackbits(pad.view(np.uint8), axis=1, bitorder="little")
        self.bits = np.packbits(bits, axis=0, bitorder="little").T.copy().view(np.uint64)

    def near(self, shifts: np.ndarray, end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, shift) of all rows i whose row i + shift lies before end[i] and at most `radius` bits away.

        64 distances to a word are counted in carry-save form: bit j of all counters lies in low[j].
        They start so high that the one beyond the radius carries out. Words in which all rows are
        beyond it, or not compared, are abandoned.
        """
        mask = np.zeros((len(shifts), 64 * self.words), bool)
        mask[:, : len(end)] = shifts[:, None] < (end - np.arange(len(end)))[None, :]
        over = ~np.packbits(mask, axis=1, bitorder="little").view(np.uint64)
        which, at = np.nonzero(over != ALL)
        over, shift = over[which, at], shifts[which]
        n_low = max(1, radius.bit_length())
        start = 2**n_low - 1 - radius
        low = [np.full(len(at), ALL if start >> j & 1 else np.uint64(0)) for j in range(n_low)]
        far, right = at + shift // 64, (shift % 64).astype(np.uint64)
        left = np.uint64(63) - right
        for b in range(0, len(self.bits), 2):
            if not len(at):
                break
            # in x and y: which rows differ from the row `shift` places on
            p, q = self.bits[b], self.bits[b + 1]
            x = p[at] ^ ((p[far] >> right) | ((p[far + 1] << left) << np.uint64(1)))
            y = q[at] ^ ((q[far] >> right) | ((q[far + 1] << left) << np.uint64(1)))
            u = x ^ y
            carry = (x & y) | (low[0] & u)
            low[0] ^= u
            for j in range(1, n_low):
                carry, low[j] = low[j] & carry, low[j] ^ carry
            over |= carry
            if b % 8 == 6:
                live = over != ALL
                if 2 * np.count_nonzero(live) < len(at):
                    at, far, right, left, shift, over = (z[live] for z in (at, far, right, left, shift, over))
                    low = [x[live] for x in low]
        hit = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64)
        word, bit = np.nonzero(hit)
        return at[word] * 64 + bit, shift[word]

    def all_near(self, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """near() for all shifts, some at a time, with (i, j) for the rows."""
        most = int((end - np.arange(len(end))).max(initial=0))
        step = max(1, SHIFTED // max(len(end), 1))
        for s in range(1, most, step):
            i, shift = self.near(np.arange(s, min(most, s + step)), end, radius)
            if len(i):
                yield i, i + shift


def linked(fps: np.ndarray, end: np.ndarray, radius: int) -> np.ndarray:
    """The root row of each row: rows within the radius of each other, and in the same bucket (end:
    where the bucket of each row ends), have one root, as have chains of such rows."""
    root = np.arange(len(fps))
    for i, j in Planes(fps).all_near(end, radius):
        a, b = root[i], root[j]
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        if len(pairs):
            up: dict[int, int] = {}

            def top(x):
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            for x, y in pairs.tolist():
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            to = np.arange(len(fps))
            for x in up:
                to[x] = top(x)
            root = to[root]
    return root


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Of pairs (i, j, distance), as columns, of n rows the closest that join all that the pairs join."""
    pairs = pairs[:, np.argsort(pairs[2], kind="stable")]
    root, chosen = np.arange(n), []
    edges = np.flatnonzero(np.diff(pairs[2], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        i, j = root[pairs[0, a:b]], root[pairs[1, a:b]]
        live = np.flatnonzero(i != j)
        up: dict[int, int] = {}

        def top(x):
            while (y := up.get(x, x)) != x:
                x = y
            return x

        for k, x, y in zip((live + a).tolist(), i[live].tolist(), j[live].tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                chosen.append(k)
        if up:
            to = np.arange(n)
            for x in up:
                to[x] = top(x)
            root = to[root]
    return pairs[:, chosen]


def closest(fps: np.ndarray, end: np.ndarray, radius: int) -> np.ndarray:
    """Pairs (i, j, distance) of rows in one bucket and within the radius, which join all that such pairs
    join, the closest ones: a least spanning forest, not all pairs."""
    n = len(fps)
    held, size = [np.zeros((3, 0), np.int64)], 0
    for i, j in Planes(fps).all_near(end, radius):
        held.append(np.stack([i, j, distance(fps[i], fps[j])]))
        size += len(i)
        if size > 5 * BATCH:
            held = [forest(np.concatenate(held, axis=1), n)]
            size = held[0].shape[1]
    return forest(np.concatenate(held, axis=1), n)


def bucket_edges(rows: DataFrame, words: int, radius: int, exact: bool = False) -> DataFrame:
    """Links (u, v) that span the components inside every bucket of rows (key, fp0, ...).

    A task reads its buckets in order of their keys and holds some complete ones at a time. Of all
    links in a bucket only a tree is given out, so copies of copies do not make all pairs.
    exact: rows have one more word to tell them apart, and links are pairs that lie within the radius
    themselves, the closest that span a component.
    """
    wide = len(rows.columns) - 1

    def name(fp: np.ndarray) -> list[str]:
        return ["".join(f"{x:016x}" for x in row) for row in fp.tolist()]

    def edges(key: np.ndarray, fps: np.ndarray):
        change = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(change, len(key)))
        large = size > 512
        for part in [np.repeat(~large & (size > 1), size), *(slice(a, a + n) for a, n in zip(change[large], size[large], strict=True))]:
            k, f = key[part], fps[part]
            if not len(k):
                continue
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            n = np.diff(np.append(first, len(k)))
            if exact:
                i, j, _ = closest(np.ascontiguousarray(f[:, :words]), np.repeat(first + n, n), radius)
                if len(i):
                    u, v = name(f[i]), name(f[j])
                    yield pa.RecordBatch.from_arrays([pa.array(map(min, u, v)), pa.array(map(max, u, v))], names=["u", "v"])
                continue
            root = linked(f, np.repeat(first + n, n), radius)
            i = np.flatnonzero(root != np.arange(len(root)))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(name(f[i])), pa.array(name(f[root[i]]))], names=["u", "v"])

    def run(batches):
        held = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), np.stack([batch.column(1 + k).to_numpy().view(np.uint64) for k in range(wide)], 1)))
            n += batch.num_rows
            if n >= BATCH:
                key, fps = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from edges(key[:cut], fps[:cut])
                held, n = [(key[cut:], fps[cut:])], len(key) - cut
        if n:
            yield from edges(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    # dealt by a hash of the key, as a repartition by the key itself may be left out of the plan after a join by it
    return rows.repartition(F.xxhash64("key")).sortWithinPartitions("key", "fp0").mapInArrow(run, "u string, v string")


def exact_masks(bits: int, radius: int) -> list[list[int]]:
    """Bit sets such that fingerprints within the radius agree on all bits of at least one.

    The bits are cut into radius + 2 blocks; at most `radius` of them differ, so two are equal.
    """
    edge = [round(i * bits / (radius + 2)) for i in range(radius + 3)]
    return [[*range(edge[i], edge[i + 1]), *range(edge[j], edge[j + 1])] for i, j in combinations(range(radius + 2), 2)]


def likely_masks(bits: int, similarity: float, size: int = 14, recall: float = 0.998) -> list[list[int]]:
    """Random sets of `size` bits, of which one agrees with probability `recall` at the given similarity.

    They do not depend on the table: a pair is proposed or not whatever else there is.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** size))
    rng = random.Random(5)
    return [rng.sample(range(bits), size) for _ in range(count)]


def bucket_key(t: int, bits: list[int], words: int) -> Column:
    masks = [sum(1 << (b % 64) for b in bits if b // 64 == k) for k in range(words)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    return F.xxhash64(F.lit(t), *[F.col(f"fp{k}").bitwiseAND(F.lit(m).cast("long")) for k, m in enumerate(signed) if m])


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    words: int = 1,
    radius: int = 3,
    similarity: float | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Add fingerprint (hex) and component_id to every row.

    Fingerprints of 64 * words bits over `shingle`-word shingles (ASCII lower case; distinct: each
    counted once) are linked at `radius` or fewer differing bits. component_id is the smallest id
    that can be reached over links. Without `similarity` the buckets are exact: they miss no link.
    With it, buckets are random bit sets that hold a pair of that Jaccard similarity with
    probability 0.998, for radii too wide for exact buckets.

    Equal fingerprints are one node, so copies cost nothing further. A bucket larger than BLOCK is
    dealt in blocks, every two of which meet in some task; nothing is capped.
    Texts without words (null, empty) have fingerprint 0 and are linked like others; shorter texts
    are one shingle; rows with a null id take part, and get the smallest other id, or null if none
    is there; repeated rows get equal results; texts of any length are read whole; an empty table gives an empty
    table; columns named fingerprint or component_id are replaced.
    """
    fps = [f"fp{k}" for k in range(words)]
    df, back, (id_col, text_col) = aside(without(df, {"fingerprint", "component_id"}), set(fps), id_col, text_col)
    marked = with_fingerprints(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")), shingle, words, distinct).drop("text")
    marked = written(marked, "fingerprints")
    found = component_ids(marked, words, radius, similarity, hexed(words))
    if df.columns == [id_col] or set(df.columns) == {id_col, text_col}:
        rows = marked.select(F.col("i").alias(id_col), hexed(words).alias("fingerprint"))
        return rows.join(found, "fingerprint").select(id_col, "fingerprint", "component_id").withColumnsRenamed(back)
    rows = with_fingerprints(df, shingle, words, distinct, text_col)
    return rows.withColumn("fingerprint", hexed(words)).drop(*fps).join(found, "fingerprint").withColumnsRenamed(back)


def hexed(words: int) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"fp{k}"), 16, "0") for k in range(words)]))


def dealt(nodes: DataFrame, masks: list[list[int]], words: int, cols: list[str]) -> DataFrame:
    """(key, *cols): every node in each of its buckets, large buckets in blocks of which every two meet."""
    keys = F.explode(F.array(*[bucket_key(t, m, words) for t, m in enumerate(masks)]))
    rows = nodes.select(keys.alias("key"), *cols)
    hot = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK))
    if not hot.isEmpty():
        blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BLOCK).cast("int")
        rows = rows.join(hot, "key", "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(*cols), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        both = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(both).alias("key"), *cols)
    return rows


def component_ids(marked: DataFrame, words: int, radius: int, similarity: float | None, name: Column, best: str = "i") -> DataFrame:
    """(fingerprint, component_id) for the distinct fingerprints of marked (i, fp0, ...); component_id is
    the least `best` of the component."""
    fps = [f"fp{k}" for k in range(words)]
    nodes = written(marked.groupBy(*fps).agg(F.min(best).alias("least")), "nodes")
    masks = exact_masks(64 * words, radius) if similarity is None else likely_masks(64 * words, similarity)
    rows = dealt(nodes, masks, words, fps)
    roots = components(written(bucket_edges(rows, words, radius), "links"))
    named = nodes.select(name.alias("fingerprint"), "least").join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = checkpointed(named.withColumn("root", F.coalesce("root", "fingerprint")))
    # checkpointed, so that the join with a hot root can be split
    least = checkpointed(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return named.join(least, "root").select("fingerprint", "component_id")


def exactly(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v, near) for pairs (u, v) of nodes: whether the sets of shingles of their texts (node, text)
    have that Jaccard similarity or more."""
    least = Fraction(str(similarity))

    def run(batches):
        for batch in batches:
            near, held, own = [], None, set()
            for v, a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if v != held:  # rows come in order of v mostly
                    held, own = v, shingle_set(b.encode(), shingle)
                other = shingle_set(a.encode(), shingle)
                both = len(own & other)
                near.append(both * least.denominator >= least.numerator * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["u", "v", "near"])
        release()

    rows = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    rows = rows.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")
    return rows.mapInArrow(run, "u string, v string, near boolean")


#: Bytes of text in a block of the second round, of which a task holds two.
OPEN_BYTES = 8 << 20
#: Distances that are worked out at once there.
GRID = 1 << 21


def links_between(names: list[str], parts: list[str], main: np.ndarray, fps: np.ndarray, texts: list[str], radius: int, shingle: int, similarity: Fraction) -> list[tuple[str, str]]:
    """Links of that similarity which join the parts of some nodes, as far as links within the radius do.

    main: nodes of one part, which come last. Each pair of other parts is compared until the two are
    joined, close pairs first; hashes of the shingles rule a pair out, the shingles themselves decide.
    """
    n, n_small = len(names), int(np.count_nonzero(~main))
    up = {p: p for p in parts}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    number = {p: k for k, p in enumerate(up)}
    part = np.array([number[p] for p in parts])
    hashed: dict[int, np.ndarray] = {}

    def hashes(i):
        if i not in hashed:
            hashed[i] = np.unique(np.array(shingle_hashes(texts[i].encode(), shingle, True), np.uint64))
        return hashed[i]

    def alike(both, a, b):
        return both * similarity.denominator >= similarity.numerator * (a + b - both)

    found = []
    step = max(1, GRID // max(n, 1))
    for a in range(0, n_small, step):
        i = np.arange(a, min(n_small, a + step))
        far = distance(fps[i][:, None, :], fps[None, a:, :])
        near = (far <= radius) & (part[i][:, None] != part[None, a:]) & (np.arange(a, n)[None, :] > i[:, None])
        x, y = np.nonzero(near)
        order = np.argsort(far[x, y], kind="stable")
        for x, y in zip((x[order] + a).tolist(), (y[order] + a).tolist(), strict=True):
            if (p := top(parts[x])) == (q := top(parts[y])):
                continue
            h, g = hashes(x), hashes(y)
            if not alike(min(len(h), len(g)), len(h), len(g)) or not alike(len(np.intersect1d(h, g, assume_unique=True)), len(h), len(g)):
                continue
            own, other = shingle_set(texts[x].encode(), shingle), shingle_set(texts[y].encode(), shingle)
            if alike(len(own & other), len(own), len(other)):
                up[p] = q
                found.append((min(names[x], names[y]), max(names[x], names[y])))
    return found


def links_of_parts(nodes: DataFrame, words: int, radius: int, shingle: int, similarity: float) -> DataFrame:
    """(u, v): links between the parts of each component, for nodes (root, part, node, fp0, ..., text).

    All pairs of different parts are compared inside tasks, and only links that join two go out. The
    nodes of a component's largest part need not meet each other. All are dealt in blocks of some
    bytes of text, and every two blocks that have to meet do so in some task.
    """
    fps = [f"fp{k}" for k in range(words)]
    least = Fraction(str(similarity))
    sizes = nodes.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    largest = F.max(F.struct("n", "part", "bytes")).alias("largest")
    sizes = sizes.groupBy("root").agg(largest, F.sum("bytes").alias("bytes"))
    blocks = lambda b: F.greatest(F.lit(1), F.ceil(b / OPEN_BYTES)).cast("int")
    sizes = checkpointed(sizes.select("root", F.col("largest.part").alias("main_part"), blocks(F.col("bytes") - F.col("largest.bytes")).alias("n_small"), blocks(F.col("largest.bytes")).alias("n_main")))
    rows = nodes.join(sizes, "root").withColumn("main", F.col("part") == F.col("main_part"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("n_main")).otherwise(F.col("n_small"))).cast("int"))
    meets_small = "transform(sequence(0, n_small - 1), b -> xxhash64(root, {0}))"
    keys = F.when(F.col("main"), F.expr(meets_small.format("'main', b, own"))).otherwise(
        F.concat(F.expr(meets_small.format("'small', least(b, own), greatest(b, own)")), F.expr("transform(sequence(0, n_main - 1), b -> xxhash64(root, 'main', own, b))"))
    )
    rows = rows.select(F.explode(keys).alias("key"), "main", "part", "node", "text", *fps)

    def settle(held: list[tuple]):
        held.sort(key=lambda r: r[1])
        f = np.array([r[5:] for r in held], np.int64).view(np.uint64).reshape(len(held), words)
        found = links_between([r[3] for r in held], [r[2] for r in held], np.array([r[1] for r in held], bool), f, [r[4] for r in held], radius, shingle, least)
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["u", "v"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)
        held.clear()
        release()

    return rows.repartition(F.xxhash64("key")).sortWithinPartitions("key").mapInArrow(run, "u string, v string").distinct()


def exact_component_ids(marked: DataFrame, texts: DataFrame, words: int, radius: int, similarity: float, shingle: int) -> DataFrame:
    """(node, component_id) for the distinct sets of shingles of marked (i, th, fp0, ..., node, best), linked
    where their Jaccard similarity is `similarity` or more; texts: (i, th, text). component_id is the
    least `best` of the component.

    Fingerprints only propose pairs: every link is checked on the sets themselves. First, the closest
    pairs that span each bucket are checked. A pair beside them needs no check if all links of its tree
    hold; in a tree where one does not, nodes of different parts are compared inside tasks.
    """
    fps = [f"fp{k}" for k in range(words + 1)]
    nodes = written(marked.groupBy("node", *fps).agg(F.min("best").alias("least")), "nodes")
    masks = likely_masks(64 * words, similarity)
    pairs = written(bucket_edges(dealt(nodes, masks, words, fps), words, radius, exact=True).distinct(), "links")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    shown = marked.join(ends, "node", "left_semi").groupBy("node").agg(F.min(F.struct("th", "i")).alias("s")).select("node", "s.th", F.col("s.i").alias("_i"))
    found = texts.join(shown, (texts["th"] == shown["th"]) & texts["i"].eqNullSafe(shown["_i"])).select("node", "text")
    found = written(found.groupBy("node").agg(F.min("text").alias("text")), "texts")
    checked = written(exactly(pairs, found, shingle, similarity), "checked")
    links, not_near = checked.where("near").select("u", "v"), checked.where("not near").select("u", "v")
    if not not_near.isEmpty():
        parts = checkpointed(components(links).select("node", F.col("root").alias("part")))
        trees = checkpointed(components(pairs))
        open_ = checkpointed(trees.join(not_near.select(F.col("u").alias("node")).distinct(), "node").select("root").distinct())
        again = trees.join(open_, "root", "left_semi").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
        again = written(again.join(nodes.select("node", *fps[:words]), "node").join(found, "node").select("root", "part", "node", "text", *fps[:words]), "open")
        links = links.union(written(links_of_parts(again, words, radius, shingle, similarity), "checked"))
    named = nodes.select("node", "least").join(components(links), "node", "left")
    named = checkpointed(named.withColumn("root", F.coalesce("root", "node")))
    least = checkpointed(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return named.join(least, "root").select("node", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, radius: int = 3, similarity: float | None = None, distinct: bool = False) -> DataFrame:
    """One row of each component, that of the least id, with the columns of df.

    With `similarity` the components are those of exact_component_ids: fingerprints propose links, and
    those of at least that Jaccard similarity hold.
    Which rows those are is found on narrow rows of id and fingerprint; texts move once, in a join.

    Null text counts as empty; texts without words are one component. Where no row of a component has
    an id, and where an id has several texts, the least hash of the text decides; of rows that repeat
    an id and a text, one stays. An empty table stays empty.
    """
    exact = similarity is not None
    fps = [f"fp{k}" for k in range(words + exact)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("th"), text.alias("text"))
    marked = written(with_fingerprints(narrow, shingle, words, distinct or exact, total=exact).drop("text"), "fingerprints")
    marked = marked.withColumn("node", hexed(words + exact)).withColumn("best", F.struct(F.col("i").isNull().alias("none"), "i", "th"))
    if exact:
        found = exact_component_ids(marked, narrow, words, radius, similarity, shingle)
    else:
        found = component_ids(marked, words, radius, None, hexed(words), "best").withColumnRenamed("fingerprint", "node")
    stay = marked.drop(*fps).join(found, "node").where(F.col("best").eqNullSafe(F.col("component_id")))
    one, hashed, times = fresh(df, "i", "th", "n")
    stay = checkpointed(stay.groupBy(F.col("i").alias(one), F.col("th").alias(hashed)).agg(F.count(F.lit(1)).alias(times)))

    def rows_of(some: DataFrame, ids: DataFrame) -> DataFrame:
        return some.join(ids, F.col(id_col).eqNullSafe(F.col(one)) & (F.xxhash64(text) == F.col(hashed)), "left_semi")

    twice = stay.where(F.col(times) > 1)
    if twice.isEmpty():
        return rows_of(df, stay)
    again = rows_of(df, twice).withColumn(hashed, F.xxhash64(text)).dropDuplicates([id_col, hashed]).drop(hashed)
    return rows_of(df, stay.where(F.col(times) == 1)).union(again)
