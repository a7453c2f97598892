"""Token counts without ids: the pieces of each distinct pre-token are counted once for the whole table,
joined to each document's pre-token frequencies, and summed.

Texts are split once. Documents are taken in groups of some MB, in the order they are read; a group has
a dictionary of its pre-tokens, and a document is the numbers of its pre-tokens there and how often each occurs. So what
is shuffled is a word for each group it occurs in, not for each document, and no word has more rows than there
are groups, however frequent it is.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import load
from .common import arrow_type, chunks, fresh, release, without, written

#: Bytes of text whose documents share a dictionary (a longer text has one of its own). Plans only.
GROUP_BYTES = 32 << 20


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 in seven bits a byte, the lowest first, and where each begins (with the end last)."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28, 35))
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(start[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[start[:-1][has] + k] = (v[has] >> np.uint64(7 * k) & np.uint64(127)) | np.where(size[has] > k + 1, 128, 0).astype(np.uint64)
    return out, start


def unpacked(raw: np.ndarray) -> np.ndarray:
    """The numbers that packed() wrote."""
    end = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], end[:-1] + 1))[: len(end)]
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first) if len(end) else np.zeros(0, np.int64)


def binaries(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary for each stretch of raw between two places of at."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and how many each row has."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8), pc.binary_length(column).to_numpy().astype(np.int64)


def frequencies(df: DataFrame, path: str, names: dict[str, str], text_col: str, keep_text: bool) -> DataFrame:
    """For each document: its columns, its group, special tokens, the sorted numbers of its pre-tokens as
    differences, and how often each occurs. The first row of a chunk brings the words that are new to the group,
    and the number of the first of them."""
    at = [f.name.lower() for f in df.schema.fields].index(text_col.lower())
    place = [i for i in range(len(df.schema.fields)) if keep_text or i != at]
    new = [("group", T.LongType()), ("bytes", T.LongType()), ("special", T.LongType()), ("used", T.BinaryType()), ("times", T.BinaryType()), ("base", T.IntegerType()), ("words", T.ArrayType(T.StringType()))]
    fields = [T.StructField(names[n], t) for n, t in new]
    schema = T.StructType([df.schema.fields[i] for i in place] + fields)

    def run(batches):
        bpe, part = load(path), TaskContext.get().partitionId()
        number, held, index = 0, 0, None
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(sizes):
                more = int(sizes[lo:hi].sum())
                if index is None or held and held + more > GROUP_BYTES:
                    number, held, index = number + 1, 0, defaultdict()
                    index.default_factory = index.__len__
                held, base = held + more, len(index)
                ids, times, length, special = [], [], [], []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    found = Counter()
                    parts = bpe.pieces(text)
                    for words, _ in parts:
                        found.update(words)
                    ids.extend(map(index.__getitem__, found))
                    times.extend(found.values())
                    length.append(len(found))
                    special.append(sum(s is not None for _, s in parts))
                ids, doc = np.array(ids, np.int64), np.repeat(np.arange(hi - lo), length)
                order = np.lexsort((ids, doc))
                ids, cut = ids[order], np.concatenate(([0], np.cumsum(length)))
                step = np.diff(ids, prepend=0)
                head = cut[:-1][np.array(length) > 0]
                step[head] = ids[head]
                used, used_at = packed(step)
                often, often_at = packed(np.array(times, np.int64)[order])
                blank = [None] * (hi - lo - 1)
                made = {
                    "group": np.full(hi - lo, part << 32 | number),
                    "bytes": sizes[lo:hi].astype(np.int64),
                    "special": special,
                    "used": binaries(used, used_at[cut]),
                    "times": binaries(often, often_at[cut]),
                    "base": [base, *blank],
                    "words": [list(islice(index, base, None)), *blank],
                }
                cols = [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], arrow_type(f)) for (n, _), f in zip(new, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in place] + cols, names=schema.names)
        index = None
        release()

    return df.mapInArrow(run, schema)


def piece_counts(entries: DataFrame, path: str) -> DataFrame:
    """(group, counted) for rows (word, group, at) whose equal words are adjacent: each word is merged once.
    counted is the number of the word in its group, shifted by 32 bits, and its pieces."""

    def run(batches):
        bpe, last, last_n = load(path), None, 0
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            words = coded.dictionary.to_pylist()
            n = np.zeros(len(words), np.int64)
            known = int(bool(words) and words[0] == last)
            n[:known] = last_n
            for lo, hi in chunks(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[known:]):
                n[known + lo : known + hi] = np.diff(bpe.merge(words[known + lo : known + hi])[1])
            if words:
                last, last_n = words[-1], n[-1]
            counted = batch.column(2).to_numpy().astype(np.int64) << 32 | n[coded.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(counted, pa.int64())], names=["group", "counted"])
        release()

    return entries.mapInArrow(run, "group long, counted long")


def token_counts(df: DataFrame, path: str, limit: int = 1024, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row; without keep_text the
    text itself is left out, and not moved.

    The frequencies are written to the shared folder once; the words of all groups are dealt and sorted by
    word, counted, and go back to their groups. Null and empty texts have 0 tokens; special tokens inside a
    text count as one; a text of any length is split whole; repeated rows are counted alike; an empty table
    stays empty; columns of the same names are replaced.
    """
    df = without(df, {"n_bytes", "n_tokens", "over_limit"})
    helpers = ("group", "bytes", "special", "used", "times", "base", "words")
    names = dict(zip(helpers, fresh(df, *helpers), strict=True))
    docs = written(frequencies(df, path, names, text_col, keep_text), "frequencies")
    group, base, words = (F.col(names[n]) for n in ("group", "base", "words"))
    entries = docs.where(base.isNotNull()).select(group.alias("group"), base.alias("base"), F.posexplode(words).alias("at", "word"))
    entries = entries.select("word", "group", (F.col("base") + F.col("at")).alias("at")).repartition("word").sortWithinPartitions("word")
    counts = piece_counts(entries, path)

    kept = [f for f in docs.schema.fields if f.name not in set(names.values())]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    kept_names, held = [f.name for f in kept], {n: names[n] for n in helpers}

    def add_up(rows: pa.Table, counted: pa.Table) -> pa.Table:
        pieces = np.zeros(len(counted), np.int64)
        word = counted.column("counted").to_numpy()
        pieces[word >> 32] = word & 0xFFFFFFFF
        raw, _ = bytes_of(rows.column(held["used"]))
        step = unpacked(raw)
        raw, size = bytes_of(rows.column(held["times"]))
        times = unpacked(raw)
        cut = np.concatenate(([0], np.cumsum(raw < 128)))[np.concatenate(([0], np.cumsum(size)))]
        total = np.concatenate(([0], np.cumsum(step)))
        ids = total[1:] - np.repeat(total[cut[:-1]], np.diff(cut))
        tokens = np.concatenate(([0], np.cumsum(pieces[ids] * times)))[cut]
        n = np.diff(tokens) + rows.column(held["special"]).to_numpy()
        return pa.table([*(rows.column(c) for c in kept_names), rows.column(held["bytes"]), pa.array(n, pa.int64()), pa.array(n > limit)], names=schema.names)

    left = docs.drop(names["base"], names["words"]).groupBy(names["group"])
    return left.cogroup(counts.groupBy("group")).applyInArrow(add_up, schema)
