"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

A round works on many words at once: their symbols lie in one flat array, each adjacent pair is
looked up by binary search among the sorted keys of all mergeable pairs, every word's pair of the
lowest rank is merged at all its places, and words without a mergeable pair leave the array.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import REMEMBERING, with_text_columns

#: How byte-level vocabularies split a text before merging (fixed value, published with them).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point all Unicode versions agree on letters, numbers and white space.
STABLE = "԰"
NONE = np.int32(2**31 - 1)
#: Words that a worker remembers in each of two generations.
REMEMBERED = 150_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary with its merges, from a tokenizers .json or a .tiktoken rank file."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            self._from_json(path)
        else:
            self._from_ranks(path)
        order = np.argsort(self.keys)
        self.keys, self.ranks = self.keys[order], self.ranks[order]
        self.shared = np.array(range(self.width), dtype=object)  # one number object for each id
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def _from_json(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.width = max(vocab.values(), default=0) + 1 + len(spec["added_tokens"])
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.ranks = np.arange(len(pairs), dtype=np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.token_bytes |= {i: t.encode() for t, i in self.specials.items()}

    def _from_ranks(self, path: str) -> None:
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.width = max(ids.values()) + 1
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        made = [(ids[t[:k]] * self.width + ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        self.keys = np.array([k for k, _ in made], np.int64)
        self.ranks = np.array([i for _, i in made], np.int32)
        self.merged = np.arange(self.width, dtype=np.int32)
        self.specials = {}
        self.token_bytes = {i: t for t, i in ids.items()}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's ids begin (with the end last)."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self.rank(sym[:-1], sym[1:]), NONE)
        out_sym, out_word = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            if (low == NONE).any():
                live = np.repeat(low != NONE, length)
                out_sym.append(sym[~live])
                out_word.append(word[~live])
                sym, word, rank = sym[live], word[live], rank[live]
                length, low = length[low != NONE], low[low != NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            run = np.concatenate(([True], np.diff(hit) != 1))
            if not run.all():  # of overlapping places, as in "aaa", every second one from the left
                hit = hit[(hit - hit[run][np.cumsum(run) - 1]) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            at = hit - np.arange(len(hit))
            sym, word, rank = sym[stays], word[stays], rank[stays]
            for i in (at, at[at > 0] - 1):
                inner = i + 1 < len(sym)
                rank[i[~inner]] = NONE
                i = i[inner]
                rank[i] = np.where(word[i] == word[i + 1], self.rank(sym[i], sym[i + 1]), NONE)
        sym, word = np.concatenate([*out_sym, sym]), np.concatenate([*out_word, word])
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def pretokens(self, text: str) -> list[str]:
        """The words that are merged separately, without special tokens.

        Code points that Unicode versions class differently are left to the library's own splitter.
        """
        if text.isascii() or max(text) < STABLE:
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in library_splitter().pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[tuple[list[str], int | None]]:
        """(pre-tokens, id of the special token after them or None)."""
        if self.special is None or not any(s in text for s in self.specials):
            return [(self.pretokens(text), None)]
        parts = self.special.split(text)
        return [(self.pretokens(w) if w else [], self.specials.get(s)) for w, s in zip(parts[::2], [*parts[1::2], ""], strict=True)]

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(1)
def library_splitter():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


@lru_cache(4)
def load(path: str) -> ByteBPE:
    """One copy in each Python worker. The file has to be at the same path on all executors."""
    return ByteBPE(path)


class Memo:
    """What was worked out of each distinct word lately, in two generations of bounded size."""

    def __init__(self, compute, most: int = REMEMBERED):
        self.compute, self.most, self.new, self.old = compute, most, {}, {}
        REMEMBERING.append(self)

    def clear(self) -> None:
        self.new, self.old = {}, {}

    def table(self, words: set[str]) -> dict:
        """A value for each of words; the dictionary may hold others too."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        old, new = self.old, self.new
        unknown = []
        for w in words.difference(new):
            if (v := old.get(w)) is not None:
                new[w] = v
            else:
                unknown.append(w)
        if unknown:
            new.update(zip(unknown, self.compute(unknown), strict=True))
        return new


def word_codes(bpe: ByteBPE):
    """For each word its ids, and the same in decimal joined by commas."""

    def compute(words):
        ids, at = bpe.merge(words)
        ids, at = ids.tolist(), at.tolist()
        return [(t := tuple(ids[a:b]), ",".join(map(str, t))) for a, b in zip(at, at[1:], strict=False)]

    return compute


@lru_cache(4)
def coder(path: str) -> Memo:
    return Memo(word_codes(load(path)))


OUTPUTS = {
    "ids": T.StructField("ids", T.ArrayType(T.IntegerType())),
    "n_tokens": T.StructField("n_tokens", T.LongType()),
    "ids_sha256": T.StructField("ids_sha256", T.StringType()),
    "decoded": T.StructField("decoded", T.StringType()),
    "decoded_sha256": T.StructField("decoded_sha256", T.StringType()),
}


def encode(df: DataFrame, path: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """Encode whole texts, and decode them again where a decoded column is asked for.

    outputs: any of OUTPUTS. Null texts count as empty (no ids, decoded ""); special tokens inside
    a text become their ids; repeated rows are encoded alike; an empty table gives an empty table;
    input columns named like an output are replaced. A text of any length is worked on whole.
    """

    def build():
        bpe, memo = load(path), coder(path)

        def work(texts: pa.Array) -> dict:
            split = [bpe.pieces(t) for t in texts.to_pylist()]
            table = memo.table({w for doc in split for words, _ in doc for w in words})
            new = {name: [] for name in outputs}
            for doc in split:
                codes = []
                for words, special in doc:
                    codes += [table[w] for w in words]
                    if special is not None:
                        codes.append(((special,), str(special)))
                ids = list(chain.from_iterable([c[0] for c in codes]))
                if "ids" in new:
                    new["ids"].append(ids)
                if "n_tokens" in new:
                    new["n_tokens"].append(len(ids))
                if "ids_sha256" in new:
                    new["ids_sha256"].append(sha256(",".join([c[1] for c in codes]).encode()).hexdigest())
                if "decoded" in new or "decoded_sha256" in new:
                    text = bpe.decode(ids)
                    if "decoded" in new:
                        new["decoded"].append(text)
                    if "decoded_sha256" in new:
                        new["decoded_sha256"].append(sha256(text.encode()).hexdigest())
            return new

        return work

    return with_text_columns(df, [OUTPUTS[n] for n in outputs], build, text_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Turn arrays of ids back into text. Null arrays give "", unknown ids an error; a column named
    out_col is replaced."""
    kept = [f for f in df.schema.fields if f.name.lower() != out_col.lower()]
    schema = T.StructType([*kept, T.StructField(out_col, T.StringType())])
    names = [f.name for f in kept]

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(ids or ()) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
