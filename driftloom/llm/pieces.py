"""SentencePiece BPE: encoding that keeps where each piece came from, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows, and every
byte of the result remembers the source byte it was made from. The normalised text is cut where no
piece of the vocabulary can reach across, each distinct part is merged once, and the lengths of its
pieces lead through that record to their byte spans in the original text.
"""

from __future__ import annotations

import codecs
import heapq
import re
from functools import lru_cache
from hashlib import sha256
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Memo
from .common import with_text_columns

#: What stands for a space in pieces (fixed value of the format).
META = "▁"
#: Words up to so many characters are merged by scanning a list, longer ones through a heap.
SHORT = 48
NEVER = 1 << 30
KINDS = {"normal": 1, "unknown": 2, "control": 3, "defined": 4, "unused": 5, "byte": 6}

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class CharMap:
    """A compiled character map: which strings are replaced, the longest first, and by what.

    The format is a double array of 32-bit units, whose size comes first, and the replacements after it,
    each ended by a zero byte. A unit at p is a child by byte b of the node based at p ^ b where its
    label is b; so all children of all nodes are found by sorting the units by their base.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        units, texts = np.frombuffer(blob[4 : 4 + size], np.uint32).astype(np.int64), blob[4 + size :]
        at = np.arange(len(units))
        label = units & 0xFF
        inner = (units >> 31) == 0
        children = np.flatnonzero(inner & (label > 0))
        base = (at ^ label)[children]
        order = np.argsort(base, kind="stable")
        bases, first = np.unique(base[order], return_index=True)
        ends = [*first[1:].tolist(), len(order)]
        below = dict(zip(bases.tolist(), zip(first.tolist(), ends, strict=True), strict=True))
        children, label, units = children[order].tolist(), label.tolist(), units.tolist()
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        self.table: dict[str, str] = {}
        nodes = [(offset(units[0]), b"")]
        while nodes:
            node, key = nodes.pop()
            lo, hi = below.get(node, (0, 0))
            for p in children[lo:hi]:
                longer, child = key + bytes([label[p]]), p ^ offset(units[p])
                if units[p] >> 8 & 1:
                    start = units[child] & 0x7FFFFFFF
                    self.table[longer.decode("utf-8", "surrogateescape")] = texts[start : texts.index(b"\0", start)].decode("utf-8", "replace")
                nodes.append((child, longer))
        self.lengths: dict[str, list[int]] = {}
        for key in self.table:
            self.lengths.setdefault(key[0], []).append(len(key))
        for known in self.lengths.values():
            known.sort(reverse=True)

    def longest(self, text: str, at: int) -> tuple[str, int]:
        """What the text at a place becomes, and how many of its characters that replaces."""
        for n in self.lengths.get(text[at], ()):
            if (new := self.table.get(text[at : at + n])) is not None and at + n <= len(text):
                return new, n
        return text[at], 1


def char_starts(raw: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the place of the first byte of its character."""
    at = np.arange(len(raw), dtype=np.int32)
    return np.maximum.accumulate(np.where((raw & 0xC0) == 0x80, 0, at)) if len(raw) else at


class Normaliser:
    """A text as the model reads it, and for each of its bytes, and its end, a place in the source's bytes."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = META if self.escape else " "
        if self.map:
            firsts = "".join(map(re.escape, sorted({" ", *self.map.lengths})))
            self.odd = re.compile(f"[{firsts}]")

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int32)
        if self.map is None and not self.squeeze and self.escape:
            return self.plain(text)
        return self.mapped(text)

    def plain(self, text: str) -> tuple[str, np.ndarray]:
        """Without a map, only spaces change: one byte becomes three."""
        raw = np.frombuffer(text.encode(), np.uint8)
        source = np.repeat(char_starts(raw), np.where(raw == 0x20, 3, 1))
        head = [0, 0, 0] if self.prefix else []
        return META * self.prefix + text.replace(" ", META), np.concatenate([np.array(head, np.int32), source, np.array([len(raw)], np.int32)])

    def units(self, text: str):
        """(what it becomes, characters of the source): runs that nothing changes as a whole."""
        at = 0
        if self.map is None:
            for part in re.findall(" |[^ ]+", text):
                yield part, len(part), part != " "
            return
        while at < len(text):
            m = self.odd.search(text, at)
            end = m.start() if m else len(text)
            if end > at:
                yield text[at:end], end - at, True
            if not m:
                return
            new, n = self.map.longest(text, end)
            yield new, n, False
            at = end + n

    def mapped(self, text: str) -> tuple[str, np.ndarray]:
        out, source, used = [], [], 0
        units = list(self.units(text))
        if self.squeeze:  # spaces at the start are left out, and those after another
            first = next((k for k, u in enumerate(units) if u[0] != " "), len(units))
            at = sum(u[1] for u in units[:first])
            used = len(text[:at].encode())
            units = units[first:]
            if not units:
                return "", np.array([used], np.int32)
        else:
            at = 0
        wide = len(self.space.encode())
        if self.prefix:
            out.append(self.space)
            source.append(np.full(wide, used, np.int32))
        after_space = self.squeeze
        for new, n, same in units:
            size = len(text[at : at + n].encode())
            kept = new.lstrip(" ") if after_space else new
            if kept:
                if same:
                    source.append(char_starts(np.frombuffer(kept.encode(), np.uint8)) + np.int32(used))
                    out.append(kept)
                else:
                    shown = kept.replace(" ", self.space)
                    out.append(shown)
                    source.append(np.full(len(shown.encode()), used, np.int32))
                after_space = self.squeeze and kept.endswith(" ")
            used += size
            at += n
        whole, places = "".join(out), np.concatenate(source)
        while self.squeeze and whole.endswith(self.space):
            whole = whole[: -len(self.space)]
            used = int(places[-wide])
            places = places[:-wide]
        return whole, np.append(places, np.int32(used))


class PieceModel:
    """A SentencePiece model of the BPE kind with byte fallback, from a .model file.

    Other kinds, and models with unused or user-defined pieces, are an error."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = {p.type for p in spec.pieces}
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or kinds & {KINDS["unused"], KINDS["defined"]} or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, without unused or user-defined pieces")
        self.normalise = Normaliser(spec.normalizer_spec)
        self.id_of = {p.piece: k for k, p in enumerate(spec.pieces) if p.type == KINDS["normal"]}
        scores = sorted({p.score for p in spec.pieces if p.type == KINDS["normal"]}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        self.rank = {p.piece: rank[p.score] for p in spec.pieces if p.type == KINDS["normal"] and len(p.piece) > 1}
        self.byte_ids = [0] * 256
        self.surface, self.invisible = [], set()
        self.size = np.zeros(len(spec.pieces), np.int64)  # of the piece in the normalised text
        for k, p in enumerate(spec.pieces):
            if p.type == KINDS["byte"]:
                self.byte_ids[int(p.piece[1:-1], 16)] = k
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
                self.size[k] = 1
            elif p.type == KINDS["control"]:
                self.surface.append(b"")
                self.invisible.add(k)
            elif p.type == KINDS["unknown"]:
                self.surface.append(spec.trainer_spec.unk_surface.encode())
            else:
                self.surface.append(p.piece.replace(META, " ").encode())
                self.size[k] = len(p.piece.encode())
        self.leading = {k for k, p in enumerate(spec.pieces) if p.type == KINDS["normal"] and p.piece.startswith(META)}
        # an end of a text drops the space that its start was given
        self.strips = spec.normalizer_spec.add_dummy_prefix or spec.normalizer_spec.remove_extra_whitespaces
        self.strips_all = spec.normalizer_spec.remove_extra_whitespaces
        self.end = spec.trainer_spec.eos_id
        self.part = re.compile(self.parts([p for p in self.rank]), re.DOTALL)
        self._pairs()

    def parts(self, long: list[str]) -> str:
        """A pattern of what is merged by itself: no piece reaches over a space mark that is not at its
        start, nor to a character that only stands alone."""
        if any(META in p.lstrip(META) for p in long):
            return ".+"
        joined = "".join(map(re.escape, sorted(set("".join(long)) - {META})))
        return f"{META}+[{joined}]*|[{joined}]+|." if joined else f"{META}+|."

    def _pairs(self) -> None:
        """Numbers for pieces and for the characters of pieces, and the sorted pairs that make a piece, each
        with its rank and what it makes."""
        chars = sorted(set("".join(self.rank)) | {p for p in self.id_of if len(p) == 1})
        number = {c: k for k, c in enumerate(chars)} | {p: len(chars) + k for k, p in enumerate(self.rank)}
        self.points = np.array([ord(c) for c in chars], np.uint32)
        self.id_of_number = np.array([self.id_of.get(p, -1) for p in number], np.int64)
        self.width = len(number) + 1  # the last stands for a character of no piece
        made = [(number[p[:k]] * self.width + number[p[k:]], r, number[p]) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.keys, ranks, merged = (np.array(c, np.int64) for c in zip(*sorted(made), strict=True)) if made else (np.zeros(1, np.int64) - 1,) * 3
        self.pair_rank, self.pair_made = ranks.astype(np.int32), merged.astype(np.int32)
        self.names = list(map(str, range(len(self.size))))

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in keys, or -1."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words in one array, and where each word's begin (with the end last).

        In a round every word merges one pair: of its best pairs the leftmost. Words without a pair leave the array."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.points, points)
        at[at == len(self.points)] = 0
        sym = np.where(self.points[at] == points, at, self.width - 1).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)

        def looked_up(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = self.find(sym[i], sym[i + 1])
            return np.where(found >= 0, self.pair_rank[found], NEVER).astype(np.int32), found.astype(np.int32)

        rank, pair = np.full(len(sym), NEVER, np.int32), np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], pair[inner] = looked_up(inner)
        out_sym, out_word = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            if (low == NEVER).any():
                live = np.repeat(low != NEVER, length)
                out_sym.append(sym[~live])
                out_word.append(word[~live])
                sym, word, rank, pair = sym[live], word[live], rank[live], pair[live]
                length, low = length[low != NEVER], low[low != NEVER]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            hit = hit[np.concatenate(([True], word[hit][1:] != word[hit][:-1]))]
            sym[hit] = self.pair_made[pair[hit]]
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            at = hit - np.arange(len(hit))
            sym, word, rank, pair = sym[stays], word[stays], rank[stays], pair[stays]
            for i in (at, at[at > 0] - 1):
                rank[i], pair[i] = NEVER, -1
                i = i[i + 1 < len(sym)]
                i = i[word[i] == word[i + 1]]
                rank[i], pair[i] = looked_up(i)
        sym, word = np.concatenate([*out_sym, sym]), np.concatenate([*out_word, word])
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def pieces(self, word: str) -> list[str]:
        """Merge neighbours, the pair of the best score first and of equal ones the leftmost, until none fits."""
        if len(word) > SHORT:
            return self.pieces_of_long(word)
        known, at = list(word), self.rank.get
        ranks = [at(a + b, NEVER) for a, b in zip(known, known[1:], strict=False)]
        while ranks and (low := min(ranks)) != NEVER:
            k = ranks.index(low)
            known[k : k + 2] = [known[k] + known[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = at(known[k] + known[k + 1], NEVER)
            if k:
                ranks[k - 1] = at(known[k - 1] + known[k], NEVER)
        return known

    def pieces_of_long(self, word: str) -> list[str]:
        """The same in n log n: pairs wait in a heap, and those that have changed meanwhile are passed over."""
        known, n = list(word), len(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, 2) for k in range(n - 1) if (r := self.rank.get(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            j = right[k]
            if not known[k] or j >= n or len(known[k]) + len(known[j]) != size:
                continue
            known[k], known[j] = known[k] + known[j], ""
            right[k] = j = right[j]
            if j < n:
                left[j] = k
            for a, b in ((left[k], k), (k, right[k])):
                if a >= 0 and b < n and (r := self.rank.get(known[a] + known[b])) is not None:
                    heapq.heappush(heap, (r, a, len(known[a]) + len(known[b])))
        return [x for x in known if x]

    def codes(self, words: list[str]) -> list[tuple[tuple[int, ...], str]]:
        """The ids of each word, and the same in decimal joined by spaces. Short words are merged together in rounds,
        long ones, and those with a character that is no piece, one by one."""
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= SHORT]
        if short:
            sym, cut = self.merge([words[k] for k in short])
            ids = np.append(self.id_of_number, -1)[sym]
            whole = np.minimum.reduceat(ids, cut[:-1]) >= 0
            flat, cut = ids.tolist(), cut.tolist()
            for k, a, b, good in zip(short, cut, cut[1:], whole.tolist(), strict=False):
                if good:
                    own = flat[a:b]
                    out[k] = tuple(own), " ".join([self.names[i] for i in own])
        for k, word in enumerate(words):
            if out[k] is None:
                own = []
                for piece in self.pieces(word):
                    known = self.id_of.get(piece)
                    own += [known] if known is not None else map(self.byte_ids.__getitem__, piece.encode())
                out[k] = tuple(own), " ".join(map(str, own))
        return out

    def spans(self, ids: np.ndarray, source: np.ndarray) -> np.ndarray:
        """(begin, end) of each id in the bytes of the source. Only the last byte of a character that was
        taken apart has its span; the others are empty at its start."""
        size = self.size[ids]
        end = np.cumsum(size)
        return np.stack([source[end - size], source[end]], axis=1).astype(np.int32)

    def decode(self, ids) -> str:
        """The text of ids: control pieces have none, the space mark at the start goes, and a byte that is
        no part of a character becomes U+FFFD. A control piece ends a character."""
        runs = [ids] if self.invisible.isdisjoint(ids[:-1]) else [list(g) for hidden, g in groupby(ids, self.invisible.__contains__) if not hidden]
        out = "".join([b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "each_byte") for run in runs])
        if self.strips and out[:1] == " ":
            gone = 0
            for i in ids:
                if i not in self.invisible:
                    gone += i in self.leading
                    if not (self.strips_all and i in self.leading and self.surface[i] == b" "):
                        break
            out = out[gone:]
        return out


@lru_cache(4)
def load(path: str) -> PieceModel:
    """One copy in each Python worker. The file has to be at the same path on all executors."""
    return PieceModel(path)


@lru_cache(4)
def coder(path: str) -> Memo:
    return Memo(load(path).codes)


OUTPUTS = {
    "ids": T.StructField("ids", T.ArrayType(T.IntegerType())),
    "n_tokens": T.StructField("n_tokens", T.LongType()),
    "ids_sha256": T.StructField("ids_sha256", T.StringType()),
    "spans": T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    "spans_sha256": T.StructField("spans_sha256", T.StringType()),
    "decoded": T.StructField("decoded", T.StringType()),
    "decoded_sha256": T.StructField("decoded_sha256", T.StringType()),
}


def encode(df: DataFrame, path: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens", "spans"), end: bool = True) -> DataFrame:
    """Encode whole texts with the model at path, and decode them again where a decoded column is asked for.

    outputs: any of OUTPUTS. ids end with the model's end id if `end`; spans has the (begin, end) of each id
    in the bytes of the text in UTF-8 (the end id's is empty, at the end of what was read); spans_sha256
    is the hash of their little-endian 32-bit numbers. Null texts count as empty: no pieces, decoded "".
    Strings like <s> inside a text are ordinary text. Repeated rows are encoded alike; an empty table gives an
    empty table; input columns named like an output are replaced. A text of any length is worked on whole.
    """

    def build():
        model, memo = load(path), coder(path)
        closing = ((model.end,), str(model.end))

        def work(texts: pa.Array) -> dict:
            read = [model.normalise(t) for t in texts.to_pylist()]
            parts = [model.part.findall(t) for t, _ in read]
            table = memo.table(set(chain.from_iterable(parts)))
            new = {name: [] for name in outputs}
            for words, (_, source) in zip(parts, read, strict=True):
                codes = [table[w] for w in words]
                if end:
                    codes.append(closing)
                ids = list(chain.from_iterable([c[0] for c in codes]))
                if "spans" in new or "spans_sha256" in new:
                    spans = model.spans(np.array(ids, np.int64), source)
                    if "spans" in new:
                        new["spans"].append([{"begin": a, "end": b} for a, b in spans.tolist()])
                    if "spans_sha256" in new:
                        new["spans_sha256"].append(sha256(spans.tobytes()).hexdigest())
                if "ids" in new:
                    new["ids"].append(ids)
                if "n_tokens" in new:
                    new["n_tokens"].append(len(ids))
                if "ids_sha256" in new:
                    new["ids_sha256"].append(sha256(" ".join([c[1] for c in codes]).encode()).hexdigest())
                if "decoded" in new or "decoded_sha256" in new:
                    text = model.decode(ids)
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
    at = [f.name for f in kept].index(ids_col)

    def run(batches):
        model = load(path)
        for batch in batches:
            own = [batch.column(f.name) for f in kept]
            texts = [model.decode(ids or ()) for ids in own[at].to_pylist()]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
