"""Quality rules: counts over words and lines, and the fertility of public tokenisers."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo, load
from .common import with_text_columns

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: For each language or script the bands outside of which a text is rejected: characters per token
#: (least, most), most share of tokens that are pieces of a character, least token entropy as a
#: share of the entropy of as many tokens all different, in a text of 1,024 tokens. for
#: languages what fitted_bands gives on labelled documents, for scripts between prose and random letters.
#: A script that is not listed has no limit for pieces, as the vocabulary may have no tokens of it.
BANDS = {
    "en": (2.543, 7.0, 0.01, 0.624),
    "de": (2.614, 7.0, 0.01, 0.622),
    "fr": (2.285, 7.0, 0.01, 0.614),
    "es": (2.36, 7.0, 0.01, 0.601),
    "latin": (1.2, 7.0, 0.25, 0.50),
    "cyrillic": (1.0, 7.0, 0.40, 0.45),
    "greek": (0.9, 7.0, 0.50, 0.45),
    "arabic": (0.95, 7.0, 0.45, 0.45),
    "hebrew": (0.9, 7.0, 0.50, 0.45),
    "devanagari": (0.65, 7.0, 0.75, 0.45),
    "thai": (0.8, 7.0, 0.45, 0.45),
    "han": (0.65, 7.0, 0.60, 0.45),
    "kana": (0.7, 7.0, 0.50, 0.45),
    "hangul": (0.7, 7.0, 0.70, 0.45),
    "other": (0.3, 7.0, 1.0, 0.40),
}
#: Means over n tokens vary as 1 / sqrt(n): the least characters per token are lower by this share of the band
#: over sqrt(n), the most pieces higher by this over sqrt(n). In clean prose characters per token have a standard
#: deviation of 0.47 of their mean over sqrt(n), so that is 3.4 of it; pieces have 0.17 where they are 3 %.
FLOOR_WIDTH, SHARE_WIDTH = 1.6, 0.8
#: What fitted_bands leaves between clean documents and a band: a share of the floor, a share of tokens, a share of entropy.
MARGINS = (0.04, 0.01, 0.025)
#: Entropy, as a share, falls by so much with each doubling of a text.
ENTROPY_SLOPE = 0.052
#: Texts of fewer tokens are too short for the bands; the word rules see to them.
LEAST_TOKENS = 20
#: Texts of fewer tokens are too short for the band of entropy.
LEAST_ENTROPY_TOKENS = 40
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    places: dict[tuple, list[int]] = {}
    for p in np.flatnonzero(np.isin(mixed, twice)).tolist():
        places.setdefault(tuple(words[p : p + window]), []).append(p)
    edge = np.zeros(len(words) + 1, np.int64)
    for ps in places.values():
        if len(ps) > 1:
            at = np.array(ps)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge) > 0))


def dup_lines(data: bytes) -> int:
    lines = data.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: Counter = Counter(lines)
    return sum(k - 1 for line, k in seen.items() if k > 1 and line.split())


def fertility_of(path: str):
    """For each word its ids, and how many of them are only part of a character."""
    bpe = load(path)
    part = np.zeros(bpe.width + 1, np.int64)
    for i, b in bpe.token_bytes.items():
        try:
            b.decode()
        except UnicodeDecodeError:
            part[i] = 1

    def compute(words):
        ids, at = bpe.merge(words)
        sums = np.concatenate(([0], np.cumsum(part[ids])))
        parts, flat, cut = (sums[at[1:]] - sums[at[:-1]]).tolist(), bpe.shared[ids].tolist(), at.tolist()
        return [(tuple(flat[a:b]), n) for a, b, n in zip(cut, cut[1:], parts, strict=False)]

    return compute


@lru_cache(4)
def pieces(path: str) -> Memo:
    return Memo(fertility_of(path), most=40_000)


def measure(df: DataFrame, paths: tuple[str, str], text_col: str = "text") -> DataFrame:
    """Add the word and line counts (long), n_tokens, chars_per_token, byte_share and token_entropy
    (0 to 1) to every row.

    paths: the vocabularies for ASCII texts and for others. Null and empty texts have zeros, and
    entropy 1. Whole texts are measured.
    """
    fields = [T.StructField(n, T.LongType()) for n in (*METRICS, "n_tokens")]
    fields += [T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "byte_share", "token_entropy", "latin_share")]
    fields.append(T.StructField("script", T.StringType()))

    def build():
        bpe = load(paths[0])  # vocabularies split texts alike
        memos = [pieces(p) for p in paths]

        def work(texts: pa.Array) -> dict:
            whole = texts.to_pylist()
            split = [bpe.pretokens(t) for t in whole]
            wide = [not t.isascii() for t in whole]
            tables = [memo.table({w for ws, x in zip(split, wide, strict=True) if x == k for w in ws}) for k, memo in enumerate(memos)]
            new = {f.name: [] for f in fields}
            for text, data, pre, k in zip(whole, texts.cast(pa.binary()).to_pylist(), split, wide, strict=True):
                words = data.split()
                new["n_words"].append(len(words))
                new["word_chars"].append(len(text) - len(data) + len(data.translate(None, WHITE)))
                new["n_symbols"].append(len(data) - len(data.translate(None, SYMBOLS)))
                new["n_dup_lines"].append(dup_lines(data))
                new["n_repeat_words"].append(repeat_words(words))
                table = tables[k]
                found = [table[w] for w in pre]
                seen = Counter(chain.from_iterable([x[0] for x in found]))
                n = seen.total()
                counts = np.array(list(seen.values()), float)
                entropy = math.log2(n) - float((counts * np.log2(counts)).sum()) / n if n > 1 else 1.0
                new["n_tokens"].append(n)
                new["chars_per_token"].append(len(text) / n if n else 0.0)
                new["byte_share"].append(sum([x[1] for x in found]) / n if n else 0.0)
                new["token_entropy"].append(entropy / math.log2(n) if n > 1 else 1.0)
                latin_share, script = script_of(text) if k else (1.0, "latin")
                new["latin_share"].append(latin_share)
                new["script"].append(script)
            return new

        return work

    return with_text_columns(df, fields, build, text_col)


#: Where blocks of scripts start. Latin: ASCII and the Latin blocks to U+024F; marks and signs that
#: scripts share count as other.
STARTS = (
    (0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"),
    (0x750, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0x4DC0, "other"), (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = sorted({name for _, name in STARTS})
BLOCKS = np.array([at for at, _ in STARTS])
SCRIPT_OF_BLOCK = np.array([SCRIPTS.index(name) for _, name in STARTS])


def script_of(text: str) -> tuple[float, str]:
    """The share of Latin characters, and the script: Latin if that is nine in ten, else the most
    frequent of the others."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    seen = np.bincount(SCRIPT_OF_BLOCK[np.searchsorted(BLOCKS, points, side="right") - 1], minlength=len(SCRIPTS))
    latin = SCRIPTS.index("latin")
    share = float(seen[latin]) / len(text)
    seen[latin] = 0
    return share, "latin" if share >= 0.9 else SCRIPTS[int(np.argmax(seen))]


def judge(df: DataFrame, paths: tuple[str, str], text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Add the measures, base_failed, and kept, to every row.

    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word windows. kept: not
    base_failed, and the fertility lies within the bands of the row's language; where that is null
    or has no bands, those of its script (script_of). Bands widen for short texts as the measures vary there
    (FLOOR_WIDTH, SHARE_WIDTH, ENTROPY_SLOPE). Texts of fewer than LEAST_TOKENS tokens skip the
    bands, of fewer than LEAST_ENTROPY_TOKENS that of entropy.

    Null text counts as empty and fails; repeated rows are judged alike; an empty table stays empty;
    columns named like an added one are replaced.
    """
    m = measure(df, paths, text_col)
    script = F.col("script")
    lang = script
    if lang_col and lang_col.lower() in [c.lower() for c in df.columns]:
        known = F.lower(F.col(lang_col).cast("string"))
        lang = F.when(known.isin([k for k in BANDS if len(k) == 2]), known).otherwise(script)
    table = F.create_map(*[x for k, v in BANDS.items() for x in (F.lit(k), F.array(*[F.lit(float(b)) for b in v]))])
    band = F.element_at(table, lang)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    n = F.col("n_tokens")
    root = F.sqrt(n)
    fertile = (F.col("chars_per_token") >= band[0] * (1 - FLOOR_WIDTH / root)) & (F.col("chars_per_token") <= band[1])
    varied = (n < LEAST_ENTROPY_TOKENS) | (F.col("token_entropy") >= band[3] - ENTROPY_SLOPE * (F.log2(n) - 10))
    apart = fertile & (F.col("byte_share") <= band[2] + SHARE_WIDTH / root) & varied
    return m.withColumn("base_failed", base).withColumn("kept", ~base & ((F.col("n_tokens") < LEAST_TOKENS) | apart))


def fitted_bands(measured: DataFrame, good: str = "good", lang_col: str = "lang") -> dict[str, tuple[float, float, float, float]]:
    """Bands of each language just outside of its good documents, one row of sums for each language.

    measured: what judge gives, with a boolean column `good`; rows that fail the base rules or are too short
    for bands are left out."""
    n, low = F.col("n_tokens"), MARGINS
    clean = measured.where(F.col(good) & ~F.col("base_failed") & (n >= LEAST_TOKENS))
    found = clean.groupBy(F.lower(F.col(lang_col)).alias("lang")).agg(
        F.min(F.col("chars_per_token") / (1 - FLOOR_WIDTH / F.sqrt(n))).alias("least"), F.max(F.col("byte_share") - SHARE_WIDTH / F.sqrt(n)).alias("share"), F.min(F.when(n >= LEAST_ENTROPY_TOKENS, F.col("token_entropy") + ENTROPY_SLOPE * (F.log2(n) - 10))).alias("entropy")
    )
    return {r["lang"]: (round(r["least"] * (1 - low[0]), 3), 7.0, round(max(r["share"], 0.0) + low[1], 3), round(r["entropy"] - low[2], 3)) for r in found.collect() if r["lang"] and r["entropy"] is not None}


def keep_good(df: DataFrame, paths: tuple[str, str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df that the rules keep, with the columns of df."""
    own = [F.col(f"`{c}`") for c in df.columns]
    added = {*METRICS, "n_tokens", "chars_per_token", "byte_share", "token_entropy", "latin_share", "script", "base_failed", "kept"}
    if not added & {c.lower() for c in df.columns}:
        return judge(df, paths, text_col, lang_col).where("kept").select(own)
    boxed = df.select(F.struct(*own).alias("_row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return judge(boxed, paths).where("kept").select("_row.*")
