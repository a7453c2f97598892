"""The ten operators against brute force, and on null, empty, long, repeated and clashing input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from harness import DATA, spark_rows, sql_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from driftloom.llm import bpe, components, exact_dedup, license_scan, mixing, quality_classifier, quality_rules, queries, sharding, simhash, suffix_dedup, token_counts
from driftloom.llm.common import documents

SF = f"{DATA}/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
FERTILITY = tuple(public_tokenizers.path(n) for n in queries.FERTILITY)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark, extra=""):
    """Nulls in any column, empty and long texts, repeated rows, odd characters."""
    rng = random.Random(7)
    words = ["the", "of", "Über", "naïve", "漢字", "x" * 50, "<|endoftext|>", "cc", "by", "don't", "123", "…", "\U0001f600"]
    long = " ".join(rng.choices(words, k=12_000))
    texts = [None, "", " \n\t ", "a", "a", long, long, long + " end", "word " * 3_000, "\x00\x1c\x85nul", "漢" * 3_000, *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40))]
    rows = [(i, t, rng.choice(["en", "de", None, "xx"]), rng.choice(["s1", "s2", None]), 1) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "a", None, None, None), (None, None, None, None, None), (None, long, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("mine") for c in extra.split()}) if extra else df


def documents_of(spark, folder=SF):
    return documents(spark, folder)


def as_pandas(df):
    return df.toPandas()


def text(t):
    return t or ""


# 1, 7


def library():
    return Tokenizer.from_file(BPE)


def test_bpe_equals_the_library(spark):
    lib = library()
    for docs in (awkward(spark, "ids n_tokens"), documents_of(spark)):
        out = bpe.encode(docs, BPE, outputs=tuple(bpe.OUTPUTS)).collect()
        assert len(out) == docs.count()
        for r in out:
            want = lib.encode(text(r["text"]), add_special_tokens=False).ids
            back = lib.decode(want, skip_special_tokens=False)
            assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == back
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_bpe_random_strings_and_ranks():
    lib, own, ranks = library(), bpe.load(BPE), bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    pool = "aAbeth 12\n\t é漢字😀'ss<|endoftext|>՘ࢇ\x1c\x85~!.."
    for _ in range(400):
        t = "".join(rng.choices(pool, k=rng.randint(0, 80)))
        words = [w for part, _ in own.pieces(t) for w in part]
        for table in (own, ranks):
            ids, at = table.merge(words)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [lib.encode(w, add_special_tokens=False).ids for w in words] or any("<|endoftext|>" in w for w in words)


def test_decode_round_trip(spark):
    out = bpe.decode(bpe.encode(documents_of(spark), BPE, outputs=("ids",)), BPE)
    assert out.where(F.col("decoded") != F.col("text")).count() == 0


def test_token_counts_equal_the_library(spark):
    lib = library()
    for r in token_counts.token_counts(awkward(spark, "n_bytes"), BPE, limit=5).collect():
        n = len(lib.encode(text(r["text"]), add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text(r["text"]).encode()), n > 5)


@pytest.mark.parametrize("group_bytes", [1, 5_000])
def test_token_counts_do_not_depend_on_groups(spark, monkeypatch, group_bytes):
    want = [(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(awkward(spark), BPE).collect()]
    monkeypatch.setattr(token_counts, "GROUP_BYTES", group_bytes)
    out = token_counts.token_counts(awkward(spark, "_group _used words Text2"), BPE, keep_text=False)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_group", "_used", "words", "Text2", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_tokens"])) for r in out.collect())


def test_token_counts_of_texts_without_words(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "<|endoftext|>")]
    for some in (rows[:3], rows):
        out = token_counts.token_counts(spark.createDataFrame(some, "doc_id long, text string").coalesce(1), BPE).collect()
        assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == sorted((i, len(library().encode(t or "", add_special_tokens=False).ids)) for i, t in some)


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 4_000):
        v = rng.integers(0, 1 << rng.integers(1, 41, n), dtype=np.int64) if n else np.zeros(0, np.int64)
        raw, at = token_counts.packed(v)
        assert token_counts.unpacked(raw).tolist() == v.tolist() and at[-1] == len(raw)


def test_each_distinct_word_is_merged_once(spark, monkeypatch):
    """Equal words of different groups and of adjacent batches are not merged again."""
    words = sorted(["a", "b", "b", "bb", " the"] + [" of"] * 50)
    entries = spark.createDataFrame([(w, i, i) for i, w in enumerate(words)], "word string, group long, at int").coalesce(1)
    seen = []

    class Rows:
        def mapInArrow(self, run, schema):
            batches = [pa.RecordBatch.from_pylist([r.asDict() for r in entries.collect()[k : k + 7]]) for k in range(0, len(words), 7)]
            return [r for b in run(iter(batches)) for r in b.to_pylist()]

    merge = bpe.ByteBPE.merge
    monkeypatch.setattr(bpe.ByteBPE, "merge", lambda self, ws: seen.extend(ws) or merge(self, ws))
    out = token_counts.piece_counts(Rows(), BPE)
    assert sorted(seen) == sorted(set(words))
    assert [r["counted"] & 0xFFFFFFFF for r in out] == [len(library().encode(w, add_special_tokens=False).ids) for w in words]


# 2


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_brute_force(spark, keep):
    docs = awkward(spark, "keep_id kept _n _h _best")
    groups = {}
    for r in docs.collect():
        groups.setdefault(text(r["text"]), []).append(r["doc_id"])
    best = {t: getattr(__builtins__, keep, None) or (min if keep == "min" else max) for t in groups}
    out = exact_dedup.exact_groups(docs, keep=keep).collect()
    assert len(out) == docs.count()
    for r in out:
        ids = groups[text(r["text"])]
        known = [i for i in ids if i is not None]
        want = best[text(r["text"])](known) if known else None
        assert (r["keep_id"], r["group_size"], r["kept"]) == (want, len(ids), r["doc_id"] == want)
        assert r["text_sha256"] == hashlib.sha256(text(r["text"]).encode()).hexdigest()


@pytest.mark.parametrize("keep", ["min", "max"])
def test_one_row_of_each_text_stays(spark, keep):
    docs = awkward(spark, "_t _h h t")
    for df in (docs, docs.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))):
        out = exact_dedup.drop_copies(df, keep=keep)
        assert out.columns == df.columns
        rows, best = out.collect(), {}
        for r in docs.collect():
            best.setdefault(text(r["text"]), []).append(r["doc_id"])
        pick = min if keep == "min" else max
        want = {t: pick([i for i in ids if i is not None], default=None) for t, ids in best.items()}
        assert len(rows) == len(want) and all(want[text(r["text"])] == r["doc_id"] for r in rows)


def test_one_row_of_each_near_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join([*words[:59], "other"])
    rows = [(1, a), (1, a), (2, b), (None, "x y z"), (None, "x y z"), (3, None), (3, ""), (None, " ".join(words[::-1])), (None, " ".join([*words[:0:-1], "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_copies(spark, df, "").collect()
    assert Counter(r["doc_id"] for r in kept) == {1: 1, 3: 1, None: 2}


# 3


def test_classifier_held_out_accuracy(spark):
    out = as_pandas(queries.op3_quality_classifier(spark, f"{DATA}/sf0.01")).set_index("doc_id")
    marks = as_pandas(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")).set_index("doc_id").join(out)
    assert all(out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.index])
    held = marks[marks.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_classifier_never_learns_from_held_out_labels(spark):
    docs, marks = documents_of(spark), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = marks.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [quality_classifier.classify(docs, m).select("doc_id", F.round("score", 6).alias("s")).orderBy("doc_id").collect() for m in (marks, turned)]
    assert scores[0] == scores[1]


def test_classifier_awkward(spark):
    marks = spark.createDataFrame([(3, 1), (3, 0), (5, None), (None, 1), (99, 1), (11, 1), (12, 0)], "doc_id long, quality int")
    docs = awkward(spark, "score held_out")
    for m in (marks, marks.limit(0)):
        out = quality_classifier.classify(docs, m).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in out} == {0.5}


def test_isotonic():
    import numpy as np

    assert quality_classifier.isotonic(np.array([1.0, 0, 2, 3]), np.array([2.0, 2, 2, 3])) == [(1.0, 4.0, 2), (5.0, 5.0, 2)]
    knots, levels = quality_classifier.calibration(np.array([0.0, 0.1, 0.9, 1.0]), np.array([0.0, 1, 0, 3]), np.array([4.0, 2, 1, 3]))
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all() and levels[0] > 0 and levels[-1] < 1
    assert levels[1:-1].tolist() == pytest.approx([0.5 / 5, 1.5 / 4, 3.5 / 4]) and knots[1:-1].tolist() == pytest.approx([0, 1.1 / 3, 1])


def test_classifier_equals_a_plain_model(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, len(quality_classifier.STATS)))
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=400) > 0.7).astype(int)
    fold = rng.integers(0, 5, 400)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], "stats array<double>, label int, fold int")
    model = quality_classifier.fit(rows)
    draw = np.random.default_rng(11)
    waves, phases = draw.normal(size=(x.shape[1], quality_classifier.FEATURES)) / quality_classifier.WIDTH, draw.uniform(0, 2 * np.pi, quality_classifier.FEATURES)
    z = np.cos(np.clip((x - x.mean(0)) / x.std(0), -6, 6) @ waves + phases) * np.sqrt(2 / quality_classifier.FEATURES)
    z = np.hstack([z, np.ones((400, 1))])
    a, b = z[fold > 0], y[fold > 0]
    ridge = np.diag([1e-4 * 400 + 0.1] * quality_classifier.FEATURES + [1e-6])
    weights = np.linalg.solve(a.T @ a + ridge, a.T @ b)
    assert model.raw(x) == pytest.approx(z @ weights, abs=1e-6)
    raw, ones = (z @ weights)[fold == 0], y[fold == 0]
    order = np.argsort(raw)
    held = [[r, r, o, 1.0] for r, o in zip(raw[order], ones[order], strict=True)]  # pool plainly, row by row
    level = lambda block: block[2] / block[3]
    while any(level(p) >= level(q) for p, q in zip(held, held[1:], strict=False)):
        k = next(k for k, (p, q) in enumerate(zip(held, held[1:], strict=False)) if level(p) >= level(q))
        p, q = held[k], held.pop(k + 1)
        held[k] = [p[0], q[1], p[2] + q[2], p[3] + q[3]]
    for first, last, t, n in held:  # the model's levels follow those of the plain blocks
        inside = model.score(x[fold == 0])[(raw >= first) & (raw <= last)]
        assert len(inside) == n and abs(inside.mean() - (t + 0.5) / (n + 1)) < 0.25
    assert (np.diff(model.score(x)[np.argsort(z @ weights)]) >= -1e-12).all()


def test_classifier_scores_are_no_certainties(spark):
    import numpy as np

    out = as_pandas(queries.op3_quality_classifier(spark, f"{DATA}/sf0.01")).set_index("doc_id")
    marks = as_pandas(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")).set_index("doc_id").join(out)
    held = marks[marks.held_out]
    loss = -np.where(held.quality == 1, np.log(held.score), np.log(1 - held.score)).mean()
    assert out.score.between(0.001, 0.999).all() and out.score.nunique() > 0.8 * len(out) and loss < 0.2


# 4


def removed(texts, n):
    raw = [text(t).encode() for t in texts]
    seen = Counter(b[k : k + n] for b in raw for k in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def results(df):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_suffix_dedup_brute_force(spark):
    rng = random.Random(3)
    passages = ["".join(rng.choices("abc de", k=rng.randint(40, 160))) for _ in range(12)]
    texts = [None, "", "z" * 300, "ab" * 200, "z" * 59, passages[0], passages[0]]
    for _ in range(120):
        texts.append("".join(rng.choice([rng.choice(passages)[rng.randint(0, 20) :], "".join(rng.choices("abc de", k=rng.randint(0, 90)))]) for _ in range(rng.randint(1, 6))))
    df = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    assert results(suffix_dedup.remove_repeats(df, length=60)) == removed(texts, 60)


def test_suffix_dedup_of_a_row_that_repeats(spark):
    """Rows that repeat an id and a text share one list of runs, however many there are."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = word(400)
    rows = [(1, word(90) + passage + word(300))] * 40 + [(None, passage + word(200))] * 40 + [(2, passage[:250] + word(150)), (3, word(500)), (None, word(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert results(suffix_dedup.remove_repeats(df, length=100)) == removed([t for _, t in rows], 100)


def test_suffix_dedup_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=330))
    cut = lambda: passage[rng.choice([0, 0, 3, 40]) : rng.choice([330, 330, 200, 151])]
    noise = lambda: "".join(rng.choices("abcdefgh ", k=rng.choice([1, 5, 90])))
    texts = [noise() + cut() + noise() + rng.choice(["", passage[100:290]]) for _ in range(60)] + ["ab" * 150, "ab" * 99]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert results(suffix_dedup.remove_repeats(df, length=100)) == removed(texts, 100)


def test_equal_anchors_meet_after_a_join(spark, monkeypatch):
    """A join that is split or read locally at run time must not take the runs of an anchor apart."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    rng = random.Random(6)
    passages = ["".join(rng.choices("abcdefgh ", k=330)) for _ in range(40)]
    passages += passages[:1] * 20
    texts = ["".join(rng.choices("abcdefgh ", k=9)) + rng.choice(passages)[rng.randint(0, 60) : rng.randint(260, 330)] for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "100", "spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k"}
    held["spark.sql.adaptive.autoBroadcastJoinThreshold"] = "256k"
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        assert results(suffix_dedup.remove_repeats(df, length=100)) == removed(texts, 100)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_suffix_dedup_awkward(spark):
    df = awkward(spark)
    assert results(suffix_dedup.remove_repeats(df)) == removed([r["text"] for r in df.collect()], 200)
    kept = suffix_dedup.remove_repeats(df, with_kept=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in kept)


def test_suffix_family_levels():
    rng = random.Random(5)
    family, every = suffix_dedup.SuffixFamily(5), []
    for _ in range(40):
        data = "".join(rng.choices("ab", k=rng.randint(5, 60))).encode()
        starts = list(range(len(data) - 4))
        family.add(data, __import__("numpy").array(starts))
        every += [data[k : k + 5] for k in starts]
    seen = Counter(every)
    assert family.repeated().tolist() == [seen[w] > 1 for w in every]
    assert len(family.levels) <= len(every).bit_length()


# 5


def fingerprint(t, n=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text(t)))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_ids(fps, ids, radius):
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for f, i in zip(fps, ids, strict=True):
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return [least.get(top(f)) for f in fps]


@pytest.mark.parametrize("radius", [3, 6])
def test_simhash_brute_force(spark, radius):
    for docs in (awkward(spark, "fingerprint"), documents_of(spark)):
        rows = docs.collect()
        fps = [fingerprint(r["text"]) for r in rows]
        want = sorted(zip([str(r["doc_id"]) for r in rows], [f"{f:016x}" for f in fps], map(str, linked_ids(fps, [r["doc_id"] for r in rows], radius)), strict=True))
        out = simhash.near_groups(docs, radius=radius)
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in out.collect()) == want


def test_simhash_blocks_of_a_hot_bucket(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    fps = [base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(90)]
    marked = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "i long, fp0 long")
    out = {r["fingerprint"]: r["component_id"] for r in simhash.component_ids(marked, 1, 3, None, simhash.hexed(1)).collect()}
    assert [out[f"{f:016x}"] for f in fps] == linked_ids(fps, list(range(90)), 3)


def test_wide_simhash_finds_similar_and_spares_others(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5_000)]
    texts, groups = [], []
    for g in range(60):
        base = rng.choices(words, k=200)
        for k in range(3 if g % 2 else 1):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(200)] = rng.choice(words)
            texts.append(" ".join(copy))
            groups.append(g)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.one_of_each(df, shingle=5, words=4, radius=58, similarity=0.8, distinct=True)
    assert Counter(groups[r["doc_id"]] for r in kept.collect()) == Counter(range(60))


def test_near_copies_by_exact_similarity(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(150):  # pairs of n and n shingles of which k are shared, at and below 0.8
        n = rng.choice([45, 90, 180])
        base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        for share in (1.0, 0.8, 0.79, 0.7):
            k = -int(-2 * n * share // (1 + share)) if share >= 0.8 else int(2 * n * share / (1 + share))
            texts.append(" ".join(base[: k + 4] + [f"x{rng.randrange(10**6)}" for _ in range(n - k)]))
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for g in range(0, len(texts), 4):
        for i in range(g, g + 4):
            for j in range(g, i):
                if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                    x, y = top(i), top(j)
                    up[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if top(i) == i}
    assert 200 < len(want) < 500
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert want <= kept and len(kept - want) <= 2


@pytest.mark.parametrize("block", [1, 3_000, 1 << 23])
def test_pairs_left_out_of_a_tree_are_checked(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "OPEN_BYTES", block)
    words = [f"w{i}" for i in range(204)]
    texts = [" ".join(words[a : a + 164]) for a in range(0, 37, 3)]  # chains of 0.8 or more, ends at 0.6
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, "").collect()] == [0]


@pytest.mark.parametrize("block", [4_000, 1 << 23])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    """Copies of one text with edits of their own: some are near it, some only near each other or nothing."""
    monkeypatch.setattr(simhash, "OPEN_BYTES", block)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    want = sorted(i for i in range(len(texts)) if top(i) == i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, "").collect()) == want


def test_components_of_chains_and_stars(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x0", f"x{i}") for i in range(1, 50)] + [("q", "q"), ("b", "a"), ("a", "b")]
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {out[f"{i:03}"] for i in range(61)} == {"000"} and {out[f"x{i}"] for i in range(50)} == {"x0"} and out["b"] == "a" and "q" not in out


# 6


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[n] for n in free)
        over = [n for n in free if left * w[n] / total > most * sizes[n]]
        if not over:
            return target | {n: left * w[n] / total for n in free}
        for n in over:
            target[n] = most * sizes[n]
            free.discard(n)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def test_mixing_brute_force(spark):
    rng = random.Random(6)
    uneven = [(i, "w " * rng.randint(0, 40) * (30 if i % 50 == 0 else 1), "en", f"s{min(rng.randint(0, 9), 5)}", 1) for i in range(800)]
    for docs in (awkward(spark, "size target _size _words _coin _rate"), documents_of(spark), spark.createDataFrame(uneven, DOCS)):
        out = mixing.mix_counts(docs).collect()
        assert len(out) == docs.count()
        sizes, taken = Counter(), Counter()
        for r in out:
            assert r["size"] == len(WORD.findall(text(r["text"]))) and 0 <= r["taken"] <= 2 * r["size"]
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
        want = filled(dict(sizes))
        for r in out:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        squares = Counter()
        for r in out:
            rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
            share = int(hashlib.sha256(str(r["doc_id"] if r["doc_id"] is not None else "null").encode()).hexdigest()[:8], 16) / 2**32
            assert r["copies"] == int(rate) + (share < rate - int(rate))
            squares[r["source"]] += r["size"] ** 2
        assert all(abs(taken[s] - want[s]) <= 2 * squares[s] ** 0.5 for s in sizes)  # four deviations at most
        again = mixing.mix_counts(docs.repartition(3)).collect()
        assert sorted(map(str, [(r["doc_id"], r["taken"]) for r in out])) == sorted(map(str, [(r["doc_id"], r["taken"]) for r in again]))
        assert mixing.mix(docs).count() == sum(r["copies"] for r in out) and mixing.mix(docs).columns == docs.columns


def test_mixing_source_column_named_like_a_result(spark):
    docs = documents_of(spark)
    out = mixing.mix_counts(docs.withColumnRenamed("source", "size"), source_col="size")
    want = mixing.mix_counts(docs)
    assert sorted(map(tuple, out.select("doc_id", "size", "taken").collect())) == sorted(map(tuple, want.select("doc_id", "size", "taken").collect()))


# 8


def scheduled(weights, shards):
    """Longest-processing-time scheduling of single items, one after the other."""
    loads = [0] * shards
    for w in sorted(weights, reverse=True):
        loads[loads.index(min(loads))] += w
    return loads


def test_sharding_laws(spark):
    for docs, shards in ((awkward(spark, "shard slot _g _cell _group _s _c n first"), 5), (documents_of(spark), 7), (documents_of(spark, f"{DATA}/sf0.01"), 24)):
        out = sharding.shard_by_bytes(docs, shards=shards).collect()
        assert len(out) == docs.count()
        where, loads, slots, groups = {}, Counter(), {}, Counter()
        for r in out:
            t = text(r["text"]).encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "bytes", None)
            where.setdefault(t, set()).add(r["shard"])
            loads[r["shard"]] += r["size"]
            groups[t] += r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(len(s) == 1 for s in where.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert [loads[s] for s in range(shards)] == scheduled(groups.values(), shards)


def test_longest_first_deals_equal_sizes_as_one_by_one():
    rng = random.Random(12)
    for _ in range(200):
        shards = rng.randint(1, 6)
        items = {rng.randint(0, 30): rng.randint(1, rng.choice([3, 60])) for _ in range(rng.randint(0, 9))}
        plan = sharding.longest_first(list(items.items()), shards)
        loads = [0] * shards
        for size, s, first, n in plan:
            loads[s] += size * n
        assert loads == scheduled([size for size, n in items.items() for _ in range(n)], shards)
        for size, n in items.items():
            assert sorted(k for z, _, first, many in plan if z == size for k in range(first, first + many)) == list(range(n))


# 9


def test_license_base_brute_force(spark):
    rng = random.Random(8)
    parts = ["CC", "by", "cc-BY", "General", "public", "license", "all rights", "reserved", "x", "é", ", ", "\n", "CCby", "All\trights  Reserved.", "general public license"]
    texts = [None, "", *(" ".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(200)), "cc by " * 3_000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id int, text string, labels string")
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in license_scan.scan(df).collect():
        words = split.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text(r["text"])))
        places = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


LICENSE_CASES = {
    "Licensed under the Apache License, Version 2.0 (the License)": [("apache-2.0", 95)],
    "Apache License, Version 1.1": [("apache-1.1", 61)],
    "Mozilla Public License 1.1": [("mpl-1.1", 61)],
    "Mozilla Public License, v. 2.0": [("mpl-2.0", 61)],
    "SPDX-License-Identifier: MIT": [("mit", 100)],
    "// SPDX-License-Identifier: GPL-2.0-only": [("gpl-2.0", 100)],
    "SPDX-License-Identifier: GPL-3.0-or-later WITH GCC-exception-3.1 */": [("gpl-3.0", 100)],
    "SPDX-License-Identifier: (Apache-2.0 OR MIT)\nCopyright": [("apache-2.0", 100), ("mit", 100)],
    "SPDX-License-Identifier: LGPL-2.1+ by others": [("lgpl-2.1", 100)],
    "released under the GNU Lesser General Public License v3": [("lgpl-3.0", 95)],
    "under the GNU General Public License version 2 or later": [("gpl-2.0", 61)],
    "it is GPLv3": [("gpl-3.0", 61)],
    "it is GPL-2.0": [("gpl-2.0", 61)],
    "the BSD License": [("bsd", 60)],
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")": [("mit", 97)],
    "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:": [("bsd", 97)],
    "GNU General Public License": [("gpl", 60)],
    "Apache License, version 7.3": [("apache", 60)],
    "nothing of the kind, mit freundlichen Grüßen": [],
    "This is released under MIT.": [("mit", 86)],
    "License: MIT": [("mit", 90)],
    'license = "MIT OR Apache-2.0"': [("mit", 90), ("apache-2.0", 90)],
    '"license": "BSD-3-Clause",': [("bsd-3-clause", 90)],
    "licensed under the MIT.": [("mit", 86)],
    "under the Apache 2.0 license": [("apache-2.0", 66)],
    "Apache-2.0 license": [("apache-2.0", 58)],
    "an MIT-licensed tool": [("mit", 58)],
    "Dual licensed MIT/Apache-2.0": [("mit", 82), ("apache-2.0", 82)],
    "(MIT/Apache-2.0)": [("mit", 57), ("apache-2.0", 57)],
    "it is in the public domain": [("public-domain", 55)],
    "https://www.apache.org/licenses/LICENSE-2.0": [("apache-2.0", 99)],
    "https://creativecommons.org/licenses/by-nc/4.0/": [("cc-by-nc-4.0", 99)],
    "http://www.boost.org/LICENSE_1_0.txt": [("bsl-1.0", 99)],
    "https://www.gnu.org/licenses/gpl-3.0.html": [("gpl-3.0", 99)],
    "https://www.gnu.org/licenses/gpl.html": [("gpl", 98)],
    "SPDX-License-Identifier: see LICENSE file": [],
    "SPDX-License-Identifier: NONE": [],
    "SPDX-License-Identifier: LicenseRef-Own": [],
    "SPDX-License-Identifier: MIT AND Own-Terms": [("mit", 100)],
    "License: see the file, or ask": [],
    "published under great difficulties, released under elastic rules": [],
    "a licensed driver, under the weather": [],
    "mit license/bsd": [("mit", 60)],
    "and/or, input/output, his/her": [],
    "use of this source code is governed by a BSD-style license": [("bsd", 97)],
}


def test_license_rules():
    rules = license_scan.rule_table()
    assert len(rules) > 400
    for t, want in LICENSE_CASES.items():
        assert [(d.label, d.priority) for d in license_scan.scanner().scan(t.lower().encode())[1]] == want, t


def test_every_sentence_and_name_is_found():
    scan = license_scan.scanner().scan
    for label, sentence in license_scan.SENTENCES:
        assert label in {d.label for d in scan(sentence.encode())[1]}
    for label, names, _, _ in license_scan.LICENSES:
        for name in names:
            assert any(d.label.startswith(label.split("-")[0]) or label == "public-domain" for d in scan(name.encode())[1]), name


def test_the_filter_hides_no_rule():
    """Labels equal those of all rules tried on every text, without keywords."""
    rng, rules = random.Random(13), license_scan.rule_table()
    parts = [*LICENSE_CASES, "and", "or later", "version 2", ", ", "\n", "see the", "for details"]
    for _ in range(150):
        low = " ".join(rng.choices(parts, k=rng.randint(1, 5))).lower().encode()
        every = [license_scan.Detection(m.start(), m.end(), r.label, r.priority, r.base) for r in rules for m in r.pattern.finditer(low)]
        assert license_scan.scanner().scan(low)[1] == license_scan.suppressed(every + license_scan.notices(low))


def test_labels_and_score_of_a_text(spark):
    """labels are the base ones and those left by suppression; the score is the best of those."""
    rows = ["License: MIT\nall rights reserved, cc by", "SPDX-License-Identifier: none", "released under GPLv3, see https://www.gnu.org/licenses/gpl-3.0.html", "cc by 4.0", None, "under the General Public License"]
    got = [(r["base_labels"], r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == [("cc-by,reserved", "cc-by,mit,reserved", 0.9), ("", "", 0.0), ("", "gpl-3.0", 0.99), ("cc-by", "cc-by,cc-by-4.0", 0.61), ("", "", 0.0), ("gpl", "gpl", 0.5)]


def test_labels_are_known():
    """No label outside of the list, whatever stands after a tag or in a notice."""
    allowed = license_scan.KNOWN | set(license_scan.PHRASES.values()) | {label for label, _ in license_scan.SENTENCES}
    rng = random.Random(21)
    words = ["spdx-license-identifier:", "license:", "under", "licensed", "the", "mit", "apache", "2.0", "v3", "gplv2", "or", "/", "with", "none", "see", "license", "file", "unknown-1.0", "(", ")", "elastic", "bsd-9-clause", ",", "public domain"]
    for _ in range(600):
        low = " ".join(rng.choices(words, k=rng.randint(1, 12))).encode()
        assert {d.label for d in license_scan.scanner().scan(low)[1]} <= allowed


def test_suppression():
    D = license_scan.Detection
    found = [D(0, 10, "a", 50, False), D(2, 8, "b", 50, False), D(2, 8, "c", 90, False), D(0, 10, "d", 40, False), D(8, 12, "e", 40, False)]
    assert [d.label for d in license_scan.suppressed(found)] == ["a", "c", "e"]


# 10


def test_quality_rules_brute_force(spark):
    docs = awkward(spark, "n_words kept")
    for frame in (docs, documents_of(spark)):
        out = quality_rules.judge(frame, FERTILITY).collect()
        assert len(out) == frame.count()
        for r in out:
            t = text(r["text"])
            words = WORD.findall(t)
            windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
            inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
            lines = Counter(x for x in t.split("\n") if WORD.search(x))
            want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(k - 1 for k in lines.values()), len(inside))
            assert tuple(r[m] for m in quality_rules.METRICS) == want
            assert r["base_failed"] == (len(words) < 20 or 100 * len(inside) > 30 * len(words)) and not (r["kept"] and r["base_failed"])
    kept = quality_rules.keep_good(docs, FERTILITY)
    assert kept.columns == docs.columns and {r["kept"] for r in kept.select("kept").collect()} <= {"mine"}


def marked(spark, sf):
    docs = documents(spark, f"{DATA}/{sf}").join(spark.read.parquet(f"{DATA}/{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    return quality_rules.judge(docs, FERTILITY)


def test_bands_are_what_one_table_gives(spark):
    """The bands of languages come from sf0.1, as fitted_bands finds them there."""
    judged = marked(spark, "sf0.1").withColumn("good", F.col("quality") == 1)
    fitted = quality_rules.fitted_bands(judged)
    assert set(fitted) == {"en", "de", "fr", "es"}
    for lang, band in fitted.items():
        assert band == pytest.approx(quality_rules.BANDS[lang], abs=0.0011)


def test_junk_of_another_table_is_rejected_and_clean_kept(spark):
    """Reported on sf0.01, from which no band was taken."""
    judged = marked(spark, "sf0.01").where("not base_failed")
    seen = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert (1, False) not in seen and seen[0, False] > 5 * seen.get((0, True), 0)


def test_kept_follows_from_the_measures(spark):
    """The verdict recomputed from the measures of each row, with the widths as written down."""
    for frame in (awkward(spark), documents_of(spark, f"{DATA}/sf0.01")):
        for r in quality_rules.judge(frame, FERTILITY).collect():
            lang = (r["lang"] or "").lower()
            least, most, share, entropy = quality_rules.BANDS[lang if lang in ("en", "de", "fr", "es") else r["script"]]
            n, root = r["n_tokens"], max(r["n_tokens"], 1) ** 0.5
            inside = least * (1 - 1.6 / root) <= r["chars_per_token"] <= most and r["byte_share"] <= share + 0.8 / root
            varied = n < 40 or r["token_entropy"] >= entropy - 0.052 * (np.log2(n) - 10)
            assert r["kept"] == (not r["base_failed"] and (n < 20 or (inside and varied)))


PROSE = {
    "cyrillic": "Вчера вечером мы долго гуляли по старому городу и говорили о книгах, которые прочитали за последний год. Погода была хорошая, и на улицах было много людей.",
    "arabic": "في مساء أمس مشينا طويلا في المدينة القديمة وتحدثنا عن الكتب التي قرأناها خلال العام الماضي وكان الطقس جميلا والناس في الشوارع",
    "devanagari": "कल शाम हम पुराने शहर में देर तक घूमे और उन किताबों के बारे में बात की जो हमने पिछले साल पढ़ी थीं। मौसम अच्छा था।",
    "han": "昨天 晚上 我们 在 老城 里 走了 很久 谈论 过去 一年 读过 的 书 天气 很好 街上 有 很多 人 孩子们 在 公园 里 玩耍 老人 坐在 树下 聊天",
    "hangul": "어제 저녁 우리는 오래된 도시를 오랫동안 걸으며 지난 한 해 동안 읽은 책에 대해 이야기했다. 날씨가 좋았고 거리에는 사람이 많았다. 우리는 늦게 집으로 돌아왔다.",
}


def test_scripts_have_bands(spark):
    rng = random.Random(1)
    blocks = {"cyrillic": (0x400, 0x52F), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7A3)}
    rows = [(k, 1, t) for k, t in PROSE.items()]
    rows += [(k, 0, " ".join("".join(chr(rng.randint(*b)) for _ in range(6)) for _ in range(40))) for k, b in blocks.items()]
    out = quality_rules.judge(spark.createDataFrame(rows, "name string, good int, text string"), FERTILITY).collect()
    for r in out:
        assert r["script"] == r["name"] and not r["base_failed"]
    assert [r["name"] for r in out if r["kept"] != (r["good"] == 1)] == []


def test_short_texts_have_bands(spark):
    words = "the of and to in a is that for it as was with be by on not he".split()
    rows = [(" ".join(words + ["his", "but"]), True), (" ".join(words + ["\U00010a0c", "\U00010a11"]), False)]
    out = quality_rules.judge(spark.createDataFrame([(t, "en", good) for t, good in rows], "text string, lang string, good boolean"), FERTILITY).collect()
    assert all(20 <= r["n_tokens"] < 40 and not r["base_failed"] and r["kept"] == r["good"] for r in out)


# all


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    marks = spark.createDataFrame([], "doc_id long, quality int")
    frames = [
        bpe.encode(none, BPE), token_counts.token_counts(none, BPE), exact_dedup.exact_groups(none), quality_classifier.classify(none, marks), suffix_dedup.remove_repeats(none),
        simhash.near_groups(none), simhash.one_of_each(none), mixing.mix_counts(none), mixing.mix(none), sharding.shard_by_bytes(none), license_scan.scan(none), quality_rules.judge(none, FERTILITY),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_scratch_is_cleared(spark):
    from pathlib import Path

    from driftloom.llm import common

    table = common.written(spark.range(3), "x")
    path = Path(common.SCRATCH[-1])
    assert table.count() == 3 and path.exists()
    common.clear_scratch(spark)
    assert not path.exists() and not common.SCRATCH


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(queries.ORACLES[name], "sf0.001")


COLUMNS = {
    "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_quality_classifier": "doc_id held_out score predicted",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_return_every_document(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns) and df.count() == documents_of(spark).count()


def test_columns_named_like_helpers_stay(spark):
    """Whatever an operator calls its own columns, those of its input come out as they were."""
    names = "_i _th _n i th fp0 fp1 FP2 fp3 fp4 node best stats _stats key root _own0 _row u v".split()
    docs = awkward(spark, " ".join(names))
    plain = awkward(spark)
    near = simhash.one_of_each(docs, shingle=5, words=4, radius=58, similarity=0.8, distinct=True)
    assert near.columns == docs.columns
    want = simhash.one_of_each(plain, shingle=5, words=4, radius=58, similarity=0.8, distinct=True)
    assert sorted(map(str, (r["doc_id"] for r in near.collect()))) == sorted(map(str, (r["doc_id"] for r in want.collect())))
    assert {r[n] for r in near.collect() for n in names} == {"mine"}
    groups = simhash.near_groups(docs)
    assert set(names) <= set(groups.columns) and {r[n] for r in groups.collect() for n in names} == {"mine"}
    pair = lambda df: sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in df.collect())
    assert pair(groups) == pair(simhash.near_groups(plain))
    marks = spark.createDataFrame([(i, i % 2) for i in range(0, 50)], "doc_id long, quality int")
    scored = quality_classifier.classify(docs, marks)
    assert {r[n] for r in scored.collect() for n in names} == {"mine"} and scored.count() == docs.count()
    for out in (bpe.encode(docs, BPE), suffix_dedup.remove_repeats(docs)):
        assert out.count() == docs.count()
