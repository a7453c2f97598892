"""The corpus pipeline, stage by stage against brute force."""

import hashlib
from collections import Counter

from harness import DATA
from tokenizers import Tokenizer

import corpus_pipeline
from driftloom.llm import queries
from driftloom.llm.common import documents

SF = f"{DATA}/sf0.01"


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False))


def test_stages(spark, tmp_path):
    docs = documents(spark, SF)
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        held[name] = before, docs
        assert k == 4 or docs.columns == documents(spark, SF).columns

    before, after = held["quality rules"]
    verdict = {r["doc_id"]: r["kept"] for r in queries.op10_quality_rules(spark, SF).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, kept in verdict.items() if kept}

    before, after = held["exact dedup"]
    best = {}
    for r in before.collect():
        best[r["text"]] = max(r["doc_id"], best.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(best.values())

    before, after = held["simhash near-dedup"]
    sets = {}
    for r in before.collect():
        sets.setdefault(shingles(r["text"]), []).append(r["doc_id"])
    kinds = list(sets)
    part = list(range(len(kinds)))

    def root(k):
        while part[k] != k:
            part[k] = k = part[part[k]]
        return k

    for i, a in enumerate(kinds):  # every two different sets, whatever they share
        for j in range(i):
            b = kinds[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                part[root(i)] = root(j)
    groups = {}
    for k, kind in enumerate(kinds):
        groups.setdefault(root(k), []).extend(sets[kind])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(map(min, groups.values()))
    assert max(map(len, groups.values())) > 1

    before, after = held["mixing"]
    size = {r["doc_id"]: (r["source"], len((r["text"] or "").encode().split())) for r in before.collect()}
    sources = sorted({s for s, _ in size.values()}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for x, n in size.values() if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    open_, target, left = set(sources), {}, 1.5 * sum(own.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * own[s]}
        for s in full or open_:
            target[s] = 2 * own[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    copies = Counter(r["doc_id"] for r in after.collect())
    for i, (s, _) in size.items():
        rate = target[s] / own[s] if own[s] else 0
        coin = int(hashlib.sha256(str(i).encode()).hexdigest()[:8], 16) / 2**32
        assert copies[i] == int(rate) + (coin < rate - int(rate)), i
    assert set(copies) <= set(size)

    before, after = held["bpe encoding"]
    lib = Tokenizer.from_file(queries.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert r["ids"] == lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)
