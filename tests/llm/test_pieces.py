"""SentencePiece encoding against the library: ids, spans and decoding, other normalisers, awkward rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from harness import DATA
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2, sentencepiece_pb2

from driftloom.llm import pieces, queries
from driftloom.llm.common import documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "▁", " ", "  ", "\n", "\t", "é", "漢", "字", "　", "ﬁ", "①", "​", "\x00", "1", "23", ".", "ing", " " * 18, "가", "Ａ", "é", "<s>", "<0x41>", "\U0001f600", "a" * 300, "ab" * 90, "�"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["", *("".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(n))]


def library(sp, text):
    found = sentencepiece_pb2.SentencePieceText()
    found.ParseFromString(sp.encode(text, out_type="serialized_proto"))
    return [x.id for x in found.pieces], [(x.begin, x.end) for x in found.pieces]


def own(model, text):
    read, source = model.normalise(text)
    ids = [i for codes, _ in model.codes(model.part.findall(read)) for i in codes]
    return ids, [tuple(x) for x in model.spans(np.array(ids, np.int64), source).tolist()]


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("rule,squeeze,prefix", [(None, False, True), ("nmt_nfkc", True, True), ("nmt_nfkc", False, False), ("identity", True, False)])
def test_ids_spans_and_text_equal_the_library(tmp_path, rule, squeeze, prefix):
    spec = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        spec.ParseFromString(f.read())
    if rule:
        rules = sentencepiece_model_pb2.ModelProto()
        rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        spec.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.add_dummy_prefix = squeeze, prefix
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    for text in random_texts(600):
        ids, spans = library(sp, text)
        assert own(model, text) == (ids, spans), text
        assert model.decode(ids) == sp.decode(ids)
    rng = random.Random(2)
    for _ in range(1_500):
        ids = [rng.choice([0, 1, 2, 3, 13, 132, 153, 227, 229, 259, 264, 428, 28705, rng.randrange(32_000)]) for _ in range(rng.randint(0, 6))]
        assert model.decode(ids) == sp.decode(ids), ids


def test_long_words_merge_alike_through_the_heap():
    model = pieces.load(MODEL)
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("abeinrst▁", k=rng.randint(1, pieces.SHORT)))
        assert model.pieces(word) == model.pieces_of_long(word)


def test_words_merged_together_equal_words_merged_alone():
    model = pieces.load(MODEL)
    rng = random.Random(4)
    words = ["".join(rng.choices(["▁", "▁", "a", "b", "e", "in", "rst", "é", "漢", "\n", "字", "ing", ".", "😀"], k=rng.randint(1, 20))) for _ in range(3_000)]
    for word, (ids, text) in zip(words, model.codes(words), strict=True):
        want = [i for p in model.pieces(word) for i in ([model.id_of[p]] if p in model.id_of else [model.byte_ids[b] for b in p.encode()])]
        assert list(ids) == want and text == " ".join(map(str, want))
    assert model.codes([]) == [] and model.codes(["漢"]) == [((233, 191, 165), "233 191 165")]


def test_models_of_other_kinds_are_errors(tmp_path):
    spec = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        spec.ParseFromString(f.read())
    spec.pieces[500].type = pieces.KINDS["unused"]
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    with pytest.raises(ValueError, match="only BPE"):
        pieces.PieceModel(path)


def test_awkward_rows(spark):
    texts = [None, "", " ", "a", "a", *random_texts(30, 5), " ".join(["word", "x" * 90, "漢字"] * 9_000), "z" * 150_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, None), (None, "  b ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("ids", "Spans", "decoded", "source")})
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    outputs = ("ids", "n_tokens", "ids_sha256", "spans", "spans_sha256", "decoded", "decoded_sha256")
    got = pieces.encode(df, MODEL, outputs=outputs)
    assert got.columns == ["doc_id", "text", "source", *outputs]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        text = r["text"] or ""
        ids, spans = library(sp, text)
        assert r["ids"] == [*ids, 2] and r["n_tokens"] == len(ids) + 1 and r["source"] == "mine"
        assert [tuple(x) for x in r["spans"]] == [*spans, (len(text.encode()),) * 2]
        assert r["spans_sha256"] == hashlib.sha256(np.array(r["spans"], "<i4").tobytes()).hexdigest()
        assert r["decoded"] == sp.decode(ids) and r["decoded_sha256"] == hashed(r["decoded"]) and r["ids_sha256"] == hashed(" ".join(map(str, r["ids"])))
    assert pieces.encode(df.limit(0), MODEL).count() == 0
    back = pieces.decode(got.select("doc_id", "ids", F.lit(1).alias("Decoded")), MODEL)
    assert sorted(str(r["decoded"]) for r in back.collect()) == sorted(str(r["decoded"]) for r in found)


def test_query_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, f"{DATA}/sf0.01").collect()}
    got = queries.op11_sentencepiece(spark, f"{DATA}/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashed(" ".join(map(str, ids))), hashed(sp.decode(ids)))
