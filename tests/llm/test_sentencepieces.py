"""SentencePiece encoding against the library, on whole tables and on odd texts."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cellspark.llm import queries, sentencepieces

SF = "/root/testdata/sf0.001"
MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return sentencepieces.Encoder(sentencepieces.model(open(MODEL, "rb").read()))


def test_op13_matches_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def samples(n):
    rng, alphabet = random.Random(5), " " * 6 + "abcdeéè中文的是\n\t.,!0123▁<>/sx  　\U0001f600�\x00\x7f́क्षก"
    kinds = [list(alphabet), list("abcdefghijklmnopqrstuvwxyz "), ["a", "aa", " ", "  ", "the", "of", "=", "--", "\n", "<s>", "<0x0A>"]]
    return ["".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(0, 50))) for i in range(n)]


def test_odd_strings(library, own):
    texts = samples(9000)
    got = own.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert own.model.decode(got) == library.decode([x.tolist() for x in got])
    # Again, from the kept words.
    assert all((a == b).all() for a, b in zip(own.encode(texts[::-1])[::-1], got, strict=True))


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 9_000, "ab" * 9_000 + " x", "中文" * 20_000, "".join(random.Random(3).choices("abcdefghij", k=60_000)), "word tail " * 50_000])
def test_long_texts(library, own, text):
    assert own.encode([text, "one", text])[2].tolist() == library.encode(text)


def test_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE_WORDS", 20)
    monkeypatch.setattr(sentencepieces, "CACHE_CHARS", 3)
    own, texts = sentencepieces.Encoder(sentencepieces.model(open(MODEL, "rb").read())), samples(600)
    for i in range(0, 600, 50):
        assert [x.tolist() for x in own.encode(texts[i : i + 50])] == library.encode(texts[i : i + 50])
    assert all(len(w) <= 3 for w in own.code) and len(own.start) == len(own.code)


def test_decoding_any_ids(library, own):
    rng = random.Random(7)
    lists = [[rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(260) for _ in range(rng.randint(0, 9))] for _ in range(5000)]
    assert own.model.decode([np.array(x, np.int32) for x in lists]) == library.decode(lists)
    with pytest.raises(ValueError, match="not in the model"):
        own.model.decode([np.array([32000])])


def test_rows(spark, library):
    """Nulls, empty and repeated rows, an empty table, columns of the new names and with odd characters."""
    at = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x y"), (3, "x y")], "doc_id long, `te.xt` string").withColumns({"ids": F.lit(1), "decoded": F.lit(2), "text": F.lit("no"), "c0": F.lit(3)})
    got = sentencepieces.encode_texts(at, MODEL, "te.xt", decode=True)
    assert sorted((r.doc_id or 0, r["te.xt"] or "", r.decoded, tuple(r.ids), r.c0) for r in got.collect()) == sorted((k or 0, t or "", t or "", tuple(library.encode(t or "")), 3) for k, t in [(1, None), (2, ""), (None, "a b"), (3, "x y"), (3, "x y")])
    assert {r.decoded for r in sentencepieces.decode_ids(got, MODEL).collect()} == {"", "a b", "x y"}
    assert sentencepieces.encode_texts(at.limit(0), MODEL, "te.xt").collect() == []


def test_other_models_are_refused():
    def field(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    with pytest.raises((ValueError, RuntimeError)):
        sentencepieces.Model(field(1, field(1, b"a")) + field(2, bytes([3 << 3, 1])))
