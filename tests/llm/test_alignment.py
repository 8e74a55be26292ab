"""Alignment of tokenizers against a plain version over the libraries' own tokens."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellspark.llm import alignment, queries
from cellspark.llm.common import Scratch

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    """Bytes by the characters of byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain(libraries, texts):
    """Rows for texts in order, by loops over whole texts."""
    a, b = libraries
    table, made, held = byte_of(), [], collections.Counter()
    for text in texts:
        made.append(None)
        if not text:
            continue
        ea = a.encode(" " + text, add_special_tokens=False)
        xs = [(i, bytes(table[c] for c in t)) for i, t in zip(ea.ids, ea.tokens)]
        ys = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            ys.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        if b"".join(x for _, x in xs) != raw or b"".join(y for _, y in ys) != raw:
            continue
        spans = []
        for side in (xs, ys):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, j = [], 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [["", ""] for _ in ends]
        for side, own in enumerate(spans):
            g = 0
            for i, _, e in own:
                while e > ends[g]:
                    g += 1
                groups[g][side] += ("," if groups[g][side] else "") + str(i)
        made[-1] = len(xs), len(ys), len(ends), links, ";".join("|".join(g) for g in groups)
        held.update(set(links))
    best = collections.Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(0,) * 6 + ("",) if m is None else (*m[:3], len(m[3]), sum(held[x] == best[x[0]] for x in m[3]), sum(held[x] for x in m[3]), m[4]) for m in made]


def test_op12_matches_plain_version(spark, libraries):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, plain(libraries, docs.values()), strict=True))
    got = queries.op12_token_alignment(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        *counts, groups = want[r.doc_id]
        assert tuple(r[c] for c in COLUMNS) == tuple(counts)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def odd_texts(n):
    rng = random.Random(11)
    kinds = [list(" " * 5 + "abcé中文\n\t\r 　.'st\x1c\x85\x00\U0001f600"), ["the", " ", "  ", "\n", " \n ", "of", "it's", " don't", "12", "345", "<|endoftext|>", "<s>", "<0x0A>", "==", "▁", "Ġ"], list("abcdefghijklmnop ")]
    return ["".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(0, 40))) for i in range(n)]


def test_odd_texts_and_rows(spark, libraries):
    """White space of all kinds, marks and special strings, nulls, repeated rows, long texts, columns of new names."""
    texts = [*odd_texts(1500), None, "", " ", "\n ", "a", "a", "x y" * 30_000, "中文" * 10_000, "\n \n" * 5000, " " * 7000]
    at = spark.createDataFrame(list(enumerate(texts)), "doc_id long, `te.xt` string").withColumns({"n_a": F.lit(1), "key": F.lit(2), "groups": F.lit("x"), "text": F.lit("y"), "n": F.lit(3)})
    want = dict(enumerate(plain(libraries, texts)))
    got = alignment.align(at.repartition(3), A, B, "te.xt").collect()
    assert {(r.doc_id, *(r[c] for c in COLUMNS), r.groups) for r in got} == {(k, *v) for k, v in want.items()}
    assert got[0].key == 2 and got[0].n == 3 and got[0].text == "y"
    assert alignment.align(at.limit(0), A, B, "te.xt").collect() == []


def test_little_kept(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_WORDS", 30)
    monkeypatch.setattr(alignment, "CACHE_CHARS", 4)
    own = alignment.Aligner(open(A).read(), open(B, "rb").read())
    texts = odd_texts(400)
    want = plain(libraries, texts)
    for i in range(0, len(texts), 40):
        sides = own.encode(texts[i : i + 40])
        ids = [np.concatenate(x) for x in sides]
        groups = own.written(ids, [np.array(list(map(len, x))) for x in sides], own.ends(ids))
        assert [(len(a), len(b), g) for a, b, g in zip(*sides, groups, strict=True)] == [(*row[:2], row[6]) for row in want[i : i + 40]]
        assert own.facts.shape[1] == len(own.code) and all(len(w) <= 4 for w in own.code)


def test_pair_counts_are_sorted_and_summed(spark, libraries):
    at = spark.createDataFrame([(i, f"one two {i % 7}") for i in range(300)], "doc_id long, text string").repartition(5)
    rows = alignment.pair_counts(alignment.encoded(at, A, B), Scratch(spark), A, B).collect()
    assert len({r.key for r in rows}) == len(rows) and max(r.n for r in rows) == 300 and sum(r.n == 43 or r.n == 42 for r in rows) >= 7


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        alignment.Aligner(open(P.path("word_bpe_49k.json")).read(), open(B, "rb").read())
