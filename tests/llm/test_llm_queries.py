"""The queries against their SQL, or against brute force where SQL cannot express them."""

import base64
import collections
import hashlib
import itertools
import os
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from cellspark.llm import licenses, neardup, queries, urls
from cellspark.llm.decontam import words
from cellspark.llm.sql import ORACLE_SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents pages benchmark".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {k: t or "" for k, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}


@pytest.fixture(scope="module")
def bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(records, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("" if r[i] is None else str(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(found.fetchall(), columns)


def test_op1_matches_the_library(spark, texts):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = queries.op1_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def hexed(ids):
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_op6_matches_the_library(spark, texts, bpe):
    got = queries.op6_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = bpe.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hexed(ids))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def feistel(i, size, key):
    """One number's place, by a plain version of the permutation."""
    top, half = 2**64, 1
    while 4**half < size:
        half += 1
    while True:
        left, right = i >> half, i % 2**half
        for r in range(4):
            x = (right + key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % top
            x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD % top
            x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 % top
            left, right = right, left ^ (x ^ x >> 33) % 2**half
        i = left << half | right
        if i < size:
            return i


def test_op2_is_the_permuted_order(spark, texts, bpe):
    n, end = queries.SEQUENCE, queries.END
    expected = {}
    for k, t in texts.items():
        ids = [*bpe.encode_ordinary(t), end]
        for j in range(-(-len(ids) // n)):
            own = ids[j * n : (j + 1) * n]
            expected[k, j] = len(own), hashlib.sha256(np.array(own, "<u2").tobytes()).hexdigest()
    got = {r.slot: r for r in queries.op2_training_order(spark, SF).collect()}
    assert {(r.doc_id, r.part): (r.n_tokens, r.ids_sha256) for r in got.values()} == expected
    size = len(expected)
    assert len(got) == size and set(got) == set(range(size))
    # In the order before the permutation, documents come whole, one after the other.
    order = [(r.doc_id, r.part) for r in (got[feistel(i, size, queries.ORDER_KEY)] for i in range(size))]
    starts = [i for i, (_, part) in enumerate(order) if part == 0]
    assert len({order[i][0] for i in starts}) == len(starts) == len(texts)
    assert all(b == (a[0], a[1] + 1) or b[1] == 0 for a, b in itertools.pairwise(order))


def test_op8_finds_each_notice_once(spark, texts):
    notices = [t for _, t, *_ in licenses.TEMPLATES]
    expected = collections.Counter(k for k, t in texts.items() for n in notices for _ in re.finditer(re.escape(n), t))
    got = collections.Counter(r.doc_id for r in queries.op8_license_scan(spark, SF).collect())
    assert got == expected


def test_op9_rules_and_columns(spark):
    for r in queries.op9_url_filters(spark, SF).collect():
        fits = [(x, v) for x, v in urls.RULES if (r.host == x.split("/")[0] or r.host.endswith("." + x.split("/")[0])) and r.path.startswith("/" + x.split("/", 1)[1])]
        best = max(fits, key=lambda x: len(x[0]), default=(None, r.verdict))
        assert (r.rule, r.verdict) == best and r.verdict in ("allow", "block")


def test_op9_matches_brute_force(spark, duck):
    """Word counts, best splits, token odds and verdicts worked out plainly."""
    import functools
    import math

    import regex

    pages = [(k, u or "", h or "") for k, u, h in duck.execute("SELECT page_id, url, html FROM pages").fetchall()]
    counts = collections.Counter()
    for _, _, html in pages:
        if m := re.search(r"(?is)<title[^>]*>(.*?)</title>", html):
            counts.update(w for w in regex.split(r"[^\p{L}]+", m[1].lower()) if 0 < len(w) <= 63)
    total, letter = counts.total(), math.log(10) + math.log(counts.total()) / 4

    @functools.cache
    def cheapest(name):
        """Cost and words of the best split; of equal ones, that with the longest last word."""
        if not name:
            return 0.0, ()
        options = []
        for i in range(len(name)):
            cost, own = cheapest(name[:i])
            word = name[i:]
            price = -math.log(counts[word] / total) if word in counts else letter * (len(word) + 1)
            options.append((cost + price, i, (*own, word)))
        cost, _, own = min(options)
        return cost, own

    rows = {}
    for k, url, _ in pages:
        head, mark, rest = url.partition("://")
        end = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
        host, tail = ("", "") if not mark else (rest[:end], rest[end:])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = re.split(r"[?#]", tail)[0]
        fits = [(r, v) for r, v in urls.RULES if (f".{host}").endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
        names = host.split(".")
        tokens = [f"t:{names[-1]}"] if names[-1] else []
        for name in names[:-1]:
            for part in re.findall(r"[^\W\d_]+", name):
                tokens += [f"h:{w}" for w in cheapest(part)[1]]
        tokens += ["p:" + "".join("0" if c in "0123456789" else c for c in w) for w in re.findall(r"\w+", path.lower())]
        rows[k] = host, path, max(fits, key=lambda x: len(x[0]), default=None), tokens
    seen = {v: collections.Counter(w for _, _, r, ws in rows.values() if r and r[1] == v for w in ws) for v in ("allow", "block")}
    n = len(seen["allow"] | seen["block"])
    held = collections.Counter(r[1] for _, _, r, _ in rows.values() if r)
    bottom = {v: seen[v].total() + n + 1 for v in seen}
    odds = {w: math.log((seen["allow"][w] + 1) / bottom["allow"]) - math.log((seen["block"][w] + 1) / bottom["block"]) for w in seen["allow"] | seen["block"]}
    got = queries.op9_url_filters(spark, SF).collect()
    assert len(got) == len(rows)
    judged = collections.Counter()
    for r in got:
        host, path, rule, tokens = rows[r.page_id]
        score = math.log(held["allow"] / held["block"]) + sum(odds.get(w, 0) for w in tokens)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        if rule or abs(score) > 1e-9:
            assert r.verdict == (rule[1] if rule else "allow" if score >= 0 else "block")
            judged[r.verdict, rule is None] += 1
    assert judged["allow", True] or judged["block", True]


def test_op9_model_on_held_out_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    costs, letter = urls.word_costs(pages)
    at = urls.tokenised(pages, costs, letter).where("rule IS NOT NULL").selectExpr("*", "rule.verdict AS verdict")
    model = urls.train(at.where("pmod(hash(k), 5) > 0"))
    held = urls.score(at.where("pmod(hash(k), 5) = 0"), model).collect()
    right = sum((r.score >= 0) == (r.verdict == "allow") for r in held)
    assert held and right / len(held) >= 0.8


def classes(texts):
    """Components under exact similarity of at least 0.8."""
    bags = {}
    for k, t in texts.items():
        w = words(t)
        n = min(neardup.SHINGLE, len(w))
        bags[k] = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter({t: 1})
    where, common, parent = collections.defaultdict(list), collections.Counter(), {k: k for k in texts}
    for k, bag in bags.items():
        for x in bag:
            where[x].append(k)
    for x, held in where.items():
        for a, b in itertools.combinations(held, 2):
            common[a, b] += min(bags[a][x], bags[b][x])

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= neardup.THRESHOLD * (bags[a].total() + bags[b].total() - c):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}


def test_op10_matches_brute_force(spark, texts):
    got = queries.op10_minhash_neardup(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_pipeline_matches_brute_force(spark, duck, texts, bpe):
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op7_quality_rules']}) WHERE kept").fetchall()}
    duck.execute("CREATE OR REPLACE TABLE good AS SELECT * FROM documents WHERE doc_id IN (SELECT unnest(?))", [sorted(kept)])
    from cellspark.llm import sql

    after = dict(duck.execute(f"WITH {sql._LINES.format(docs='good')} SELECT doc_id, text FROM deduped").fetchall())
    group = classes(after)
    after = {k: t for k, t in after.items() if group[k] == k}
    duck.execute("CREATE OR REPLACE TABLE few AS SELECT * FROM documents LIMIT 0")
    duck.executemany("INSERT INTO few (doc_id, text) VALUES (?, ?)", list(after.items()))
    dirty = {r[0] for r in duck.execute(f"WITH {sql._LEAKS.format(docs='few')} SELECT DISTINCT doc_id FROM hits").fetchall()}
    expected = {k: (len(bpe.encode_ordinary(t)), hexed(bpe.encode_ordinary(t))) for k, t in after.items() if k not in dirty}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == expected
