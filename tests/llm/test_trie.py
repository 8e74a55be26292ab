"""The prefix trie against a plain one made of dictionaries."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cellspark.llm import queries, trie

SF = "/root/testdata/sf0.001"
NAMES = [c.split()[0] for c in trie.NODE.split(", ")]


def by_conversation(rows):
    """Turns (role, text) by id; rows are (conv_id, turn, role, text)."""
    out = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            out[c].append(((t is not None, t or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(ts)] for c, ts in out.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(turns):
    members = collections.defaultdict(list)
    for c, own in turns.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children = collections.defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = sum(saved[c] for c in children[path]) + (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
    out = collections.Counter()
    for path, ids in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(ids) if len(turns[c]) == len(path)).encode()).hexdigest()
        out[min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children[path]), leaves[path], saved[path], ends] += 1
    return out


def given(df):
    return collections.Counter(tuple(r[c] for c in NAMES) for r in df.collect())


def test_op11_matches_plain_version(spark):
    turns = by_conversation(tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
    got = given(queries.op11_prefix_trie(spark, SF))
    assert got == plain_trie(plain_rebuilt(turns)) and max(x[3] for x in got) == len(turns)


def rows_of(seed, n=400, texts="abcd", longest=6):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["u", "v"]), rng.choice(texts) * rng.randint(1, 2)) for c in rng.sample(range(-50, 3 * n), n) for t in range(rng.randint(0, longest)) for _ in range(1)]


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("texts", ["a", "ab", "abcd"])
def test_any_number_of_ranges(spark, parts, texts):
    """Few different turns make deep shared paths and many equal conversations, which go on over many ranges."""
    rows = rows_of(parts, texts=texts)
    at = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        turns = by_conversation(rows)
        arrays = trie.turn_arrays(at)
        assert given(trie.prefix_trie(arrays)) == plain_trie(turns)
        assert given(trie.prefix_trie(trie.rebuilt(arrays))) == plain_trie(plain_rebuilt(turns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark, monkeypatch):
    """Nulls in every column, repeated rows, ties, conversations that lose all turns, long texts and many turns, further columns."""
    monkeypatch.setattr(trie, "ENDS_CHUNK", 3)
    rows = [(1, 0, "u", "x"), (1, None, None, None), (1, 0, "u", "x"), (1, 0, "a", "x"), (None, 0, "u", "x"), (7, 0, None, ""), (7, 1, "", None), (12, 0, "u", "y" * 200_000)]
    rows += [(c, t, "u", "same") for c in range(100, 160) for t in range(2)] + [(300, t, "u", "t") for t in range(900)] + [(301, t, "u", "t") for t in range(899)]
    at = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"digest": F.lit(1), "key": F.lit(2), "turns": F.lit(3), "node": F.lit(4)})
    turns = by_conversation(rows)
    assert given(trie.prefix_trie(trie.turn_arrays(at))) == plain_trie(turns)
    assert given(trie.prefix_trie(trie.rebuilt(trie.turn_arrays(at)))) == plain_trie(plain_rebuilt(turns))
    assert trie.prefix_trie(trie.turn_arrays(at.limit(0))).collect() == []


def test_last_turns(spark):
    rows = rows_of(4, n=60)
    at = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = by_conversation(rows)
    nodes = trie.prefix_trie(trie.turn_arrays(at))
    for r in trie.with_last_turns(nodes, at).collect():
        assert (r.role, r.text) == (turns[r.conv_id][r.depth - 1] if r.depth else (None, None))
