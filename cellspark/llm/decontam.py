"""Benchmark decontamination with suffix arrays of the training text.

Each shard of training documents gets a suffix array over its words; every suffix of the test items is
searched in it by bisection. Matches are extended to the longest, located, and the documents that hold
any are removed. Matches of one item that overlap in a text are merged as they are found, so texts and items that
repeat themselves need no more memory than others.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces, quoted
from .common import materialise

WINDOW = 10
#: Text bytes of a shard, and of the test items that are broadcast at once; more items go block by block.
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z and turns what belongs to no word into spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Pairs of a test suffix and a place in the shard that are held at once.
PAIRS = 1 << 20

MATCH = T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("item_word", "doc_word", "n_words", "span_word", "span_words"))])


def words(text: str) -> list[bytes]:
    """The words of a text: runs of 0-9, a-z (from A-Z too) and non-ASCII characters."""
    return text.encode().translate(WORD_BYTES).split()


@dataclass
class TestSuffixes:
    """The suffixes of test items that begin a window, as numbers of a vocabulary from 1 up.

    ``ids`` holds all items' words with a 0 after each item; suffix j begins at ``starts[j]``, lies in
    item ``items[j]`` at word ``offsets[j]`` and has a window of ``widths[j]`` words.
    """

    vocabulary: dict[bytes, int]
    names: list[str]
    ids: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    widths: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> TestSuffixes:
        vocabulary: dict[bytes, int] = {}
        ids, starts, owner, offsets, widths, names = [], [], [], [], [], []
        for name, text in items:
            own = words(text)
            width = min(window, len(own))
            for k in range(len(own) - width + 1 if own else 0):
                starts.append(len(ids) + k)
                owner.append(len(names))
                offsets.append(k)
                widths.append(width)
            ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in own] + [0]
            names.append(name)
        whole = lambda x: np.array(x, np.int64)
        return cls(vocabulary, names, np.array([*ids, 0], np.int32), whole(starts), whole(owner), whole(offsets), whole(widths))


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``ids`` there, compared over ``depth`` words at least.

    Ranks are doubled: those of 2 k words come from two of k words. ``ids`` ends with zeros.
    """
    rank, k = ids.astype(np.int64), 1
    while k < depth:
        second = np.zeros_like(rank)
        second[:-k] = rank[k:]
        _, rank = np.unique(rank * (int(second.max(initial=0)) + 1) + second, return_inverse=True)
        k *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _bisect(ids: np.ndarray, order: np.ndarray, test: TestSuffixes, after: bool) -> np.ndarray:
    """For each test suffix, the place in ``order`` before (after) all whose first words equal its window."""
    lo, hi = np.zeros(len(test.starts), np.int64), np.full(len(test.starts), len(order), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        at, of, width = order[mid], test.starts[open_], test.widths[open_]
        sign = np.zeros(len(open_), np.int64)
        for k in range(int(width.max())):
            same = np.flatnonzero((sign == 0) & (k < width))
            if not same.size:
                break
            a, b = ids[np.minimum(at[same] + k, len(ids) - 1)], test.ids[of[same] + k]
            sign[same] = np.sign(a.astype(np.int64) - b)
        right = sign <= 0 if after else sign < 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
    return lo


def _left_ends(short: np.ndarray, order: np.ndarray, test: TestSuffixes, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a test suffix and a place that begin a longest match, some at a time.

    A pair with the same word before it on both sides is part of a longer match. In the order of the suffixes,
    places with the same word before them form runs; a run is passed over whole, so no such pair is listed.
    """
    before = np.where(order > 0, short[np.maximum(order, 1) - 1], 0)
    runs = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    ends = np.append(runs[1:], len(order))
    own = np.where(test.offsets > 0, test.ids[np.maximum(test.starts, 1) - 1], 0)
    some = np.flatnonzero(lo < hi)
    first, last = np.searchsorted(runs, lo[some], side="right") - 1, np.searchsorted(runs, hi[some], side="left")
    for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(last - first) // PAIRS)) + 1):
        n = (last - first)[part]
        which = np.repeat(some[part], n)
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[part], n)
        left = np.flatnonzero((own[which] == 0) | (before[runs[run]] != own[which]))
        which, start, end = which[left], np.maximum(lo[which[left]], runs[run[left]]), np.minimum(hi[which[left]], ends[run[left]])
        for few in np.split(np.arange(len(which)), np.flatnonzero(np.diff(np.cumsum(end - start) // PAIRS)) + 1):
            n = (end - start)[few]
            yield np.repeat(which[few], n), order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[few], n)]


def merged(rows: np.ndarray) -> np.ndarray:
    """Rows (group, start, end, words, place, offset) with those of a group that overlap made one.

    Of the matches in it (words, place in the text, place in the item) the longest stays, then the first.
    """
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 5], rows[:, 4], -rows[:, 3], rows[:, 1], rows[:, 0]))]
    group, start, end = rows[:, 0], rows[:, 1], rows[:, 2]
    # Ends so far within a group: groups are set apart by more than any end.
    _, number = np.unique(group, return_inverse=True)
    apart = number * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart)
    heads = np.flatnonzero(np.concatenate([[True], (start + apart)[1:] >= reach[:-1]]))
    span = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(rows))))
    best = np.lexsort((rows[:, 5], rows[:, 4], -rows[:, 3], span))[heads]
    return np.column_stack([group[heads], start[heads], np.maximum.reduceat(end, heads), rows[best, 3:]])


def shard_matches(texts: list[str], test: TestSuffixes) -> tuple[list[int], dict[int, list[tuple[str, int, int, int, int, int]]]]:
    """Word counts of the texts, and by text its matches as MATCH has them."""
    counts, parts = [], []
    for text in texts:
        own = words(text)
        counts.append(len(own))
        parts.append(np.fromiter(map(test.vocabulary.get, own, repeat(0)), np.int32, len(own)))
        parts.append(np.zeros(1, np.int32))
    found: dict[int, list[tuple[str, int, int, int, int, int]]] = defaultdict(list)
    if not len(test.starts) or not texts:
        return counts, found
    ids = np.concatenate([*parts, np.zeros(1, np.int32)])
    # Only a run of known words as long as the shortest window can begin a match.
    zeros = np.flatnonzero(ids == 0)
    run = zeros[np.searchsorted(zeros, np.arange(len(ids)))] - np.arange(len(ids))
    starts = np.flatnonzero(run >= int(test.widths.min()))
    if not starts.size:
        return counts, found
    # The array need hold these runs alone, each to its end.
    held = np.zeros(len(ids) + 1, np.int32)
    np.add.at(held, starts, 1)
    np.add.at(held, starts + run[starts] + 1, -1)
    used = np.flatnonzero(np.cumsum(held[:-1]) > 0)
    place = np.cumsum(np.cumsum(held[:-1]) > 0) - 1
    short = np.concatenate([ids[used], np.zeros(1, np.int32)])
    order = suffix_array(short, place[starts], int(test.widths.max()))
    lo, hi = _bisect(short, order, test, False), _bisect(short, order, test, True)
    first = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    spans = np.zeros((0, 6), np.int64)
    for which, at in _left_ends(short, order, test, lo, hi):
        length = test.widths[which].copy()
        grows = np.arange(len(which))
        while grows.size:
            a = short[np.minimum(at[grows] + length[grows], len(short) - 1)]
            b = test.ids[test.starts[which[grows]] + length[grows]]
            grows = grows[(a == b) & (a > 0)]
            length[grows] += 1
        p = used[at]
        doc = np.searchsorted(first, p, side="right") - 1
        group = doc * len(test.names) + test.items[which]
        spans = merged(np.concatenate([spans, np.column_stack([group, p, p + length, length, p, test.offsets[which]])]))
    for group, start, end, n, p, offset in spans.tolist():
        doc, item = divmod(group, len(test.names))
        found[doc].append((test.names[item], offset, p - int(first[doc]), n, start - int(first[doc]), end - start))
    return counts, found


def _blocks(benchmark: DataFrame, item_key: str, item_text: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The test items in blocks of bounded size, fetched one block after the other."""
    items = benchmark.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("x")).distinct()
    size = items.agg(F.sum(F.octet_length("x") + 32)).first()[0] or 0
    n = -(-size // limit) or 1
    if n > 1:
        items = materialise(items.withColumn("part", F.pmod(F.xxhash64("i", "x"), F.lit(n))), "items")
    for b in range(n):
        yield sorted((r.i, r.x) for r in (items.where(F.col("part") == b) if n > 1 else items).toLocalIterator())


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``keep`` of every document with ``doc_words`` and ``matches``.

    A match is a longest run of words that an item and the text share, of at least ``window`` words, or
    the whole item if it has fewer (but not none). Matches of one item that overlap in the text are one row: the
    item's id; of the longest of them (then the first) the first word in the item and in the text, and
    its words; and the span of words that all of them cover. Null texts have no words, items without words match nothing. Items of
    equal id count as one in what is derived; a null id counts as the empty string. Repeated documents
    are searched each by itself; an empty table on either side gives no matches. Kept columns may have any names. Test items are
    broadcast in blocks of ``block_bytes``; each block is one more pass over the rows of the same tasks, without a shuffle.
    """
    sc = docs.sparkSession.sparkContext
    out = [docs.schema[c] for c in keep]
    named = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(out)] + [T.StructField("__text", T.StringType()), T.StructField("doc_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))])
    df = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)), F.col(quoted(text)).alias("__text"), F.lit(0).cast("long").alias("doc_words"), F.array().cast(T.ArrayType(MATCH)).alias("matches"))
    for block in _blocks(benchmark, item_key, item_text, block_bytes):
        shared = sc.broadcast(TestSuffixes.of(block, window))

        def work(batches, shared=shared):
            for batch in pieces(batches, "__text", SHARD_BYTES):
                counts, found = shard_matches([x or "" for x in batch.column("__text").to_pylist()], shared.value)
                had = batch.column("matches")
                if found or any(had.value_lengths().to_pylist()):
                    names = [f.name for f in MATCH.fields]
                    had = pa.array([(old or []) + [dict(zip(names, x, strict=True)) for x in found.get(i, [])] for i, old in enumerate(had.to_pylist())], had.type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(counts, pa.int64()), had], names=batch.schema.names)

        df = df.mapInArrow(work, named)
    return df.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "doc_words", "matches")


def report(matched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: words, words inside a match, items with matches, digest of their ids, the verdict."""
    zero = F.lit(0).cast("long")
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["span_word"].alias("a"), (m["span_word"] + m["span_words"]).alias("b"))))
    # In order of their starts, each span adds what lies beyond the ends before it.
    hit = F.aggregate(
        spans,
        F.struct(zero.alias("to"), zero.alias("n")),
        lambda x, s: F.struct(F.greatest(x["to"], s["b"]).alias("to"), (x["n"] + F.greatest(zero, s["b"] - F.greatest(x["to"], s["a"]))).alias("n")),
    )
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return matched.select(
        key,
        F.col("doc_words").alias("n_words"),
        hit["n"].alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents, with all their columns, that share no window with any test item."""
    whole = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    return find_matches(whole, benchmark, ["doc"]).where(F.size("matches") == 0).select("doc.*")
