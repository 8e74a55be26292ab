"""Near-duplicate classes of documents by weighted five-word shingles.

Equal word sequences are first made one vertex each. DartMinHash signatures of the vertices are cut into
bands. A pair that shares a band and agrees in enough coordinates is a candidate, and a candidate of enough exact
similarity a link. Linked vertices form classes. Leaders of buckets only decide which candidates need not be looked
at, as their ends are in one class already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dart
from .arrow import pieces
from .common import Scratch, small
from .decontam import words

SHINGLE = 5
#: A link takes a similarity of THRESHOLD / 100 or more.
THRESHOLD = 80
#: Coordinates of a signature; bands, and the coordinates of each, drawn by hash. A pair of similarity 0.8
#: shares no band with probability 0.001, one of 0.85 with 0.00003, one of 0.3 shares any with 0.02.
COORDINATES, BANDS, ROWS = 224, 28, 6
#: Coordinates in which a candidate must agree; of similarity 0.8, 2 in 10,000 have fewer.
AGREE = 157
#: Bits kept of a coordinate for this, and coordinates in a long.
BITS, PACK = 7, 7
#: Leaders are compared with their buckets until this many open pairs a band row are left, or so often.
OPEN_PAIRS, LEADER_ROUNDS = 0.02, 4
#: Members of an open bucket that one slice of it holds when all its pairs are compared, and pairs that one task is meant to compare.
SLICE, TASK_PAIRS = 256, 500_000
WORD_CACHE = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()


def shingles(own: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words; of the whole text if it has fewer words, but not none."""
    h = np.fromiter(map(_WORDS.__getitem__, own), np.uint64, len(own))
    size = min(size, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = dart.mix(out * dart.GOLDEN + h[i : i + n])
    return out


def numbered(hashes: np.ndarray) -> np.ndarray:
    """A multiset as a set: the j-th copy of a hash becomes a hash of both."""
    values, counts = np.unique(hashes, return_counts=True)
    at = np.repeat(np.arange(len(values)), counts)
    nth = (np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    return np.where(nth == 0, values[at], dart.mix(values[at] ^ dart.mix(nth * dart.GOLDEN)))


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's coordinates, for every signature."""
    k = signature.shape[1]
    order = np.argsort(dart.mix(np.arange(bands * k, dtype=np.uint64) + np.uint64(1)).reshape(bands, k), axis=1)[:, :rows]
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for i in range(rows):
        out = dart.mix(out * dart.GOLDEN + signature[:, order[:, i]])
    return out.view(np.int64)


def packed(signature: np.ndarray) -> np.ndarray:
    """The low bits of the coordinates, in bytes of longs whose first byte is free."""
    low = (signature & np.uint64((1 << BITS) - 1)).reshape(len(signature), -1, PACK)
    return (low << (np.uint64(8) * np.arange(PACK, dtype=np.uint64))).sum(axis=2).view(np.int64)


def agrees(a: Column, b: Column) -> Column:
    """Whether two packed signatures agree in enough coordinates: bytes that differ carry into their top bit."""
    ones, tops = (sum(x << 8 * i for i in range(PACK)) for x in (0x7F, 0x80))
    differ = [F.bit_count((a[i].bitwiseXOR(b[i]) + F.lit(ones)).bitwiseAND(F.lit(tops))) for i in range(COORDINATES // PACK)]
    return reduce(lambda x, y: x + y, differ) <= COORDINATES - AGREE


def near_sizes(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


SKETCH = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("mini", T.ArrayType(T.LongType()))])


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each document ``k`` (key), ``t`` (text hash), ``h`` (128-bit hash of its words, or of
    the text if it has none), ``n`` (shingles), ``bands`` and ``mini``, the packed signature. The whole text is read once, without a shuffle."""
    narrow = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.col(text).alias("text"))
    schema = T.StructType([*narrow.schema.fields[:2], *SKETCH.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, ns, elements, weights = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = words(text or "")
                ids.append(xxhash.xxh3_128_digest(b" ".join(own) if own else b"\0" + (text or "").encode()))
                e, w = np.unique(shingles(own), return_counts=True)
                ns.append(int(w.sum()))
                elements.append(e)
                weights.append(w)
            some = [i for i, n in enumerate(ns) if n]
            bands: list[list[int] | None] = [None] * len(ns)
            minis: list[list[int] | None] = [None] * len(ns)
            if some:
                signature = dart.signatures(np.concatenate([elements[i] for i in some]), np.concatenate([weights[i] for i in some]).astype(float), np.array([len(elements[i]) for i in some]), COORDINATES)
                for i, band, mini in zip(some, band_hashes(signature).tolist(), packed(signature).tolist(), strict=True):
                    bands[i], minis[i] = band, mini
            made = [pa.array(ids, pa.binary()), pa.array(ns, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(minis, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), *made], names=schema.names)

    return narrow.mapInArrow(work, schema)


def _shingle_sets(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """``v`` and ``s``, the numbered shingles, of the vertices in ``chosen`` (v, k, t), each once."""
    at = docs.select(F.col(key).alias("dk"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("dt"), F.col(text).alias("text"))
    at = at.join(small(chosen), F.col("dk").eqNullSafe(F.col("k")) & (F.col("dt") == F.col("t"))).select("v", "text")
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = [numbered(shingles(words(x or ""))).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(sets, pa.list_(pa.int64()))], names=schema.names)

    return at.mapInArrow(work, schema).dropDuplicates(["v"])


def similar(common: Column, na: str, nb: str) -> Column:
    """Whether two numbered sets of these sizes, with so many elements in common, reach the threshold."""
    return (100 + THRESHOLD) * common >= THRESHOLD * (F.col(na) + F.col(nb))


def _plausible(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """The pairs (a, b), with their sizes, that sizes and signatures do not rule out."""
    at = pairs.join(vertices.toDF("a", "na", "ma"), "a").join(vertices.toDF("b", "nb", "mb"), "b")
    return at.where(near_sizes(F.col("na"), F.col("nb")) & agrees(F.col("ma"), F.col("mb"))).select("a", "b", "na", "nb")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The plausible pairs (a, b, na, nb) that reach the threshold exactly."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.where(similar(F.size(F.array_intersect("sa", "sb")), "na", "nb")).select("a", "b")


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """``v`` and ``c``, the least vertex of its component, for every end of ``links`` (a, b).

    Each round gives a vertex the least label of its neighbours and then its label's label, so that the
    rounds grow with the logarithm of a component's width. Labels are written after every round.
    """
    edges = work.write(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = work.write(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        low = work.write(labels.select("v", "c").join(near, "v").select("v", "c", F.least("c", "m").alias("m")), "low")
        work.drop(labels)
        jump = low.join(low.select(F.col("v").alias("m"), F.col("m").alias("j")), "m")
        labels = work.write(jump.select("v", F.least("m", "j").alias("c"), (F.least("m", "j") != F.col("c")).alias("moved")), "labels")
        work.drop(low)
        if labels.where("moved").isEmpty():
            work.drop(edges)
            return labels.select("v", "c")


def _relabel(old: DataFrame | None, links: DataFrame, work: Scratch) -> DataFrame:
    """Labels after adding ``links`` to what ``old`` has already joined."""
    if old is None:
        return components(links, work)
    at = links
    for end in "ab":
        at = at.join(old.toDF(end, f"c{end}"), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    new = components(at.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b"), work)
    moved = old.join(new.toDF("c", "d"), "c", "left").select("v", F.coalesce("d", "c").alias("c"))
    return work.write(moved.union(new.join(old.select("v"), "v", "left_anti")), "labels")


def _settled(rows: DataFrame, chosen: DataFrame, refs: DataFrame, sets: DataFrame, pairs: int, work: Scratch) -> DataFrame:
    """The links (a, b) between vertices of different classes among ``rows`` (b, v, c), open buckets' members, of which some ``pairs`` are to compare.

    A row carries how its set differs from that of its bucket's first leader (``refs``: b, ref), so that the join settles a
    pair exactly and gives nothing but links. A pair that shares several buckets is settled in the first of them.
    """
    rows = work.write(rows.select("b", "v", "c").join(refs, "b"), "rows")
    at = rows.select("v", "ref").distinct().join(sets, "v").join(sets.toDF("ref", "r"), "ref")
    differences = work.write(at.select("v", "ref", F.size("r").alias("nr"), F.array_except("r", "s").alias("less"), F.array_except("s", "r").alias("more")), "differences")
    at = rows.groupBy("v", "c").agg(F.sort_array(F.collect_list("b")).alias("bs"), F.collect_list(F.struct("b", "ref")).alias("at")).join(chosen, "v")
    at = at.select("v", "c", "n", "mini", "bs", F.explode("at").alias("x")).select("v", "c", "n", "mini", "bs", "x.b", "x.ref")
    rest = work.write(at.join(differences, ["v", "ref"]).select(F.col("b").alias("bucket"), "v", "c", "n", "mini", "bs", "nr", "less", "more"), "rest")
    work.drop(rows, differences)
    x, y = (rest.select("bucket", *(F.col(c).alias(f"{c}{end}") for c in ("v", "c", "n", "mini", "bs", "nr", "less", "more"))) for end in "ab")
    # The rows are few bytes but many pairs. Slices of a bucket, each against the whole bucket, are dealt over as many tasks as the pairs are
    # worth; a given number of partitions is not joined again for being small.
    slices = small(rest.groupBy("bucket").agg(F.ceil(F.count("*") / SLICE).alias("slices")))
    tasks = min(10_000, 1 + pairs // TASK_PAIRS)
    x = x.join(slices, "bucket").withColumn("slice", F.pmod(F.xxhash64("va"), F.col("slices"))).drop("slices").repartition(tasks, "bucket", "slice")
    y = y.drop("nrb").join(slices, "bucket").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices").repartition(tasks, "bucket", "slice")
    common = F.col("nra") - F.size(F.array_union("lessa", "lessb")) + F.size(F.array_intersect("morea", "moreb"))
    both = x.join(y, ["bucket", "slice"]).where(
        (F.col("va") < F.col("vb"))
        & (F.col("ca") != F.col("cb"))
        & near_sizes(F.col("na"), F.col("nb"))
        & agrees(F.col("minia"), F.col("minib"))
        & (F.array_min(F.array_intersect("bsa", "bsb")) == F.col("bucket"))
        & similar(common, "na", "nb")
    )
    links = work.write(both.select(F.col("va").alias("a"), F.col("vb").alias("b")).distinct(), "links")
    work.drop(rest)
    return links


def _classes(docs: DataFrame, key: str, text: str, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """``k``, ``t``, ``h`` of every document, and by ``h`` its ``class_id`` and ``first``, the (none, k, t) that stays."""
    found = work.write(sketches(docs, key, text), "sketches")
    low = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "t")).alias("low")
    vertices = found.groupBy("h").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("mini").alias("mini"), low)
    vertices = work.write(vertices.withColumn("v", F.monotonically_increasing_id()), "vertices")
    names = work.write(vertices.select("v", "h", "low"), "names")
    rows = work.write(vertices.select("v", F.explode("bands").alias("b")), "bands")
    total = rows.count()
    # Most buckets have one member; only vertices of others are carried on.
    crowded = work.write(rows.groupBy("b").agg(F.count("*").alias("m")).where("m > 1"), "crowded")
    held = work.write(rows.join(crowded, "b"), "held")
    work.drop(rows, crowded)
    shared = held.groupBy("v").agg(F.sum("m").alias("p"))
    chosen = work.write(vertices.select("v", "n", "mini", "low").join(shared, "v"), "chosen")
    work.drop(vertices)
    rows = work.write(held.select("b", "v").join(chosen.select("v", "p"), "v").select("b", "v", "p", F.col("v").alias("c")), "rows")
    work.drop(held)
    of, texts = chosen.select("v", "n", "mini"), chosen.select("v", "low.k", "low.t")
    labels = sets = refs = None
    for step in range(LEADER_ROUNDS):
        order = F.struct("p", "v", "c") if step == 0 else F.struct(F.xxhash64("v", "b", F.lit(step)).alias("p"), "v", "c")
        lead = work.write(rows.groupBy("b").agg(F.max(order).alias("x")).select("b", F.col("x.v").alias("lead"), F.col("x.c").alias("lc")), "leads")
        old, rows = rows, work.write(rows.join(lead, "b").where("v != lead"), "members")
        work.drop(old)
        pairs = rows.where("c != lc").select(F.col("lead").alias("a"), F.col("v").alias("b")).distinct()
        pairs = work.write(_plausible(pairs, of), "pairs")
        ends = work.write(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct(), "ends")
        if sets is None:
            sets = work.write(_shingle_sets(docs, work.write(texts.join(ends, "v"), "texts"), key, text), "shingles")
        links = work.write(_links(pairs, sets.join(small(ends), "v", "left_semi")), "links")
        work.drop(pairs, ends)
        if not links.isEmpty():
            labels = _relabel(labels, links, work)
            rows = rows.drop("c").join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
        work.drop(links)
        rows = rows.select("b", "v", "p", "c")
        groups = rows.groupBy("b", "c").agg(F.count("*").alias("m"))
        still = groups.groupBy("b").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q")).where("m * m > q")
        still = work.write(still, "open")
        left = still.agg(F.sum(F.col("m") * F.col("m") - F.col("q")) / 2).first()[0] or 0
        rows = work.write(rows.join(still.select("b"), "b", "left_semi"), "rows")
        if not left:
            break
        if step == 0:
            # What later rounds may compare lies in open buckets, with their first leaders; the texts that are lacking are fetched together.
            refs = work.write(lead.join(still.select("b"), "b", "left_semi").select("b", F.col("lead").alias("ref")), "refs")
            lacking = rows.select("v").union(refs.select("ref")).distinct().join(sets.select("v"), "v", "left_anti")
            sets = sets.union(work.write(_shingle_sets(docs, work.write(texts.join(lacking, "v"), "texts"), key, text), "shingles"))
        work.drop(lead, still)
        if left <= OPEN_PAIRS * total:
            break
    if left:
        links = _settled(rows, of, refs, sets, int(left), work)
        if not links.isEmpty():
            labels = _relabel(labels, links, work)
    joined = names.withColumn("c", F.col("v")) if labels is None else names.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    joined = work.write(joined, "joined")
    least = work.write(joined.groupBy("c").agg(F.min("low").alias("first")), "classes")
    return found.select("k", "t", "h"), joined.join(least, "c").select("h", F.col("first.k").alias("class_id"), "first")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k``, ``t`` (text hash), ``class_id`` and ``stays`` of every document: the least key in its class, and
    whether it is the one that :func:`drop_near_duplicates` keeps.

    A class is a component under links. A link joins two texts of a similarity of 0.8 or more that share one of the bands and
    agree in AGREE coordinates (see COORDINATES and AGREE for what these two miss), at any size of the corpus. The similarity of two texts is the
    weighted Jaccard similarity of their five-word shingles, weighted by how often each occurs; words are
    runs of ASCII letters (in either case), digits and other characters beyond ASCII; a text of one to
    four words is one shingle. Texts without words are linked to equal texts alone; null counts as empty.
    Rows that repeat key and text are one document and get equal rows. A null key is never a class id unless all
    keys of the class are null. Of equal keys, the text of the least hash stays. An empty table gives an empty result.

    A bucket's members are compared with its leader, the member that shares most buckets with others: of many
    copies of a text, each changed elsewhere, this is the text itself. Open buckets (of more than one class)
    go on without it, and with a leader drawn by hash, another in each bucket; when few pairs of different classes are left open, or
    after some rounds, all of these are compared. So each pair that shares a band is within one class or was compared.
    """
    found, classes = _classes(docs, key, text, Scratch(docs.sparkSession))
    own = F.struct(F.col("k").isNull().alias("none"), "k", "t")
    return found.join(classes, "h").select("k", "t", "class_id", own.eqNullSafe(F.col("first")).alias("stays"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document, with all its columns, of each class: that of the least key (null last), then text hash.

    Of rows that repeat the key and text of this document, one stays.
    """
    work = Scratch(docs.sparkSession)
    at = work.write(near_duplicates(docs, key, text), "classes")
    gone = at.where("NOT stays").select("k", "t").distinct()
    again = at.where("stays").groupBy("k", "t").agg(F.count("*").alias("m")).where("m > 1")
    marked = work.write(gone.withColumn("gone", F.lit(True)).union(again.select("k", "t", F.lit(False))), "marked")
    whole = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    whole = whole.join(small(marked), F.col(f"doc.`{key}`").eqNullSafe(F.col("k")) & (F.col("__t") == F.col("t")), "left")
    left = whole.where("gone IS NULL").select("doc.*")
    if marked.where("NOT gone").isEmpty():
        return left
    return left.union(whole.where("NOT gone").groupBy("k", "t").agg(F.first("doc").alias("doc")).select("doc.*"))
