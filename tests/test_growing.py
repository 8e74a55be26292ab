"""A growing collection against one made at once, by plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellspark.operators import labels, numbering
from cellspark.plans.growing import GrowingCollection
from cellspark.sources.catalog import with_global_index
from cellspark.streaming import ingest

SCHEMA = "artifact string, cell long, kind string, stage string"


def made(n, artifacts, seed, hot=0.0):
    r = random.Random(seed)
    return [(r.choice(artifacts), seed * 10_000 + i, "hot" if r.random() < hot else r.choice(["x", "y", None, "z%d" % seed]), r.choice(["p", "q__r"])) for i in range(n)]


def text(v):
    return "unknown" if v is None else v


def plain(batches, split):
    """Global index, and of training cells the class's code, place and offset, from all cells in order; ``split`` by cell."""
    known, order = {}, []
    for batch in batches:
        for name in sorted({b[0] for b in batch} - set(known)):
            known[name] = len(known)
        order += sorted(batch, key=lambda b: (known[b[0]], b[1]))
    place = {b[1]: i for i, b in enumerate(order)}
    rows = [((text(b[2]), text(b[3])), i) for i, b in enumerate(order) if split[b[1]] == "train"]
    sizes, index = Counter(c for c, _ in rows), []
    codes = {c: i for i, c in enumerate(sorted(sizes))}
    offset = {c: sum(sizes[d] for d in sizes if d < c) for c in sizes}
    seen = Counter()
    for c, i in rows:
        index.append((codes[c], i, seen[c], offset[c]))
        seen[c] += 1
    return place, sorted(index)


def state(found):
    cells = found.cells().collect()
    return {r.cell: r.global_idx for r in cells}, sorted(tuple(r) for r in found.class_index().collect()), {r.cell: r.split for r in cells}


def test_batches_equal_one_built_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cellspark.plans.growing.ranges", lambda df, index: numbering.ranges(df, index, 16))
    batches = [made(120, ["b", "d"], 1), made(150, ["a", "b", "c"], 2, hot=0.6), [], made(40, ["e"], 3)]
    at = GrowingCollection(spark, f"{tmp_path}/g", ["kind", "stage"], test=0.2)
    for i, batch in enumerate(batches):
        assert at.append(spark.createDataFrame(batch, SCHEMA), i)
        place, index, split = state(at)
        assert (place, index) == plain(batches[: i + 1], split)
    assert {r.artifact: (r.storage_idx, r.n) for r in at.artifacts().collect()} == {name: (i, sum(b[0] == name for x in batches for b in x)) for i, name in enumerate("bdace")}
    for r in at.cells().groupBy("artifact").agg(F.sort_array(F.collect_list("obs_idx")).alias("o"), F.collect_set("split").alias("s")).collect():
        assert r.o == list(range(len(r.o))) and ("test" not in r.s or r.s == ["test"])
    whole = spark.createDataFrame([b for x in batches for b in x], SCHEMA)
    for label in ("kind", "stage"):
        assert sorted(map(tuple, at.encoder(label).collect())) == sorted(map(tuple, labels.encoder(whole, label).collect()))
    assert {r.value: r.code for r in at.encoder("kind", stable=True).collect()} == {"unknown": -1, "x": 0, "y": 1, "z1": 2, "hot": 3, "z2": 4, "z3": 5}


def test_artifacts_in_order_equal_the_index_over_all(spark, tmp_path):
    batches = [made(60, ["a", "b"], 1), made(60, ["c", "d"], 2)]
    at = GrowingCollection(spark, f"{tmp_path}/g", ["kind"], validation=0.0)
    for i, batch in enumerate(batches):
        at.append(spark.createDataFrame(batch, SCHEMA), i)
    whole = with_global_index(spark.createDataFrame(batches[0] + batches[1], SCHEMA))
    columns = ["cell", "storage_idx", "obs_idx", "global_idx"]
    assert sorted(map(tuple, at.cells().select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    index = labels.class_index(labels.combined_codes(whole.withColumn("kind", labels.as_text("kind")), ["kind"], "label"), "label", "global_idx")
    columns = ["label", "global_idx", "pos", "offset"]
    assert sorted(map(tuple, at.class_index().select(*columns).collect())) == sorted(map(tuple, index.select(*columns).collect()))


def test_a_batch_tried_again_counts_once(spark, tmp_path, monkeypatch):
    first, second = spark.createDataFrame(made(50, ["a"], 1), SCHEMA), spark.createDataFrame(made(50, ["b"], 2), SCHEMA)
    at = GrowingCollection(spark, f"{tmp_path}/g", ["kind"])
    at.append(first, 0)
    before = state(at)
    # The driver stops before the commit: readers see nothing of the batch, and a new driver writes it over.
    with monkeypatch.context() as m:
        m.setattr(GrowingCollection, "_add_values", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            at.append(second, 1)
    assert state(at) == before
    again = GrowingCollection(spark, f"{tmp_path}/g", ["kind"])
    assert again.append(second, 1)
    after = state(again)
    assert len(after[0]) == 100 and {k: v for k, v in after[0].items() if k in before[0]} == before[0]
    assert not again.append(second, 1) and not again.append(first, 0) and state(again) == after
    with pytest.raises(ValueError, match="batch 1 is not after"):
        again.append(first, 1)
    with pytest.raises(ValueError, match="other options"):
        GrowingCollection(spark, f"{tmp_path}/g", ["stage"]).append(second, 2)


def test_odd_batches(spark, tmp_path):
    at = GrowingCollection(spark, f"{tmp_path}/g", ["kind"])
    with pytest.raises(ValueError, match="no batch"):
        at.cells()
    with pytest.raises(ValueError, match="have no artifact"):
        at.append(spark.createDataFrame([(None, 1, "x", "p")], SCHEMA), 0)
    with pytest.raises(ValueError, match="added here"):
        at.append(spark.createDataFrame([("a", 1, "x", "p", 3)], SCHEMA + ", global_idx long"), 0)
    at.append(spark.createDataFrame([], SCHEMA), 0)
    assert at.cells().count() == at.class_index().count() == 0
    # Repeated and null cells keep rows of their own; a new column is null in batches without it.
    at.append(spark.createDataFrame([("a", 1, "x", "p"), ("a", 1, "x", "p"), ("a", None, None, None)], SCHEMA), 1)
    at.append(spark.createDataFrame([("a", 2, "x", "p", 7)], SCHEMA + ", more long"), 2)
    rows = at.cells().orderBy("global_idx").collect()
    assert [(r.global_idx, r.obs_idx, r.cell, r.more) for r in rows] == [(0, 0, None, None), (1, 1, 1, None), (2, 2, 1, None), (3, 3, 2, 7)]


def test_a_stream_of_files_is_followed(spark, tmp_path):
    source, at = f"{tmp_path}/in", GrowingCollection(spark, f"{tmp_path}/g", ["kind", "stage"], validation=0.1)
    batches = [made(40, ["a", "b"], 1), made(40, ["b", "c"], 2)]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = at.follow(ingest.read_new(spark, source, SCHEMA, 1), f"{tmp_path}/c")
        query.awaitTermination()
        assert query.exception() is None
    place, index, split = state(at)
    assert (place, index) == plain(batches, split)
    drawn = at.draws(500)
    assert drawn.count() == 500
    assert {r.global_idx for r in drawn.collect()} <= {place[c] for c, s in split.items() if s == "train"}
