"""Cells in buckets, stretches of an index with gaps, ontologies searched from terms, genes looked up within rows."""

import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cellspark.operators import ontology
from cellspark.operators.numbering import numbered, ranges, running_sums
from cellspark.plans.collate import CollateOptions, Vocabulary, collate, keep_genes
from cellspark.plans.datamodule import CellDataset, DataModule, LoaderOptions
from cellspark.sources.store import write_store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, "o", rng.choice("xyz"), [(g, float(rng.randint(1, 9))) for g in sorted(rng.sample(range(8), 3))]) for i in range(200)]
    cells = spark.createDataFrame(rows, "cell long, artifact int, organism string, kind string, expr array<struct<gene:int,value:double>>")
    return cells, spark.range(8).selectExpr("CAST(id AS INT) AS gene", "'o' AS organism", "CAST(id AS INT) AS pos")


def module_of(dataset):
    return DataModule(dataset, ["kind"], LoaderOptions(n_samples=300, validation=0.2, seed=1), CollateOptions(how="most expr", max_len=2))


def test_epochs_leave_stored_cells_in_place(spark, parts):
    plain, stored = (CellDataset(*parts, predict=["kind"]) for _ in range(2))
    stored.store(buckets=5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        epoch = module_of(stored)
        epoch.setup()
        draws = spark.createDataFrame(epoch.draws(1).collect(), "draw_id long, global_idx long")
        joined = draws.join(stored.encoded(), "global_idx")
        text = plan(joined)
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "Bucketed: true" in text
        # The side of the cells, from the last sort down, has no exchange.
        assert "Exchange" not in text[text.rindex("Sort [") :]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    whole = module_of(plain)
    whole.setup()
    key = lambda r: (r.draw_id, r.cell, tuple(r.x), tuple(r.genes), tuple(r["class"]))
    assert sorted(map(key, epoch.train(1).collect())) == sorted(map(key, whole.train(1).collect()))


def test_lookup_reads_one_bucket(spark, parts):
    plain, stored = (CellDataset(*parts, predict=["kind"]) for _ in range(2))
    stored.store(buckets=5)
    want = plain.row(77).select("cell", "expr").collect()
    found = stored.row(77).select("cell", "expr", F.input_file_name().alias("f")).collect()
    files = {r.f for r in stored.cells.select(F.input_file_name().alias("f")).collect()}
    assert [(r.cell, r.expr) for r in found] == [(r.cell, r.expr) for r in want] and len(files) == 5
    for other in files - {found[0].f}:
        Path(other.removeprefix("file://")).write_bytes(b"not to be read")
    assert stored.row(77).select("cell", "expr").collect() == want


def test_tables_of_cells(spark, parts, tmp_path):
    at = parts[0].withColumn("global_idx", F.col("cell"))
    assert write_store(at, "held_once", str(tmp_path / "a")).count() == 200
    with pytest.raises(AnalysisException):
        write_store(at, "held_once", str(tmp_path / "b"))
    assert spark.table("held_once").count() == 200
    assert write_store(at.limit(0)).count() == 0
    with pytest.raises(ValueError):
        write_store(parts[0])


def test_stretches_of_an_index_with_gaps(spark):
    rng = random.Random(4)
    ids = [*rng.sample(range(10**6), 900), 2**62, -(2**60), *(10**12 + i for i in range(100))]
    at = spark.createDataFrame([(i, rng.randint(1, 9)) for i in ids], "id long, w long")
    part = ranges(at, "id", rows=50)
    sizes = [r["count"] for r in at.groupBy(part.alias("p")).count().collect()]
    assert max(sizes) <= 60 and len(sizes) >= 20
    order = {i: n for n, i in enumerate(sorted(ids))}
    assert {r.id: r.pos for r in numbered(at.withColumn("k", F.lit(1)), ["k"], part, ["id"]).collect()} == order
    sums = {r.id: r.hi for r in running_sums(at.withColumn("k", F.lit(1)), ["k"], "w", part, ["id"]).collect()}
    weight, total = {r.id: r.w for r in at.collect()}, 0
    for i in sorted(ids):
        total += weight[i]
        assert sums[i] == total


def test_stretches_of_ties_nulls_and_nan(spark):
    values = [1.0] * 300 + [None] * 5 + [math.nan] * 5 + [-math.inf, math.inf] + [float(i) for i in range(100)]
    at = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, v double")
    got = {r.n: r.p for r in at.select("n", ranges(at, "v", rows=20).alias("p")).collect()}
    assert None not in got.values() and len({got[i] for i in range(300)}) == 1
    assert {got[i] for i in range(300, 305)} == {0} and {got[i] for i in range(305, 310)} == {max(got.values())}
    ordered = sorted((v, got[i]) for i, v in enumerate(values) if v is not None and not math.isnan(v))
    assert [p for _, p in ordered] == sorted(p for _, p in ordered)
    assert {r.p for r in at.limit(0).select(ranges(at.limit(0), "v").alias("p")).collect()} == set()


def test_terms_reach_what_the_closure_holds(spark):
    rng = random.Random(7)
    pairs = [(f"t{a}", f"t{rng.randint(0, a - 1)}") for a in range(1, 60) for _ in range(2)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "t0")]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    every = {(r.child, r.ancestor) for r in ontology.closure(edges).collect()}
    terms = spark.createDataFrame([("t50",), ("c1",), ("t0",), ("none",), (None,), ("c1",)], "term string")
    up = {(r.term, r.reached) for r in ontology.reached(edges, terms).collect()}
    down = {(r.term, r.reached) for r in ontology.reached(edges, terms, up=False).collect()}
    asked = {"t50", "c1", "t0", "none"}
    assert up == {(c, a) for c, a in every if c in asked} and ("c1", "c1") in up
    assert down == {(a, c) for c, a in every if a in asked}
    assert {r.ancestor for r in ontology.ancestors(edges, "t50").collect()} == {a for c, a in every if c == "t50"}
    assert ontology.descendants(edges.limit(0), "t0").count() == 0


def test_genes_of_several_organisms(spark):
    known = Vocabulary({"a": pa.array(["g1", "g2", "g1", "g3"]), "b": pa.array(["g3", "g1"])})
    flat, row = pa.array(["g1", "g3", None, "g3", "zz", "g2", "g1"]), np.array([0, 0, 0, 1, 1, 2, 3])
    got = known.ranks(flat, row, pa.array(["a", "b", "c", None]))
    assert got.tolist() == [0, 3, -1, 0, -1, -1, -1]
    index = known.indices["a", pa.string()]
    assert known.ranks(flat, row, pa.array(["a"] * 4)).tolist() == [0, 3, -1, 3, -1, 1, 0] and known.indices["a", pa.string()] is index
    assert known.ranks(flat[:0], row[:0], pa.array([], pa.string())).tolist() == []
    cells = spark.createDataFrame([(1, "a", [("x", 2.0), ("y", 1.0)]), (2, "b", [("y", 3.0)]), (3, "a", None), (4, "c", [("x", 1.0)]), (5, None, [("x", 1.0)])], "cell long, organism string, expr array<struct<gene:string,value:double>>")
    genes = spark.createDataFrame([("x", "a", 0), ("y", "b", 1), ("x", "b", 2)], "gene string, organism string, pos int")
    rows = {r.cell: (r.genes, r.x) for r in collate(cells, genes, CollateOptions(how="all")).collect()}
    assert rows == {1: ([0], [2.0]), 2: ([1, 2], [3.0, 0.0]), 3: rows.get(3)}
    kept = {r.cell: r.expr for r in keep_genes(cells, genes.where("gene = 'y'")).collect()}
    assert [x.gene for x in kept[1]] == ["y"] and [x.gene for x in kept[2]] == ["y"] and not kept[3]
