"""Several collections and versions in one catalog, and medians with infinite values."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from cellspark.operators import qc
from cellspark.sources import catalog


def written(spark, path, n):
    catalog.write_collection(spark.range(n).select((F.col("id") % 2).alias("artifact"), F.col("id").alias("cell")), path)
    return path


def test_collections_and_versions_live_together(spark, tmp_path):
    at = f"{tmp_path}/catalog"
    first, second, other = written(spark, f"{tmp_path}/a", 10), written(spark, f"{tmp_path}/b", 6), written(spark, f"{tmp_path}/c", 4)
    catalog.register(spark, first, at, "one")
    catalog.register(spark, other, at, "two")
    artifacts, collection = catalog.register(spark, second, at, "one")
    cells = {k: sum(r.n_cells for r in catalog.members(artifacts, collection, k).collect()) for k in ("one", "two")}
    assert cells == {"one": 6, "two": 4} and artifacts.count() == 4 and all(r.bytes > 0 for r in artifacts.collect())
    held = catalog.versions(spark, at)
    assert sorted((r.collection_key, r.version, r.is_latest, r.n) for r in held.groupBy("collection_key", "version", "is_latest").agg(F.sum("n_cells").alias("n")).collect()) == [("one", 1, False, 10), ("one", 3, True, 6), ("two", 2, True, 4)]
    assert [r.ordinal for r in catalog.members(artifacts, collection, "one").orderBy("ordinal").collect()] == [0, 1]


def test_a_lost_race_takes_the_next_number(spark, tmp_path, monkeypatch):
    """Another writer takes the number between the look at the folder and the making of the file."""
    at = f"{tmp_path}/catalog"
    assert [catalog._reserved(spark, at) for _ in range(2)] == [1, 2]
    fs, folder = catalog._files(spark, f"{at}/_numbers")
    listed = fs.listStatus(folder)

    class Stale:
        """The folder as it was one number ago."""

        def __getattr__(self, name):
            return getattr(fs, name)

        def listStatus(self, _):  # noqa: N802
            return listed[:0] if not len(listed) else [f for f in listed if f.getPath().getName() == "00000001"]

    own = catalog._files
    monkeypatch.setattr(catalog, "_files", lambda spark_, path: (Stale(), own(spark_, path)[1]))
    assert catalog._reserved(spark, at) == 3


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    at, path = f"{tmp_path}/catalog", written(spark, f"{tmp_path}/a", 4)
    catalog.register(spark, path, at, "one")
    spark.range(3).write.parquet(f"{at}/_aside/00000002")  # a writer that stopped
    catalog._reserved(spark, at)
    artifacts, collection = catalog.register(spark, path, at, "one")
    assert {r.version for r in collection.collect()} == {3} and catalog.versions(spark, at).count() == 4


@pytest.mark.parametrize("values", [[1, 2, math.inf], [1, 2, math.nan], [-math.inf, 1.5, math.inf], [math.inf, math.inf, 1], [-math.inf, -math.inf], [1e308, -1e308, 3], [math.nan], [5e-324, 0.0, 1e-323], [1, math.inf]])
def test_medians_of_odd_values_end(spark, values):
    at = spark.createDataFrame([(float(v),) for v in [*values]], "v double")
    right = statistics.median([v for v in values if v == v]) if any(v == v for v in values) else None
    assert qc.exact_medians(at, {"m": F.col("v")}, 8)["m"] == (right if right is None or right == right else None)


def test_half_way_between_infinities(spark):
    at = spark.createDataFrame([(-math.inf,), (math.inf,)], "v double")
    assert qc.exact_medians(at, {"m": F.col("v")})["m"] is None
