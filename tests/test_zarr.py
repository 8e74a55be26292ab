"""Matrices in zarr, written here byte by byte, against what was written."""

import gzip
import json
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cellspark.sources import catalog
from cellspark.sources.zarr import read_zarr

CODECS = {None: bytes, "gzip": gzip.compress, "zlib": zlib.compress, "zstd": zstandard.ZstdCompressor().compress}


def put(path, values, chunk, codec=None, named=None):
    path.mkdir(parents=True)
    text = values.dtype.kind == "O"
    meta = dict(zarr_format=2, shape=[len(values)], chunks=[chunk], dtype="|O" if text else values.dtype.str, compressor={"id": named or codec} if named or codec else None, fill_value=0, order="C", filters=[{"id": "vlen-utf8"}] if text else None)
    (path / ".zarray").write_text(json.dumps(meta))
    for i in range(-(-len(values) // chunk)):
        part = values[i * chunk : (i + 1) * chunk]
        if text:
            raw = [x.encode() for x in part]
            data = len(raw).to_bytes(4, "little") + b"".join(len(r).to_bytes(4, "little") + r for r in raw)
        else:
            if not part.any() and i:
                continue  # a chunk of fill values has no file
            data = np.concatenate([part, np.zeros(chunk - len(part), part.dtype)]).tobytes()
        (path / str(i)).write_bytes(CODECS[codec](data))


def matrix(root, codec, n=23, genes=9, seed=1, kind="csr_matrix", named=None):
    rng = np.random.default_rng(seed)
    dense = rng.poisson(0.7, (n, genes)).astype(np.float32)
    dense[5], dense[n - 1] = 0, 0
    row, place = np.nonzero(dense)
    put(root / "X/indptr", np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype("<i4"), 4, codec)
    put(root / "X/indices", place.astype("<i4"), 7, codec)
    put(root / "X/data", dense[row, place], 5, codec, named)
    (root / "X/.zattrs").write_text(json.dumps({"encoding-type": kind}))
    put(root / "obs/_index", np.array([f"{root.name}-c{i}é" for i in range(n)], object), 6, codec)
    put(root / "obs/depth", dense.sum(1).astype("<f8"), 8, codec)
    put(root / "obs/kind/codes", (np.arange(n) % 3 - 1).astype("|i1"), 10, codec)
    put(root / "obs/kind/categories", np.array(["x", "y"], object), 2, codec)
    (root / "obs/.zattrs").write_text(json.dumps({"_index": "_index", "column-order": ["depth", "kind"]}))
    put(root / "var/_index", np.array([f"g{i}" for i in range(genes)], object), 4, codec)
    return dense


@pytest.mark.parametrize("codec", list(CODECS))
def test_matrix_is_read_as_written(spark, tmp_path, codec):
    root = tmp_path / "m.zarr"
    dense = matrix(root, codec)
    at = read_zarr(spark, str(root), rows=5)
    assert at.rdd.getNumPartitions() == 3
    got = at.orderBy("obs_idx").collect()
    assert [r.obs_idx for r in got] == list(range(23)) and got[3].cell == "m.zarr-c3é"
    assert [r.kind for r in got] == [[None, "x", "y"][i % 3] for i in range(23)]
    for r, want in zip(got, dense, strict=True):
        assert {x.gene: x.value for x in r.expr} == {f"g{j}": float(v) for j, v in enumerate(want) if v} and r.depth == want.sum()
    (root / "X/data/0").write_bytes(b"not to be read")
    some = read_zarr(spark, str(root), start=12, stop=18).collect()
    assert sorted((r.obs_idx, r.expr) for r in some) == [(r.obs_idx, r.expr) for r in got[12:18]]
    assert read_zarr(spark, str(root), start=30, stop=18).count() == 0


def test_collection_of_both_formats(spark, tmp_path):
    matrix(tmp_path / "a.zarr", "gzip")
    matrix(tmp_path / "b.zarr", None, n=11, seed=2)
    own = spark.createDataFrame([("p1", "x", [("g1", 2.0)])], "cell string, kind string, expr array<struct<gene:string,value:double>>")
    own.write.parquet(str(tmp_path / "c"))
    at = catalog.read_cells(spark, [str(tmp_path / x) for x in ("a.zarr", "b.zarr", "c")])
    assert at.count() == 35 and at.where("depth IS NULL").select("cell").first().cell == "p1"
    total = at.agg(F.sum(F.aggregate("expr", F.lit(0.0), lambda s, x: s + x["value"])).alias("s"), F.sum("depth").alias("d")).first()
    assert total.s == total.d + 2


def test_what_is_not_read_is_named(spark, tmp_path):
    matrix(tmp_path / "a.zarr", None, named="blosc")
    with pytest.raises(Exception, match="blosc"):
        read_zarr(spark, str(tmp_path / "a.zarr")).collect()
    matrix(tmp_path / "b.zarr", None, kind="csc_matrix")
    with pytest.raises(Exception, match="csc_matrix"):
        read_zarr(spark, str(tmp_path / "b.zarr")).collect()
