"""Cells of an annotated matrix in zarr (format 2), as a data source: a partition for each run of chunks of rows."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "zarr_cells"
#: Rows of a partition, rounded up to whole chunks of the matrix's row pointers, and of a batch.
PARTITION_ROWS, BATCH_ROWS = 1 << 16, 1 << 11


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


#: Compressors that are read, by the names that metadata give them.
DECODERS = {"gzip": gzip.decompress, "zlib": zlib.decompress, "zstd": _zstd}


class Vector:
    """A one-dimensional array: plain values or strings of variable length, whose chunks are read as they are asked for."""

    def __init__(self, path: Path):
        meta = json.loads((path / ".zarray").read_text())
        codec, filters = meta["compressor"], meta["filters"] or []
        if meta["zarr_format"] != 2 or len(meta["shape"]) != 1:
            raise ValueError(f"{path}: one-dimensional arrays of zarr format 2 are read")
        if codec and codec["id"] not in DECODERS:
            raise ValueError(f"{path}: compressor {codec['id']} is not supported, only {', '.join(DECODERS)}")
        self.text = [f["id"] for f in filters] == ["vlen-utf8"]
        if filters and not self.text:
            raise ValueError(f"{path}: filters {[f['id'] for f in filters]} are not supported")
        self.path, self.decode, self.fill = path, DECODERS[codec["id"]] if codec else bytes, meta["fill_value"]
        self.length, self.step = meta["shape"][0], meta["chunks"][0]
        self.dtype = np.dtype(object if self.text else meta["dtype"])
        if not self.text and self.dtype.kind not in "biuf":
            raise ValueError(f"{path}: type {meta['dtype']} is not supported")
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def chunk(self, i: int) -> np.ndarray:
        """The last chunk is kept; one without a file holds the fill value alone."""
        if self.held[0] != i:
            file = self.path / str(i)
            if not file.exists():
                out = np.full(self.step, float("nan") if self.fill == "NaN" else self.fill if self.fill is not None else ("" if self.text else 0), self.dtype)
            else:
                data = self.decode(file.read_bytes())
                out = self._strings(data) if self.text else np.frombuffer(data, self.dtype)
            self.held = i, out
        return self.held[1]

    def _strings(self, data: bytes) -> np.ndarray:
        out, at = [], 4
        for _ in range(int.from_bytes(data[:4], "little")):
            n = int.from_bytes(data[at : at + 4], "little")
            out.append(data[at + 4 : at + 4 + n].decode())
            at += 4 + n
        return np.array(out, object)

    def slice(self, lo: int, hi: int) -> np.ndarray:
        parts = [self.chunk(i)[max(lo - i * self.step, 0) : hi - i * self.step] for i in range(lo // self.step, -(-hi // self.step))] if hi > lo else []
        return np.concatenate(parts) if parts else np.empty(0, self.dtype)


class Labels:
    """A column of the cells' or genes' table: values, or codes of categories (-1: null)."""

    def __init__(self, path: Path):
        coded = (path / "codes").exists()
        self.values = Vector(path / "codes" if coded else path)
        names = Vector(path / "categories") if coded else None
        self.names = names.slice(0, names.length).tolist() if coded else None
        kind = (names or self.values).dtype.kind
        self.type = {"O": pa.string(), "b": pa.bool_(), "f": pa.float64()}.get(kind, pa.int64())

    def slice(self, lo: int, hi: int) -> pa.Array:
        found = self.values.slice(lo, hi).tolist()
        return pa.array([self.names[c] if c >= 0 else None for c in found] if self.names is not None else found, self.type)


def _attributes(path: Path) -> dict:
    file = path / ".zattrs"
    return json.loads(file.read_text()) if file.exists() else {}


def _columns(root: Path) -> dict[str, Path]:
    """The cells' name and labels, and where they lie."""
    about = _attributes(root / "obs")
    return {"cell": root / "obs" / about.get("_index", "_index"), **{c: root / "obs" / c for c in about.get("column-order", [])}}


class Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class CellReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.root, self.names, self.options = Path(options["path"].removeprefix("file://")), names, dict(options)

    def partitions(self) -> list[Rows]:
        pointers = Vector(self.root / "X" / "indptr")
        lo, hi = int(self.options.get("start", 0)), min(int(self.options.get("stop", pointers.length - 1)), pointers.length - 1)
        step = -(-int(self.options.get("rows", PARTITION_ROWS)) // pointers.step) * pointers.step
        edges = [lo, *(x for x in range(lo // step * step + step, hi, step)), hi] if hi > lo else []
        return [Rows(a, b) for a, b in zip(edges, edges[1:], strict=False)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        pointers, places, values = (Vector(self.root / "X" / x) for x in ("indptr", "indices", "data"))
        var = Vector(self.root / "var" / _attributes(self.root / "var").get("_index", "_index"))
        genes = pa.array(var.slice(0, var.length).tolist(), pa.string())
        columns = {c: Labels(p) for c, p in _columns(self.root).items() if c in self.names}
        for lo in range(part.lo, part.hi, BATCH_ROWS):
            hi = min(lo + BATCH_ROWS, part.hi)
            at = pointers.slice(lo, hi + 1).astype(np.int64)
            gene = genes.take(pa.array(places.slice(at[0], at[-1])))
            value = pa.array(values.slice(at[0], at[-1]).astype(np.float64))
            expr = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.StructArray.from_arrays([gene, value], ["gene", "value"]))
            own = {"obs_idx": pa.array(np.arange(lo, hi, dtype=np.int64)), "expr": expr, **{c: x.slice(lo, hi) for c, x in columns.items()}}
            yield pa.RecordBatch.from_arrays([own[n] for n in self.names], names=self.names)


class CellSource(DataSource):
    """``obs_idx``, ``cell``, the labels, and ``expr`` (gene, value) of the matrix below ``path``, which all machines must see.

    ``start`` and ``stop`` keep a stretch of rows and read its chunks alone; ``rows`` sets a partition's size. Matrices by column or not
    sparse, and compressors but gzip, zlib and zstd, are refused by name.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        root = Path(self.options["path"].removeprefix("file://"))
        kind = _attributes(root / "X").get("encoding-type", "csr_matrix" if (root / "X" / "indptr").exists() else "array")
        if kind != "csr_matrix":
            raise ValueError(f"{root}: X is a {kind}; store one sparse row per cell")
        kinds = {pa.string(): T.StringType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType(), pa.int64(): T.LongType()}
        fields = [T.StructField(c, kinds[Labels(p).type]) for c, p in _columns(root).items()]
        pair = T.StructType([T.StructField("gene", T.StringType()), T.StructField("value", T.DoubleType())])
        return T.StructType([T.StructField("obs_idx", T.LongType()), *fields, T.StructField("expr", T.ArrayType(pair))])

    def reader(self, schema: T.StructType) -> CellReader:
        return CellReader(self.options, schema.names)


def read_zarr(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The cells of one matrix; ``options``: start, stop, rows."""
    spark.dataSource.register(CellSource)
    return spark.read.format(NAME).options(**options).load(path)
