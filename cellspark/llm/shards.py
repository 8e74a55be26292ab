"""Token ids in training order: fixed-stride shards that are read in sequence and resumed anywhere.

Documents are encoded once and cut into sequences of equal length, which are numbered without gaps: within each
task as it encodes, and from task to task by the tasks' totals. A keyed Feistel permutation with cycle-walking
turns the numbers 0 .. N - 1 into slots. Ranges of slots are the shards, so a slot gives its shard and byte. The ids are
shuffled once, those of some shards at a time.
"""

from __future__ import annotations

import gc
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces
from .bpe import encode, encoding
from .common import Scratch, small

#: Two line feeds end each record: the text writer's separator, and a guard against misplaced reads.
GUARD = b"\n\n"
#: Document id (the least long for null), part of the document, tokens in the sequence, big-endian; then the ids, little-endian.
HEAD = ">qii"
HEAD_BYTES = struct.calcsize(HEAD)
NULL_ID = -(1 << 63)
ROUNDS = 4
#: Turns in which the shards are written, each of as many shards.
TURNS = 6
MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1, applied to ``index``.

    A balanced Feistel network permutes the least range of 4 ** k numbers that holds ``size``; a result
    of ``size`` or more is permuted again until it falls inside.
    """
    half = max(1, -(-max(size - 1, 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & MASK) for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while walk.size:
        left, right = out[walk] >> np.uint64(half), out[walk] & low
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & low)
        out[walk] = (left << np.uint64(half)) | right
        walk = walk[out[walk] >= np.uint64(size)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Where sequences lie: ``size`` of them, of ``length`` ids of ``width`` bytes, ``rows`` to a shard."""

    length: int
    end: int
    key: int
    size: int
    width: int
    rows: int

    @property
    def stride(self) -> int:
        return HEAD_BYTES + self.width * self.length + len(GUARD)

    @property
    def shards(self) -> int:
        return -(-self.size // self.rows)

    def locate(self, slot: int) -> tuple[int, int]:
        """Shard, and first byte in its file, of a slot: where a reader that was stopped goes on."""
        return slot // self.rows, slot % self.rows * self.stride

    def held(self, shard: int) -> int:
        """Sequences in a shard."""
        return min(self.rows, self.size - shard * self.rows)


def _dtype(width: int) -> str:
    return f"<u{width}"


ENCODED = T.StructType(
    [T.StructField("task", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("k", T.LongType()), T.StructField("parts", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())]
)


def encoded(docs: DataFrame, length: int, rank_file: str, pattern: str, width: int, doc_key: str, text: str) -> DataFrame:
    """Every document's ids, its number of sequences (``parts``), and the ``number`` of its first one within its ``task``."""
    shared = docs.sparkSession.sparkContext.broadcast((Path(rank_file).read_bytes(), pattern))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(*shared.value)
        task, number = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text"):
            ids = [encode(enc, x or "") for x in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            parts = n // length + 1
            first = number + np.cumsum(parts) - parts
            number += int(parts.sum())
            made = [pa.array(np.full(len(ids), task, np.int32)), pa.array(first), batch.column("k"), pa.array(parts), pa.array(n), pa.array([x.astype(_dtype(width)).tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=ENCODED.names)

    return docs.select(F.col(doc_key).cast("long").alias("k"), F.col(text).alias("text")).mapInArrow(work, ENCODED)


def write_shards(docs: DataFrame, path: str, rank_file: str, pattern: str, length: int, end: int, key: int, shard_bytes: int, doc_key: str = "doc_id", text: str = "text") -> Layout:
    """Encode ``docs`` and write the records of each shard to a folder ``shard=<n>`` below ``path``; gives their layout.

    Every document ends with the token ``end``, which also fills its last sequence. Null and empty
    texts are that token alone. Sequences are numbered in the order of the tasks' rows, and the slot of number
    i is the permutation of i. A record holds a head, ``length`` ids and a guard, so that of slot s starts at byte
    ``layout.locate(s)``. Ids take two bytes, or four if ``end`` or one of the file's ranks needs them. Repeated rows are sequences of
    their own, null keys too. No rows make no shard. A path that is there already raises, so a driver that tries again
    must name a new one or clear the old: records are never added to shards.
    """
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileExistsError(f"there is something at {path} already")
    most = max(end, *(int(x.split()[1]) for x in Path(rank_file).read_bytes().splitlines() if x))
    if not 0 <= end <= most < 1 << 31:
        raise ValueError(f"ids from 0 to {most} do not fit")
    width = 2 if most < 1 << 16 else 4
    work = Scratch(spark)
    held = work.write(encoded(docs, length, rank_file, pattern, width, doc_key, text), "encoded", "zstd")
    # A row for each task: its sequences, and those of the tasks before it.
    totals = work.write(held.groupBy("task").agg(F.sum("parts").alias("parts")), "totals")
    size = totals.agg(F.sum("parts")).first()[0] or 0
    layout = Layout(length, end, key, size, width, max(1, shard_bytes // (HEAD_BYTES + width * length + len(GUARD))))
    if not size:
        return layout
    before = F.coalesce(F.sum("parts").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = held.join(small(totals.select("task", before.alias("before"))), "task").select((F.col("before") + F.col("number")).alias("number"), "k", "n", "ids")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("value", T.BinaryType())])
    # Shards are written in turns, so that the shuffle holds a part of the ids at a time beside their two tables.
    turns = [(layout.shards * i // TURNS, layout.shards * (i + 1) // TURNS) for i in range(TURNS)]
    for low, high in (x for x in turns if x[0] < x[1]):

        def cut(batches: Iterator[pa.RecordBatch], low: int = low, high: int = high) -> Iterator[pa.RecordBatch]:
            step = layout.width * layout.length
            fill = np.array([layout.end], _dtype(layout.width)).tobytes()
            for batch in pieces(batches, "ids"):
                number, n = (batch.column(c).to_numpy() for c in ("number", "n"))
                parts = n // layout.length + 1
                row = np.repeat(np.arange(len(n)), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                slot = permute(number[row] + part, layout.size, layout.key)
                shard = slot // layout.rows
                chosen = np.flatnonzero((low <= shard) & (shard < high))
                docs, ids, records = batch.column("k"), batch.column("ids"), []
                for i, j in zip(row[chosen].tolist(), part[chosen].tolist(), strict=True):
                    name, data = docs[i].as_py(), ids[i].as_buffer()
                    own = data[j * step : (j + 1) * step].to_pybytes() if len(data) else b""
                    head = struct.pack(HEAD, NULL_ID if name is None else name, j, len(own) // layout.width + (len(own) < step))
                    records.append(head + own + fill * (layout.length - len(own) // layout.width))
                yield pa.RecordBatch.from_arrays([pa.array(shard[chosen].astype(np.int32)), pa.array(slot[chosen]), pa.array(records, pa.binary())], names=schema.names)

        rows = numbered.mapInArrow(cut, schema).repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("shard", "slot")
        rows.select("shard", F.col("value").cast("string").alias("value")).write.mode("append").partitionBy("shard").option("lineSep", GUARD.decode()).text(path)
        del rows
        # Spark removes a shuffle's files once the driver has collected what refers to them.
        gc.collect()
        spark._jvm.System.gc()
    work.drop(held)
    return layout


def read_shards(spark: SparkSession, path: str, layout: Layout, first: int = 0, count: int | None = None) -> DataFrame:
    """The sequences from slot ``first`` on, ``count`` of them or all: ``slot``, ``shard``, ``doc_id``,
    ``part``, ``n_tokens`` and ``ids`` (little-endian, ``layout.width`` bytes each, without the fill).

    Only shards that hold such slots are opened, and only records of such slots are cut out. A shard of another length than
    the layout says, or a record without its guard, raises. Records are read by column functions alone.
    """
    first, last = max(first, 0), layout.size if count is None else min(layout.size, first + count)
    if first >= last:
        return spark.createDataFrame([], "slot long, shard int, doc_id long, part int, n_tokens int, ids binary")
    whole_shards = spark.read.format("binaryFile").load(path).select("shard")
    if twice := whole_shards.groupBy("shard").count().where("count > 1").select("shard").head(1):
        raise ValueError(f"shard {twice[0].shard} has two files, as if it had been written twice")
    files = spark.read.format("binaryFile").load(path).where(F.col("shard").between(layout.locate(first)[0], layout.locate(last - 1)[0]))
    base = F.col("shard").cast("long") * layout.rows
    held = F.least(F.lit(layout.rows), F.lit(layout.size) - base)
    whole = F.when(F.col("length") != held * layout.stride, F.raise_error(F.concat(F.lit("a shard has another length than its layout: "), F.col("path")))).otherwise(F.col("content"))
    slots = F.sequence(F.greatest(base, F.lit(first)), F.least(base + held, F.lit(last)) - 1)
    rows = files.select("shard", "path", whole.alias("content"), F.explode(slots).alias("slot"))
    record = F.substring("content", ((F.col("slot") - base) * layout.stride + 1).cast("int"), F.lit(layout.stride))
    rows = rows.select("slot", "shard", "path", record.alias("v"))
    number = lambda at, size: F.conv(F.hex(F.substring("v", at, size)), 16, -10).cast("long")
    guarded = F.when(F.substring("v", layout.stride - len(GUARD) + 1, len(GUARD)) == F.lit(GUARD), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("a record has no guard: "), F.col("path"))).cast("binary"))
    rows = rows.withColumn("v", guarded).select("slot", "shard", F.nullif(number(1, 8), F.lit(NULL_ID)).alias("doc_id"), number(9, 4).cast("int").alias("part"), number(13, 4).cast("int").alias("n_tokens"), "v")
    return rows.select("slot", "shard", "doc_id", "part", "n_tokens", F.substring("v", F.lit(HEAD_BYTES + 1), F.col("n_tokens") * layout.width).alias("ids"))
