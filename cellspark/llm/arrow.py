"""Map over the rows of a DataFrame in bounded Arrow pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: About so many bytes of text are worked on, and given back, at a time.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes at most (or one row)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def lists(ids: list[np.ndarray]) -> pa.Array:
    """Arrays of ids as one column of lists."""
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.array([], np.int32)))


def quoted(column: str) -> str:
    """A column's name as :func:`F.col` takes it whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def map_text(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], dict[str, pa.Array]]], fields: list[T.StructField], keep: list[str], limit: int = PIECE_BYTES) -> DataFrame:
    """Columns ``keep`` of ``df`` with new ``fields`` for the texts in ``text``; a kept column of a new field's name gives way to it.

    ``make`` runs once in each task and returns what turns a list of texts (null: empty) into the new
    columns, by the names of ``fields``; it is given about ``limit`` bytes at a time. Nothing is shuffled, and rows keep their order.
    """
    kept = [c for c in keep if c not in {f.name for f in fields}]
    # Numbered within the task, so no name of the rows clashes with another.
    names = [f"c{i}" for i in range(len(kept))]
    narrow = df.select(*(F.col(quoted(c)).alias(n) for c, n in zip(kept, names, strict=True)), F.col(quoted(text)).alias("text"))
    schema = T.StructType(narrow.schema.fields[:-1] + [T.StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = make()
        for batch in pieces(batches, "text", limit):
            made = turn([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(made[f.name] for f in fields)], names=schema.names)

    out = narrow.mapInArrow(work, schema)
    return out.select(*(F.col(a).alias(b) for a, b in zip(schema.names, [*kept, *(f.name for f in fields)], strict=True)))
