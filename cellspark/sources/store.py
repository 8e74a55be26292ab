"""Cells in buckets of their global index, so that epochs and lookups leave them where they lie."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.numbering import shared_folder

#: Cells that a bucket, and so one task of an epoch, is meant to hold.
BUCKET_ROWS = 1 << 18


def write_store(cells: DataFrame, name: str | None = None, path: str | None = None, buckets: int | None = None, index: str = "global_idx", rows: int | None = None) -> DataFrame:
    """Write ``cells`` as table ``name``, one file for each bucket of ``index``, sorted by it; gives the table.

    Joins on ``index`` read the buckets as they are and shuffle the other side alone; a lookup of one index reads one file, and of that the row
    groups that can hold it. Buckets are as many as keep about BUCKET_ROWS cells in one, within Spark's limit on buckets, and at least ``buckets``: a fixed
    number would make tasks grow with the table. ``rows`` is the number of cells if it is known. Without a
    ``name`` the table gets one of its own; without a ``path`` its files lie in the shared folder. A table that exists is refused.
    """
    spark = cells.sparkSession
    if index not in cells.columns:
        raise ValueError(f"cells are stored by {index}, which they lack")
    needed = min(max(1, -(-(cells.count() if rows is None else rows) // BUCKET_ROWS)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    buckets = max(buckets or 1, needed)
    name = name or f"cells_{uuid.uuid4().hex}"
    path = path or f"{shared_folder(cells)}/{name.replace('`', '')}"
    # Rows are hashed as buckets are, so each task writes one bucket.
    laid = cells.repartition(buckets, index)
    laid.write.format("parquet").bucketBy(buckets, index).sortBy(index).option("path", path).mode("error").saveAsTable(name)
    return spark.table(name)
