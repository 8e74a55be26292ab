"""Collections that grow: new artifacts are added to the global index, splits, class index and encoders without a look at earlier cells."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import uniform
from ..operators import sampling
from ..operators.labels import as_text
from ..operators.numbering import Stored, numbered, ranges, small
from ..sources.catalog import remove

#: Columns that are added to cells.
ADDED = ("storage_idx", "obs_idx", "global_idx", "split")


class GrowingCollection:
    """A collection below ``path`` that takes batches of cells, each exactly once.

    A batch adds its own rows to ``cells`` (with ``storage_idx``, ``obs_idx``, ``global_idx`` and ``split``) and to ``index``, the training
    cells of each class, and writes ``artifacts``, ``classes`` and ``values``: the sums over all batches so far, made of those of the batch
    before and its own. So its cost is that of its cells and of these three, however many cells came earlier.

    The order of cells is that of batches, then artifacts, then cells; an index once given stays. An artifact that goes on in a later
    batch keeps its ``storage_idx``. What batches give together equals what one batch for each of them, in order, would give
    anew. Splits are hashed, so no cell changes sides: an artifact is test with probability ``test``, a cell of others is validation with
    probability ``validation``. Classes are the combinations of ``weight_by`` as text (null is "unknown").

    A batch counts once its row in ``commits`` is there, which is written last; what a stopped batch has left is written over. A number that is
    committed is passed over if its cells are the same, as when a stream tries again; other cells, a number before the last one, null
    artifacts and changed options raise.
    """

    def __init__(
        self, spark: SparkSession, path: str, weight_by: Sequence[str], labels: Sequence[str] = (), validation: float = 0.2, test: float = 0.0, seed: int = 42, artifact: str = "artifact", cell: str = "cell"
    ) -> None:
        if not weight_by:
            raise ValueError("a class index needs columns to weight by")
        self.spark, self.path, self.weight_by, self.labels = spark, path.rstrip("/"), list(weight_by), list(dict.fromkeys([*labels, *weight_by]))
        self.validation, self.test, self.seed, self.artifact, self.cell = validation, test, seed, artifact, cell
        self._options = json.dumps([self.weight_by, self.labels, validation, test, seed, artifact, cell])

    def _commits(self) -> list[Row]:
        """The last two commits, the newest first."""
        try:
            held = self.spark.read.parquet(f"{self.path}/commits")
        except AnalysisException:
            return []
        return held.orderBy(F.desc("number")).limit(2).collect()

    def _at(self, name: str, number: int) -> str:
        return f"{self.path}/{name}/batch={number}"

    def _state(self, name: str, number: int | None, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if number is None else self.spark.read.parquet(self._at(name, number))

    def _write(self, df: DataFrame, name: str, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._at(name, number))
        return self.spark.read.schema(df.schema).parquet(self._at(name, number))

    def _class(self) -> Column:
        return F.array(*(as_text(c) for c in self.weight_by))

    def append(self, cells: DataFrame, number: int) -> bool:
        """Add the cells of batch ``number``; gives whether it was new."""
        if clash := [c for c in cells.columns if c in ADDED]:
            raise ValueError(f"cells have columns that are added here: {clash}")
        owner, key = F.col(f"`{self.artifact}`"), F.col(f"`{self.cell}`")
        # What makes the batch's cells is run twice: for their ids, which all counts read, and for whole rows.
        keep = Stored(cells)
        ids = keep(cells.select(owner.alias("owner"), key.alias("key")))
        try:
            return self._append(cells, ids, number)
        finally:
            keep.drop(ids)

    def _append(self, cells: DataFrame, ids: DataFrame, number: int) -> bool:
        found = ids.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("owner", "key").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"), F.count_if(F.col("owner").isNull()).alias("nulls")).first()
        commits = self._commits()
        if found.nulls:
            raise ValueError(f"{found.nulls} cells have no artifact")
        if commits and commits[0].options != self._options:
            raise ValueError(f"the collection was made with other options: {commits[0].options}")
        if commits and number <= commits[0].number:
            known = self.spark.read.parquet(f"{self.path}/commits").where(F.col("number") == number).first()
            if known is None or (known.n, known.digest) != (found.n, found.digest):
                raise ValueError(f"batch {number} is not after batch {commits[0].number}, and no batch of these cells")
            return False
        last, total = (commits[0].number, commits[0].total) if commits else (None, 0)
        written = self._add_cells(cells, ids, number, last, total)
        self._add_classes(written, number, last)
        self._add_values(written, number, last)
        row = (number, last, found.n, total + found.n, found.digest, self._options)
        self._write(self.spark.createDataFrame([row], "number long, previous long, n long, total long, digest string, options string").coalesce(1), "commits", number)
        if commits and commits[0].previous is not None:
            # The sums of two batches ago; those of the last one stay for readers that have begun.
            for name in ("artifacts", "classes", "values"):
                remove(self.spark, self._at(name, commits[0].previous))
        return True

    def _add_cells(self, cells: DataFrame, ids: DataFrame, number: int, last: int | None, total: int) -> DataFrame:
        """Number the batch's cells behind all earlier ones, and split them by hash."""
        name = f"`{self.artifact}`"
        kind = cells.schema[self.artifact].dataType.simpleString()
        before = self._state("artifacts", last, f"owner {kind}, storage_idx long, n long").select("owner", "storage_idx", "n")
        own = ids.groupBy("owner").agg(F.count("*").alias("own"))
        both = before.join(own, "owner", "full")
        # Artifacts are numbered in one window: a row for each of a collection, not for each cell.
        new = Window.orderBy(F.col("storage_idx").isNull(), "storage_idx", "owner")
        both = both.select("owner", (F.row_number().over(new) - 1).cast("long").alias("storage_idx"), F.coalesce("n", F.lit(0)).alias("past"), F.coalesce("own", F.lit(0)).alias("own"))
        upto = F.sum("own").over(Window.orderBy("storage_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = self._write(both.select("owner", "storage_idx", (F.col("past") + F.col("own")).alias("n"), "past", "own", (upto - F.col("own") + F.lit(total)).alias("start")), "artifacts", number)
        at = cells.select(F.struct("*").alias("row"), F.col(name).alias("owner"), F.col(f"`{self.cell}`").alias("key"))
        at = numbered(at, ["owner"], ranges(ids, "key"), ["key"], "pos", counted=ids).join(small(sums.where("own > 0").select("owner", "storage_idx", "past", "start")), "owner")
        held_out = uniform(f"{self.seed}t", "owner") < F.lit(float(self.test))
        side = F.when(held_out, "test").when(uniform(f"{self.seed}v", "owner", "key") < F.lit(float(self.validation)), "validation").otherwise("train")
        return self._write(at.select("row.*", "storage_idx", (F.col("past") + F.col("pos")).alias("obs_idx"), (F.col("start") + F.col("pos")).alias("global_idx"), side.alias("split")), "cells", number)

    def _add_classes(self, written: DataFrame, number: int, last: int | None) -> None:
        """The training cells of each class, numbered behind those of earlier batches."""
        at = written.where("split = 'train'").select(self._class().alias("class"), "global_idx")
        before = self._state("classes", last, "class array<string>, n long")
        sums = before.select("class", F.col("n").alias("past")).join(at.groupBy("class").agg(F.count("*").alias("own")), "class", "full")
        sums = self._write(sums.select("class", F.coalesce("past", F.lit(0)).alias("past"), (F.coalesce("past", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n")), "classes", number)
        rows = numbered(at, ["class"], ranges(at, "global_idx"), ["global_idx"], "pos").join(small(sums.select("class", "past")), "class")
        self._write(rows.select("class", "global_idx", (F.col("past") + F.col("pos")).alias("pos")), "index", number)

    def _add_values(self, written: DataFrame, number: int, last: int | None) -> None:
        """The values of each label, with the batch in which they first came."""
        pairs = F.array(*(F.struct(F.lit(x).alias("label"), as_text(f"`{x}`").alias("value")) for x in self.labels))
        own = written.select(F.explode(pairs).alias("p")).select("p.label", "p.value", F.lit(number).cast("long").alias("since")).distinct()
        held = self._state("values", last, "label string, value string, since long").unionByName(own)
        self._write(held.groupBy("label", "value").agg(F.min("since").alias("since")), "values", number)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Append every micro-batch of a stream of cells; by default all that is there, then stop."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.append(batch, number)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _last(self) -> int:
        if not (commits := self._commits()):
            raise ValueError(f"no batch is committed below {self.path}")
        return commits[0].number

    def _rows(self, name: str) -> DataFrame:
        """Rows of committed batches alone, by their folders' numbers."""
        last = self._last()
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{name}").where(F.col("batch") <= last).drop("batch")

    def cells(self) -> DataFrame:
        """All cells; columns that some batches lack are null there."""
        return self._rows("cells")

    def artifacts(self) -> DataFrame:
        """``storage_idx`` and ``n`` cells of each artifact."""
        return self._state("artifacts", self._last(), "").select(F.col("owner").alias(self.artifact), "storage_idx", "n")

    def classes(self) -> DataFrame:
        """``class``, its ``label`` (a dense code in order of values), ``n`` training cells and ``offset``, where it begins among all."""
        at = self._state("classes", self._last(), "")
        order = Window.orderBy("class")
        return at.select("class", (F.row_number().over(order) - 1).alias("label"), "n", (F.sum("n").over(order) - F.col("n")).alias("offset"))

    def class_index(self) -> DataFrame:
        """``label``, ``global_idx``, ``pos`` within the class and the class's ``offset`` for every training cell (see :func:`labels.class_index`)."""
        return self._rows("index").join(small(self.classes().select("class", "label", "offset")), "class").select("label", "global_idx", "pos", "offset")

    def encoder(self, label: str, unknown: str = "unknown", stable: bool = False) -> DataFrame:
        """``label``, ``value`` and ``code`` of a label: in order of value, as :func:`labels.encoder` would give over all cells, or ``stable``:
        in order of the batch in which values first came, so that codes of a trained model hold when new values come."""
        at = self._state("values", self._last(), "").where((F.col("label") == label) & (F.col("value") != unknown))
        order = Window.orderBy(*(["since"] if stable else []), "value")
        known = at.select("value", (F.row_number().over(order) - 1).alias("code"))
        return known.unionByName(self.spark.createDataFrame([(unknown, -1)], "value string, code int")).select(F.lit(label).alias("label"), "value", "code")

    def draws(self, n_samples: int, weight_scaler: float = 50.0, epoch: int = 0) -> DataFrame:
        """``draw_id`` and ``global_idx`` of an epoch: classes by weight s n / (n + s), then cells within them."""
        s = F.lit(float(weight_scaler))
        weights = self.classes().where("n > 0").select("label", "n", (s * F.col("n") / (F.col("n") + s)).alias("weight"))
        drawn = sampling.draw_labels(weights, n_samples, f"{self.seed}e{epoch}")
        return sampling.draw_rows(drawn, self.class_index(), f"{self.seed}e{epoch}").select("draw_id", "global_idx")
