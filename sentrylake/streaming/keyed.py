"""A table of sums by key that micro-batches are merged into, in plain Parquet folders.

What a batch adds is written beside what is there, as a part with the batch's
sums.  A manifest names the parts of the newest version; it is published only
when they are complete, in turns to one of two places, so at least one whole
manifest is always there and the greater version counts.  A batch that runs
again after it was published changes nothing; one that failed before is written
over.  After ``COMPACT_AFTER`` parts they are summed up into one.  Folders of
versions go in turns through ``EPOCHS`` places, so that a reader of the version
before still finds its files, and old ones do not pile up.

One query writes a table at a time (batch ids ascend); any number may read it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT_AFTER, EPOCHS = 16, 3
_MANIFEST = "version long, last_batch long, epoch long, parts array<string>"
#: Functions that may be summed up again.
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


class KeyedTable:
    """keys: columns of the key; values: the other columns and how they merge (sum, min or max)."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], values: Mapping[str, str]) -> None:
        self.spark, self.root, self.keys, self.values = spark, root.rstrip("/"), keys, dict(values)

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(_MERGE[how](name).alias(name) for name, how in self.values.items()))

    def _slot(self, version: int) -> str:
        return f"{self.root}/manifest-{version % 2}"

    def create(self, schema: str) -> KeyedTable:
        """An empty table, unless there is one."""
        if self._manifests() is None:
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/epoch-0/part=base")
            self._publish({"version": 0, "last_batch": -1, "epoch": 0, "parts": ["epoch-0/part=base"]})
        return self

    def _manifests(self) -> list | None:
        rows = []
        for k in (0, 1):
            try:
                rows += self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest-{k}").where("version is not null").collect()
            except Exception as e:  # a place that has not been written yet, or is just being written
                if "PATH_NOT_FOUND" not in str(e) and "FILE_NOT_EXIST" not in str(e):
                    raise
        return rows or None

    def manifest(self) -> dict:
        """The newest published version: two rows at most are looked at."""
        rows = self._manifests()
        if rows is None:
            raise ValueError(f"there is no table in {self.root}; create it")
        return max(rows, key=lambda r: r["version"]).asDict()

    def _publish(self, manifest: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(self._slot(manifest["version"]))

    def merge(self, batch: DataFrame, batch_id: int) -> bool:
        """Add a batch, unless it has been added already; whether it was."""
        now = self.manifest()
        if batch_id <= now["last_batch"]:
            return False
        part = f"epoch-{now['epoch'] % EPOCHS}/part=batch-{batch_id}"
        self._summed(batch).write.mode("overwrite").parquet(f"{self.root}/{part}")
        following = now | {"version": now["version"] + 1, "last_batch": batch_id, "parts": [*now["parts"], part]}
        if len(following["parts"]) > COMPACT_AFTER:
            following = self._compacted(following)
        self._publish(following)
        return True

    def _compacted(self, manifest: dict) -> dict:
        epoch = manifest["epoch"] + 1
        folder = f"epoch-{epoch % EPOCHS}"
        # the whole folder is written over: what it held is two compactions old
        self._rows(manifest).withColumn("part", F.lit("base")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(f"{self.root}/{folder}")
        return manifest | {"epoch": epoch, "parts": [f"{folder}/part=base"]}

    def _rows(self, manifest: dict) -> DataFrame:
        return self._summed(self.spark.read.parquet(*(f"{self.root}/{p}" for p in manifest["parts"])))

    def read(self) -> DataFrame:
        """The table as of now: one row a key, of one version whatever is merged meanwhile."""
        return self._rows(self.manifest())

    def sink(self, rows_of: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: merges what ``rows_of`` makes of each batch."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.merge(rows_of(batch), batch_id)

        return write
