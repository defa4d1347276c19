"""A log of micro-batches that is folded now and then, so reading it does not grow with its age."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: After so many batches the log is folded.
FOLD_EVERY = 16


class FoldedLog:
    """Rows written under the id of their micro-batch, and their fold.

    `combine` makes one row per key of the rows of many batches, and of such rows
    again; it gets and returns the column `batch` besides those written. After each
    `every` batches all before are folded into a base, so a reader meets one base
    and at most `every` batches. A retry replaces the rows and the base of its own
    batch and reads only what lies before it; what no retry can need is removed.
    """

    def __init__(
        self, spark: SparkSession, log: str, bases: str, combine: Callable[[DataFrame], DataFrame], every: int = FOLD_EVERY
    ):
        self.spark, self.log, self.bases, self.combine, self.every = spark, log, bases, combine, every

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.log}/batch={batch_id}")
        border = batch_id + 1
        if border % self.every == 0:
            self._rows(border, border - self.every).write.mode("overwrite").parquet(f"{self.bases}/below={border}")
            self._remove(self.log, border - self.every)
            self._remove(self.bases, border - self.every)

    def read(self, until: int | None = None) -> DataFrame | None:
        """The fold of the batches below `until`, by default of all complete ones; none if there are none."""
        until = self.batches() if until is None else until
        return self._rows(until, until // self.every * self.every) if until else None

    def batches(self) -> int:
        """Number of complete batches; their ids have no gaps."""
        return max((k + 1 for k, path in self._parts(self.log) if self._is_complete(path)), default=0)

    def _rows(self, until: int, border: int) -> DataFrame:
        """The fold of the base below `border` and the batches from there."""
        rows = []
        if border:
            rows.append(self.spark.read.parquet(f"{self.bases}/below={border}"))
        if until > border:
            paths = [f"{self.log}/batch={k}" for k in range(border, until)]
            log = self.spark.read.option("basePath", self.log).parquet(*paths)
            rows.append(log.withColumn("batch", log["batch"].cast("bigint")))
        return self.combine(rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]))

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _is_complete(self, path) -> bool:
        files, success = self._files(f"{path}/_SUCCESS")
        return files.exists(success)

    def _parts(self, folder: str) -> list:
        """Number and path of each part of a folder."""
        files, path = self._files(folder)
        if not files.exists(path):
            return []
        parts = [status.getPath() for status in files.listStatus(path) if status.isDirectory()]
        return [(int(p.getName().partition("=")[2]), p) for p in parts if p.getName().partition("=")[2].isdigit()]

    def _remove(self, folder: str, below: int) -> None:
        files, _ = self._files(folder)
        for k, path in self._parts(folder):
            if k < below:
                files.delete(path, True)
