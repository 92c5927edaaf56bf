"""What is worked out once per content and kept: versioned folders of batches, to which only what is missing is added."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


class ContentCache:
    """Rows by a content key below folder/version. Every batch is a folder of its own that counts once its writer has marked it as done, so that a job that dies leaves nothing half there, and writers don't disturb each other.

    Another version, of the code or of its settings, starts anew; older ones stay where they are.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str, key: str = "key"):
        self.spark, self.folder, self.key = spark, f"{folder.rstrip('/')}/{version}", key
        #: How many keys the last call had to work out.
        self.computed = 0

    def _batches(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        disk = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not disk.exists(path):
            return []
        found = [x.getPath() for x in disk.listStatus(path)]
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(x.toString() for x in found if disk.exists(mark(x, "_SUCCESS")))

    def rows(self) -> DataFrame | None:
        """All rows of finished batches, one of each key; None if there are none."""
        batches = self._batches()
        if not batches:
            return None
        whole = self.spark.read.parquet(*batches)
        return whole.dropDuplicates([self.key]) if len(batches) > 1 else whole

    def get(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The kept row of each distinct key of wanted. compute gets one row of wanted for each key that is missing, and gives rows with the key; null keys are left out."""
        wanted, kept = wanted.where(F.col(self.key).isNotNull()), self.rows()
        missing = wanted if kept is None else wanted.join(kept.select(self.key), self.key, "left_anti")
        batch = f"{self.folder}/batch-{uuid.uuid4().hex}"
        compute(missing.dropDuplicates([self.key])).write.option("compression", "zstd").parquet(batch)
        new = self.spark.read.parquet(batch)
        self.computed = new.count()
        whole = new if kept is None else reduce(DataFrame.unionByName, [kept, new])
        return whole.join(wanted.select(self.key).distinct(), self.key, "left_semi")
