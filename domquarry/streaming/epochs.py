"""A table written by micro-batches, in which every batch counts once.

``EpochTable(path)`` keeps the rows of an epoch (a micro-batch) in a folder of its
own, named by the attempt, and a manifest per epoch that names the folder that
counts.  The manifest is renamed into place when the rows are whole, and readers
open only folders that a manifest names.  So

* a batch that dies while writing leaves a folder that nobody reads;
* a batch that is run again (the stream died between write and commit) replaces its
  epoch's manifest, and its rows stand once;
* a reader sees an epoch whole or not at all.

Folders that no manifest names any more are deleted when their epoch is written
again.  Every ``FOLD`` epochs one manifest takes over the list of all before it, so
opening the table reads a bounded number of small files besides that list.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD = 100


class EpochTable:
    """``path``: any folder that Spark's executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        modes = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
        modes[0] = hadoop.fs.Options.Rename.OVERWRITE
        self._over = modes

    def write(self, rows: DataFrame, epoch: int) -> None:
        """The rows of ``epoch``, in place of what an earlier attempt committed for it."""
        before = self.committed().get(epoch)
        folder = f"epoch-{epoch:09d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{folder}")
        self._publish(f"{epoch:09d}", {str(epoch): folder})
        if before:
            self._fs.delete(self._path(f"{self.path}/data/{before}"), True)
        if epoch and epoch % FOLD == 0:
            self._fold(epoch)

    def committed(self) -> dict[int, str]:
        """epoch -> folder of its rows.  A later manifest of an epoch stands over a folded one."""
        names = sorted(self._listed("manifests"))
        folded = [n for n in names if n.startswith("to-")]
        out = self._read(folded[-1]) if folded else {}
        for name in names:
            if not name.startswith(("to-", ".", "_")):
                out |= self._read(name)
        return {int(k): v for k, v in out.items()}

    def read(self, schema) -> DataFrame:
        """All committed rows, with their ``epoch``."""
        folders = self.committed()
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("epoch", F.lit(0).cast("long"))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders.values()])
        at = F.regexp_extract(F.input_file_name(), r"/epoch-(\d+)-[0-9a-f]+/", 1)
        return rows.withColumn("epoch", at.cast("long"))

    def _fold(self, epoch: int) -> None:
        """One manifest for all epochs up to ``epoch``; their own ones go, but for this epoch's."""
        self._publish(f"to-{epoch:09d}", {str(k): v for k, v in self.committed().items() if k <= epoch})
        for name in self._listed("manifests"):
            if name < f"{epoch:09d}" or "to-" <= name < f"to-{epoch:09d}":
                self._fs.delete(self._path(f"{self.path}/manifests/{name}"), False)

    def _listed(self, folder: str) -> list[str]:
        place = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def _read(self, name: str) -> dict[str, str]:
        source = self._fs.open(self._path(f"{self.path}/manifests/{name}"))
        try:
            return json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()

    def _publish(self, name: str, content: dict[str, str]) -> None:
        own = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(own, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._files.rename(own, self._path(f"{self.path}/manifests/{name}"), self._over)
