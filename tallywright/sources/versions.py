"""Folders that all of a cluster shares, and tables kept as a sequence of whole versions in them."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which driver and executors share.

    Where none is named, a new one of this machine, if all of Spark runs on it;
    elsewhere that is an error, as executors would write to their own disks.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _made:
        _made[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _made[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/tallywright/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class VersionedTable:
    """A Parquet table whose every change is a new folder, `v<number>-<label>`.

    A version counts once Spark has marked it whole; what a failed job left
    behind is never read, and written over by the next attempt. Readers keep the
    version they started with. A label is written once: a step that is repeated
    with the same label changes nothing. One writer at a time.
    """

    spark: SparkSession
    path: str
    schema: T.StructType

    def versions(self) -> list[tuple[int, str]]:
        """Numbers and labels of all whole versions, in order."""
        folder, files = self._files(self.path)
        if not files.exists(folder):
            return []
        found = []
        for status in files.listStatus(folder):
            match = re.fullmatch(r"v(\d+)-([\w.\-]+)", status.getPath().getName())
            if match and files.exists(self._files(f"{self.path}/{match[0]}/_SUCCESS")[0]):
                found.append((int(match[1]), match[2]))
        return sorted(found)

    def read(self) -> DataFrame:
        """The last version; without any, an empty table."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(*known[-1]))

    def write(self, rows: DataFrame, label: str) -> bool:
        """Adds a version, unless one has this label already; whether it did."""
        if not re.fullmatch(r"[\w.\-]+", label):
            raise ValueError("a label is made of letters, digits, dots, dashes and underscores")
        known = self.versions()
        if label in {own for _, own in known}:
            return False
        number = known[-1][0] + 1 if known else 1
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._folder(number, label))
        return True

    def forget_before(self, keep: int) -> None:
        """Deletes all but the last `keep` versions, which no reader may still use; their labels are forgotten, too."""
        for version in self.versions()[: -keep if keep else None]:
            folder, files = self._files(self._folder(*version))
            files.delete(folder, True)

    def _folder(self, number: int, label: str) -> str:
        return f"{self.path}/v{number:08d}-{label}"

    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
