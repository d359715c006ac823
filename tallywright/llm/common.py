"""What the operators share: the folder all executors see, and stored intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.sources import new_folder

# The words of every operator here: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


_kept_by: dict[str, dict] = {}


def kept_in_worker(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task, such as a tokenizer and what it has met.

    Workers are used by one operator after the other; a task of another one has
    them forget it, so that a worker never holds the memories of two.
    """
    for other, kept in _kept_by.items():
        if other != owner and kept:
            kept.clear()
            gc.collect()  # a tokenizer and its memory refer to each other
    give_back()
    return _kept_by.setdefault(owner, {})


def give_back() -> None:
    """Returns what Arrow and the C library hold on to, but nothing uses, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a task's batches, after which the worker gives back the memory they took.

    It may wait long for its next task.
    """

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Functions that run in tasks are pickled by name, so workers must be able to
    import them wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="run-"), "tallywright_package.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def new_table_path(spark: SparkSession, name: str) -> str:
    return new_folder(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again.

    Cuts the lineage: a lost executor costs its running tasks, not this table.
    """
    return stored_at(df, new_table_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a path of its own, from `new_table_path`, to be deleted by `forget`."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that `stored_at` wrote and nothing will read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Has Spark delete shuffle files that nothing refers to any more, as it does when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def hidden(name: str) -> str:
    """A column name of the operators' own, which no input is expected to carry."""
    return f"__tw_{name}"


def word_count(text: Column) -> Column:
    """Number of words; NULL counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered_repeats(df: DataFrame, key: Column, number: str) -> DataFrame:
    """`df` with `number`: 0, 1, … among the rows alike in `key`, 0 for a row that is alone.

    Only rows that have others like them are numbered. They are counted per task
    of the scan and key, so a key that a large part of the rows share is spread
    over as many groups as there are tasks; which row gets which number depends
    on the layout, which numbers there are does not. `df` must give the same rows
    in the same tasks each time, as scans of files do.
    """
    own, part, place = hidden("repeat_key"), hidden("repeat_part"), hidden("repeat_place")
    keyed = df.withColumn(own, key)
    counted = stored(keyed.groupBy(own).agg(F.count("*").alias("n")).where("n > 1").select(own), "repeated_keys")
    if counted.isEmpty():
        return df.withColumn(number, F.lit(0).cast("bigint"))
    placed = keyed.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()})
    many = placed.join(counted, own, "left_semi")
    in_part = Window.partitionBy(own, part).orderBy(place)
    before = Window.partitionBy(own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # A row per key and task of the scan.
    first = many.groupBy(own, part).agg(F.count("*").alias("n")).select(
        own, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(hidden("repeat_first"))
    )
    local = many.withColumn(number, F.row_number().over(in_part) - 1).join(first, [own, part])
    many = local.withColumn(number, (F.col(number) + F.col(hidden("repeat_first"))).cast("bigint"))
    alone = placed.join(counted, own, "left_anti").withColumn(number, F.lit(0).cast("bigint"))
    names = [*[col(name) for name in df.columns], F.col(number)]
    return alone.select(*names).unionAll(many.select(*names))
