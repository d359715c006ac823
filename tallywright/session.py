"""A session with the settings the results rely on."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

# Set for every session. The number of shuffle partitions depends on the data:
# see `shuffle_partitions`. Partitions are merged up to 16 MB only: the rows are
# narrow, and at Spark's 64 MB the hash maps of a task outgrow the processor's
# caches, which made large groupings a quarter slower.
#
# A side of a join is broadcast only once its shuffle has been measured; beyond
# the limit the join sorts and merges, and spills. The estimate made before
# execution rests on compressed file sizes, and a few megabytes of Parquet can
# hold a hundred million keys. Hash joins within a task are left off as well:
# they save the sort, but cannot spill when memory is short.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.ui.enabled": "false",
}


PARTITION_BYTES = 64 * 1024**2
FEWEST_PARTITIONS = 200
# Enough for 256 GB in one shuffle; beyond that, give `shuffled_bytes`.
MANY_PARTITIONS = 4096
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shuffle_partitions(shuffled_bytes: int) -> int:
    """Partitions for a shuffle of this size, small enough to be held in memory.

    Adaptive execution merges partitions but does not split those of an
    aggregation, so the number must suit the largest shuffle; too many cost
    little. A count or a sum shuffles about 30 bytes per task and group, and at
    most per input row.
    """
    return max(FEWEST_PARTITIONS, math.ceil(shuffled_bytes / PARTITION_BYTES))


def default_partitions(shuffled_bytes: int | None, settings: dict[str, str]) -> dict[str, str]:
    """The setting that decides on the number of shuffle partitions."""
    if shuffled_bytes is not None:
        return {"spark.sql.shuffle.partitions": str(shuffle_partitions(shuffled_bytes))}
    if {"spark.sql.shuffle.partitions", INITIAL_PARTITIONS} & settings.keys():
        return {}
    return {INITIAL_PARTITIONS: str(MANY_PARTITIONS)}


def build_session(
    app_name: str = "tallywright",
    master: str | None = None,
    settings: dict[str, str] | None = None,
    shuffled_bytes: int | None = None,
) -> SparkSession:
    """Session for the reports; `settings` adds to or overrides the above.

    With `shuffled_bytes`, the size of the largest shuffle expected, the number
    of shuffle partitions is set for it. Otherwise, and unless `settings` has a
    number, shuffles start with many partitions and adaptive execution merges
    those that turn out small.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    sized = default_partitions(shuffled_bytes, settings or {})
    for key, value in {**SETTINGS, **sized, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
