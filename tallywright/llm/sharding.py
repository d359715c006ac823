"""Shards by fixed virtual slots, in DataFrame expressions only.

A row's hash picks one of a few thousand slots, for good. Bytes and rows are
added up per slot, and a small table maps slots to shards. Balancing edits that
table: it moves slots, never rows of a slot, and stores the edited table as a
new version beside the old ones. The table has one row per slot however large
the data are, so planning it on the driver and broadcasting it is bounded.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import col, hidden, new_table_path, numbered_repeats, stored

SLOTS = 4096
TOLERANCE = 0.0005


def slot_of(cols: Sequence[Column], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1, before anything is known of the data."""
    return [slot % shards for slot in range(slots)]


def rebalanced(shard_of: Sequence[int], weight: Sequence[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The map after moves from the heaviest to the lightest shard, until they are near equal or no move helps."""
    edited = list(shard_of)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(edited):
        load[shard] += weight[slot]
        if weight[slot]:
            insort(held[shard], (weight[slot], slot))
    near = tolerance * sum(load) / shards
    while True:
        heavy, light = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[heavy] - load[light]
        at = bisect_left(held[heavy], (gap // 2 + 1, -1))
        # The slots next to half the gap, below and above.
        choices = [k for k in (at - 1, at) if 0 <= k < len(held[heavy]) and held[heavy][k][0] < gap]
        if gap <= near or not choices:
            return edited
        moved = held[heavy].pop(min(choices, key=lambda k: abs(gap - 2 * held[heavy][k][0])))
        insort(held[light], moved)
        load[heavy] -= moved[0]
        load[light] += moved[0]
        edited[moved[1]] = light


def write_map(spark: SparkSession, path: str, version: int, shard_of: Sequence[int], stats: DataFrame) -> None:
    """Stores one version: slot, shard, bytes, rows, and the place of the slot's first row in its shard."""
    listed = F.split(F.lit(",".join(map(str, shard_of))), ",")
    slots = spark.range(len(shard_of)).select(
        F.col("id").cast("int").alias("slot"), F.get(listed, F.col("id").cast("int")).cast("int").alias("shard")
    )
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    known = slots.join(stats, "slot", "left").fillna(0, ["bytes", "rows"])
    known.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).coalesce(1).write.parquet(
        f"{path}/version={version}"
    )


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def shard_by_bytes(
    df: DataFrame, key: Sequence[str], size: str, shards: int, slots: int = SLOTS, path: str | None = None
) -> DataFrame:
    """`df` with `shard` and `slot`, the row's place in its shard, such that shards are near equal in `size`.

    `key` are the columns whose hash picks the virtual slot (kept as
    `virtual_slot`); rows alike in all of them are numbered, and their number is
    hashed as well, so that any number of them is spread. NULLs are hashed like
    any value, and a NULL size weighs nothing. Places count from 0 without gaps
    and follow the key within a slot. An empty table gives no rows. Input
    columns called like the new ones are replaced.
    """
    spark = df.sparkSession
    path = path or new_table_path(spark, "slot_map")
    at, first = hidden("virtual_slot"), hidden("first")
    # Rows alike are told apart by a number, or they would all lie in one slot.
    repeat, cols = hidden("repeat"), [col(name) for name in key]
    numbered = numbered_repeats(df, F.xxhash64(*cols), repeat)
    slot = F.when(F.col(repeat) == 0, slot_of(cols, slots)).otherwise(slot_of([*cols, F.col(repeat)], slots))
    slotted = stored(numbered.withColumn(at, slot).drop(repeat), "slotted")
    stats = slotted.groupBy(F.col(at).alias("slot")).agg(
        F.coalesce(F.sum(col(size)), F.lit(0)).alias("bytes"), F.count("*").alias("rows")
    )
    stats = stored(stats, "slot_sizes")
    weight = [0] * slots
    for row in stats.collect():  # one row per slot at most
        weight[row["slot"]] = row["bytes"]
    mapped = first_map(slots, shards)
    write_map(spark, path, 1, mapped, stats)
    write_map(spark, path, 2, rebalanced(mapped, weight, shards), stats)

    order = Window.partitionBy(at).orderBy(*[col(name).asc_nulls_first() for name in key])
    current = read_map(spark, path, 2).select(
        F.col("slot").alias(at), F.col("shard").alias(hidden("shard")), F.col("first").alias(first)
    )
    placed = slotted.withColumn(hidden("place"), F.row_number().over(order)).join(F.broadcast(current), at)
    return placed.withColumns(
        {
            "shard": F.col(hidden("shard")),
            "slot": F.col(first) + F.col(hidden("place")) - 1,
            "virtual_slot": F.col(at),
        }
    ).drop(at, first, hidden("shard"), hidden("place"))
