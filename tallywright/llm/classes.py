"""Classes of texts with equal shingle sets: their identity, and the groups that links make of them."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import stored
from tallywright.llm.links import components

# Ids a task remembers, so that it sends the same set once; they are forgotten
# beyond that, and the set is sent again.
SEEN_LIMIT = 100_000


def digest(shingles: np.ndarray) -> bytes:
    """Identity of a set: 128 bits over its shingles in order."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def short(fp: bytes) -> int:
    """The first 64 bits of an identity, signed: enough to meet by, not to be told apart by."""
    return int.from_bytes(fp[:8], "big", signed=True)


def short_column(fp: str = "fp") -> Column:
    """The same of a binary column."""
    return F.conv(F.hex(F.substring(fp, 1, 8)), 16, -10).cast("bigint")


# A class as one number: the smallest id it is known by, then bits of its
# identity. Classes without any id come after all others. The smallest number of
# a group therefore tells the smallest id of the group.
NODE = "decimal(38,0)"
_UNIT = Decimal(1 << 62)
_NO_ID = Decimal(1 << 63)


def _node(least: Column, owner: Column) -> Column:
    known = F.coalesce(least.cast("decimal(20,0)"), F.lit(_NO_ID).cast("decimal(20,0)"))
    return (known * F.lit(_UNIT).cast("decimal(19,0)") + F.shiftrightunsigned(owner, 2)).cast(NODE)


def _least_id(node: Column) -> Column:
    unit = F.lit(_UNIT).cast("decimal(19,0)")
    known = ((node - F.pmod(node, unit)) / unit).cast("decimal(20,0)")
    return F.when(known < F.lit(_NO_ID).cast("decimal(20,0)"), known.cast("bigint"))


def classes_of(rows: DataFrame, name: str) -> DataFrame:
    """`fp`, `owner`, `least` (smallest id), `n`, `node` of every class in rows of `doc_id`, `n`, `fp`; stored."""
    found = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"))
    numbered = found.withColumn("owner", short_column())
    return stored(numbered.withColumn("node", _node(F.col("least"), F.col("owner"))), name)


def groups_of(rows: DataFrame, classes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """`rows` (`doc_id`, `fp`, others) with `component_id`, `root` and `first`, from links (`a`, `b`) between identities.

    The smallest id of a group comes with its smallest number, so no row is ever
    dealt by its group: rows meet their class, and classes their own number. `root`
    tells groups apart, and `first` is true in the class that has the smallest
    number. Rows without an identity are groups of their own, with no root.
    """
    numbers = classes.select("fp", "node")
    numbered = (
        pairs.join(numbers.select(F.col("fp").alias("a"), F.col("node").alias("node_a")), "a")
        .join(numbers.select(F.col("fp").alias("b"), F.col("node").alias("node_b")), "b")
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    )
    grouped = components(numbered).select("node", "root")
    known = classes.join(grouped, "node", "left").select("fp", "node", F.coalesce("root", "node").alias("root"))
    named = stored(
        known.select("fp", _least_id(F.col("root")).alias("component_id"), "root", (F.col("node") == F.col("root")).alias("first")),
        name,
    )
    result = [*rows.columns, "component_id", "root", "first"]
    linked = rows.where("fp is not null").join(named, "fp").select(*result)
    alone = rows.where("fp is null").select(
        *rows.columns, F.col("doc_id").alias("component_id"), F.lit(None).cast(NODE).alias("root"), F.lit(True).alias("first")
    )
    return linked.unionAll(alone)
