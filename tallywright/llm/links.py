"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import forget, new_table_path, stored_at


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` for every end of an edge (`a`, `b`); the root is the smallest node reachable.

    Alternates two steps until nothing changes: every larger neighbour is linked
    to a node's smallest neighbour, then every smaller one is. Each step is a
    minimum per node and a join with it; no node's neighbours are gathered, so a
    node with very many costs no more per edge than any other.
    """
    spark = edges.sparkSession
    first = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    path = new_table_path(spark, "links")
    current = stored_at(first, path)
    mark = _mark(current)
    while mark[0]:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        larger = (
            both.join(least, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        smallest = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(smallest, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = smaller.unionAll(smallest.select("a", F.col("m").alias("b"))).distinct()
        before, path = path, new_table_path(spark, "links")
        current = stored_at(after, path)
        forget(spark, before)
        before, mark = mark, _mark(current)
        if mark == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def _mark(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    row = edges.agg(F.count("*").alias("n"), digest.alias("digest")).first()
    return row["n"], row["digest"]
