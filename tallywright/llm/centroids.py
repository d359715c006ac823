"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors become integers first, and are kept in blocks: per dimension the values
that occur in the block, in order, and for each vector the place of its value.
A round tabulates, for each dimension, the squared difference of every occurring
value to every centroid; a vector's distances are then gathered from the tables
and summed. The sums for the next centroids come from how often each value
occurs in a cluster. All of it is whole numbers, so the result does not depend
on how rows are dealt to tasks.

A task holds one block and its tables at a time: at most `BLOCK` values per
dimension, whatever the data. Only the centroids go to all tasks, and only one
sum per cluster and dimension comes back. Blocks are a stored table, so a lost
executor costs its tasks of the round at hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import col, ship_package, stored

DIMS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = "3:"
BLOCK = 4096

_BLOCKS = "ids array<bigint>, ends array<int>, occurring array<bigint>, places binary"
_RESULT = "vec_id bigint, cluster int, distance bigint"
WHOLE = pa.decimal128(38, 0)


def largest_value(dims: int) -> int:
    """Largest integer, either sign, for which no squared distance leaves 63 bits."""
    return int((2**61 // dims) ** 0.5)


@dataclass(frozen=True)
class Clustering:
    """Blocks of all kept vectors, centroids (cluster, dimension), and the last distances summed per cluster."""

    blocks: DataFrame
    centroids: np.ndarray
    inertias: list[int]


def usable(vectors: DataFrame, vec_id: str, embedding: str, dims: int) -> DataFrame:
    """`vec_id`, `embedding` as doubles of vectors with exactly `dims` components, none NULL or non-finite."""
    doubles = vectors.select(
        col(vec_id).cast("bigint").alias("vec_id"), col(embedding).cast("array<double>").alias("embedding")
    )
    # NULL and NaN, which Spark takes for larger than any number, fail the comparison.
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return doubles.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & finite)


def _blocks(dims: int, scale: int):
    def block(ids: pa.Array, rows: np.ndarray) -> tuple:
        occurring, places, ends = [], np.empty((dims, len(rows)), np.uint16), [0]
        for d in range(dims):
            values, places[d] = np.unique(rows[:, d], return_inverse=True)
            occurring.append(values)
            ends.append(ends[-1] + len(values))
        return ids.to_pylist(), ends, np.concatenate(occurring), places.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per block of vectors: the values that occur, and where each vector's are among them."""
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            scaled = np.floor(scale * flat.reshape(-1, dims))
            if len(scaled) and np.abs(scaled).max() > largest_value(dims):
                raise ValueError(f"a component times {scale} is beyond {largest_value(dims)}, where distances leave 64 bits")
            whole = scaled.astype(np.int64)
            made = [
                block(batch.column("vec_id").slice(at, BLOCK), whole[at : at + BLOCK]) for at in range(0, len(whole), BLOCK)
            ]
            if made:
                types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, kind) for part, kind in zip(zip(*made), types)],
                    names=["ids", "ends", "occurring", "places"],
                )

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, ends of each dimension's values, values, and places (dimension, vector) of one block after the other."""
    for batch in batches:
        for ids, ends, occurring, places in zip(*(batch.column(name) for name in ("ids", "ends", "occurring", "places"))):
            ends = ends.values.to_numpy()
            shape = (len(ends) - 1, len(ids.values))
            yield ids.values, ends, occurring.values.to_numpy(), np.frombuffer(places.as_py(), np.uint16).reshape(shape)


def nearest(ends: np.ndarray, occurring: np.ndarray, places: np.ndarray, centroids: np.ndarray):
    """Number of the nearest centroid, the smaller of equal ones, and the squared distance to it, per vector."""
    far = np.zeros((places.shape[1], len(centroids)), np.int64)
    for d, own in enumerate(places):
        table = (occurring[ends[d] : ends[d + 1], None] - centroids[None, :, d]) ** 2
        far += table[own]
    cluster = far.argmin(1)
    return cluster, far[np.arange(len(far)), cluster]


def _round(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per cluster of this task: sums of each dimension, number of vectors, sum of distances."""
        k, dims = centroids.shape
        sums, counts, inertias = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k
        for _, ends, occurring, places in _opened(batches):
            cluster, distance = nearest(ends, occurring, places, centroids)
            counts += np.bincount(cluster, minlength=k)
            for d, own in enumerate(places):
                values = occurring[ends[d] : ends[d + 1]]
                held = np.bincount(cluster * len(values) + own, minlength=k * len(values)).reshape(k, -1)
                sums[:, d] += held @ values
            for c in range(k):
                # In two halves, as distances of a block may add up to more than 63 bits.
                own = distance[cluster == c]
                inertias[c] += (int((own >> 31).sum()) << 31) + int((own & 0x7FFFFFFF).sum())
        parts = [[Decimal(int(x)) for x in (*sums[c], counts[c], inertias[c])] for c in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array(parts, pa.list_(WHOLE))], names=["cluster", "parts"]
        )

    return run


def _summed(blocks: DataFrame, centroids: np.ndarray) -> list[list[int]]:
    """Per cluster: sums of each dimension, number of vectors, sum of distances, over all blocks."""
    k, dims = centroids.shape
    parts = blocks.mapInArrow(_round(centroids), "cluster int, parts array<decimal(38,0)>")
    totals = parts.select("cluster", F.posexplode("parts").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("part"))
    out = [[0] * (dims + 2) for _ in range(k)]
    for cluster, at, total in totals.collect():  # clusters times dimensions, whatever the table
        out[cluster][at] = int(total)
    return out


def first_centroids(kept: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """The `k` vectors with the smallest digest of `seed` and id; vectors without an id come last, equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "embedding").limit(k).collect()
    return np.floor(scale * np.array([row["embedding"] for row in first], np.float64)).astype(np.int64)


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    dims: int = DIMS,
    scale: int = SCALE,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: str = SEED,
) -> Clustering:
    """Lloyd's rounds over floor(`scale` * component), in whole numbers throughout.

    Takes vectors with exactly `dims` components, none NULL or non-finite; others
    take no part. A NULL id is kept, but comes last when the first centroids are
    chosen. Repeated rows are vectors of their own. Fewer than `k` vectors give
    that many centroids; an empty table gives none. A component whose integer is
    so large that a distance could leave 63 bits raises an error.

    Rounds end early once no centroid moves, as later ones would not change anything.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kept = usable(vectors, vec_id, embedding, dims)
    blocks = stored(kept.mapInArrow(_blocks(dims, scale), _BLOCKS), "vector_blocks")
    centroids = first_centroids(kept, k, scale, seed)
    if not len(centroids):
        return Clustering(blocks, centroids.reshape(0, dims), [])
    for _ in range(rounds):
        totals = _summed(blocks, centroids)
        moved = np.array([[x // own[dims] for x in own[:dims]] if own[dims] else old for own, old in zip(totals, centroids.tolist())])
        settled, centroids = np.array_equal(moved, centroids), moved
        if settled:
            break
    return Clustering(blocks, centroids, [own[-1] for own in _summed(blocks, centroids)])


def assignments(spark: SparkSession, clustering: Clustering) -> DataFrame:
    """`vec_id`, `cluster`, `distance` (squared) of every kept vector."""
    centroids = clustering.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ends, occurring, places in _opened(batches):
            number, distance = nearest(ends, occurring, places, centroids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(number, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    if not len(centroids):
        return spark.createDataFrame([], _RESULT)
    return clustering.blocks.mapInArrow(run, _RESULT)


def described(spark: SparkSession, clustering: Clustering) -> DataFrame:
    """The assignments with the distances summed per cluster and overall, and a digest of the final centroid."""
    if max(clustering.inertias, default=0) >= 2**63 or sum(clustering.inertias) >= 2**63:
        raise ArithmeticError("the distances add up to more than a long holds")
    digests = [hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for own in clustering.centroids.tolist()]
    inertias = F.array(*[F.lit(x).cast("bigint") for x in clustering.inertias or [0]])
    return assignments(spark, clustering).select(
        "vec_id",
        "cluster",
        "distance",
        inertias[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(clustering.inertias)).cast("bigint").alias("inertia"),
        F.array(*[F.lit(x) for x in digests or [""]])[F.col("cluster")].alias("centroid_sha256"),
    )
