"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are dealt to lists by their nearest centroid. They are rotated at random,
so that the first dimensions of a difference tell about as much of its length as
any others, and stored in column blocks of some dimensions each. A query scans
the lists nearest to it: block by block, the distance so far is scaled up to all
dimensions, and a candidate is abandoned as soon as a test on that estimate says
it is farther than the k-th nearest so far. What is left after the last block is
measured exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import col, new_table_path, ship_package

TRAINING_ROWS = 16_384
MOST_LISTS = 4096
PROBED = 0.6
LEAST_PROBED = 32
BLOCK_DIMS = 16
CHUNK = 8192
QUERY_CHUNK = 2048
CONFIDENCE = 2.1
MOST_SAMPLED = 4096
SAMPLED_OF = 16
# Rounding of the rotation, as a part of the query's squared length: copies of a query are never abandoned.
ROUNDING = 1e-9
# Rounding of distances, as a part of them, where a list is left out for its radius.
BOUND = 1e-9
SEED = 11


def usable(vector: Column, dims: int | None = None) -> Column:
    """Not NULL, not zero, every component finite, and of the given length."""
    numbers = vector.cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vector.isNotNull() & finite & F.exists(numbers, lambda x: x != 0)
    if dims is not None:
        ok = ok & (F.size(vector) == dims)
    return F.coalesce(ok, F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


@dataclass(frozen=True)
class Index:
    """What fits in memory: centroids, list sizes, rotation, and a sample, with its lists, for first thresholds."""

    path: str
    dims: int
    centroids: np.ndarray
    rotation: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    sample_lists: np.ndarray

    @property
    def chunks(self) -> np.ndarray:
        """In how many parts each list is scanned."""
        return np.maximum(1, -(-self.sizes // CHUNK))


def _kmeans(rows: np.ndarray, lists: int, steps: int = 12) -> np.ndarray:
    random = np.random.default_rng(SEED)
    rows = np.unique(rows, axis=0)
    centroids = rows[random.permutation(len(rows))[:lists]]
    for _ in range(steps):
        nearest = _nearest(rows, centroids, 1)[:, 0]
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
    return centroids


def _nearest(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    out = np.empty((len(rows), n), np.int64)
    squares = (centroids**2).sum(1)
    for at in range(0, len(rows), 1024):
        far = squares - 2 * rows[at : at + 1024] @ centroids.T
        out[at : at + 1024] = far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
    return out


def build(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", training_rows: int = TRAINING_ROWS) -> Index | None:
    """Writes an index of every usable vector; None if there is none.

    Only the centroids are fitted on a sample of about `training_rows` rows,
    picked by a hash of the id. Rows without an id, unusable vectors, and those
    of another length than the most frequent take no part. There are about as
    many lists as the square root of the number of rows, `MOST_LISTS` at most.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(col(vec_id).cast("bigint").alias("vec_id"), col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not lengths:
        return None
    dims, total = lengths[0]["dims"], lengths[0]["count"]
    rows = rows.where(F.size("vector") == dims)
    share = min(1 << 30, int(training_rows / total * (1 << 30)) + 1)
    picked = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 30)) < share).limit(2 * training_rows).toArrow()
    ids = picked.column("vec_id").to_numpy()
    if not len(ids):
        picked = rows.limit(training_rows).toArrow()
        ids = picked.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    sample = _matrix(picked.column("vector").combine_chunks(), dims)[order]
    lists = max(1, min(MOST_LISTS, round(total**0.5), len(sample)))
    centroids = _kmeans(sample, lists)
    rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))[0]
    path = new_table_path(spark, "vector_index")
    shipped = spark.sparkContext.broadcast((dims, centroids, rotation))
    blocks = ", ".join(f"b{at} binary" for at in range(0, dims, BLOCK_DIMS))
    rows.mapInArrow(_assign(shipped), f"list int, far double, vec_id bigint, vector binary, {blocks}").write.parquet(path)
    sizes, radii = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    per_list = spark.read.parquet(path).groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    for row in per_list.collect():  # one per list
        sizes[row["list"]], radii[row["list"]] = row["n"], row["radius"]
    # A small part of the table, with the lists as they were written.
    keep = slice(0, min(MOST_SAMPLED, total // SAMPLED_OF))
    kept = spark.createDataFrame([(at,) for at in sorted(set(ids[order][keep].tolist()))], "vec_id bigint")
    known = spark.read.parquet(path).select("list", "vec_id", "vector").join(F.broadcast(kept), "vec_id").toArrow()
    known = known.sort_by([("vec_id", "ascending"), ("list", "ascending")])
    sample_ids, once = np.unique(known.column("vec_id").to_numpy(), return_index=True)
    sample, sample_lists = _stack(known.column("vector"), dims)[once], known.column("list").to_numpy()[once]
    return Index(path, dims, centroids, rotation, sizes, radii, sample_ids, sample, sample_lists)


def _assign(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, centroids, rotation = shipped.value
        for batch in batches:
            vectors = _matrix(batch.column("vector"), dims)
            rotated = vectors @ rotation
            nearest = _nearest(vectors, centroids, 1)[:, 0]
            columns = [
                pa.array(nearest, pa.int32()),
                pa.array(np.sqrt(((vectors - centroids[nearest]) ** 2).sum(1)), pa.float64()),
                batch.column("vec_id"),
                pa.array([row.tobytes() for row in vectors], pa.binary()),
            ]
            names = ["list", "far", "vec_id", "vector"]
            for at in range(0, dims, BLOCK_DIMS):
                part = np.ascontiguousarray(rotated[:, at : at + BLOCK_DIMS])
                columns.append(pa.array([row.tobytes() for row in part], pa.binary()))
                names.append(f"b{at}")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _probe(shipped, k: int, probed: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query the lists to scan, a distance within which k vectors are known to lie, and these."""
        index: Index = shipped.value
        lists = len(index.centroids)
        wanted = min(lists, max(LEAST_PROBED, int(np.ceil(probed * lists))))
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"), index.dims)
            order = _nearest(vectors, index.centroids, lists)
            out: list[tuple] = []
            for query, vector, near in zip(ids.tolist(), vectors, order):
                others = np.flatnonzero(index.sample_ids != query)
                far = np.sqrt(((index.sample[others] - vector) ** 2).sum(1))
                first = np.argsort(far, kind="stable")[:k]
                within, known = float("inf"), others[:0]
                if len(first) == k:
                    within, known = float(far[first[-1]]), others[first]
                # At least so many lists, enough for k other vectors, and those of the vectors known.
                enough = int(np.searchsorted(np.cumsum(index.sizes[near]), k + 1)) + 1
                chosen = near[: max(wanted, enough)]
                # All of a list is farther than k known vectors if its centroid is by more than its radius.
                apart = np.sqrt(((index.centroids[chosen] - vector) ** 2).sum(1)) - index.radii[chosen]
                probes = chosen[apart <= within + BOUND * (within + np.sqrt(vector @ vector))].tolist()
                probes += sorted(set(index.sample_lists[known].tolist()) - set(probes))
                out += [(at, query, vector.tobytes(), within, index.sample_ids[known].tolist()) for at in probes]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row[0] for row in out], pa.int32()),
                    pa.array([row[1] for row in out], pa.int64()),
                    pa.array([row[2] for row in out], pa.binary()),
                    pa.array([row[3] for row in out], pa.float64()),
                    pa.array([row[4] for row in out], pa.list_(pa.int64())),
                ],
                names=["list", "query_id", "query", "within", "known"],
            )

    return run


def _stack(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _scan(shipped, k: int):
    def run(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        rotation, dims = shipped.value
        found: list[tuple[int, int, float]] = []
        if candidates.num_rows and queries.num_rows:
            ids = candidates.column("vec_id").to_numpy()
            vectors = _stack(candidates.column("vector"), dims)
            blocks = [
                (at, _stack(candidates.column(f"b{at}"), min(BLOCK_DIMS, dims - at))) for at in range(0, dims, BLOCK_DIMS)
            ]
            wanted = ("query_id", "query", "within", "known")
            for query_id, raw, within, known in zip(*(queries.column(name).to_pylist() for name in wanted)):
                query = np.frombuffer(raw, np.float64)
                near, far = nearest_in(ids, vectors, blocks, query_id, query, query @ rotation, within, known, k)
                found += [(query_id, int(i), float(d)) for i, d in zip(near, far)]
        return pa.table(
            {
                "query_id": pa.array([row[0] for row in found], pa.int64()),
                "vec_id": pa.array([row[1] for row in found], pa.int64()),
                "score": pa.array([row[2] for row in found], pa.float64()),
            }
        )

    return run


def nearest_in(ids, vectors, blocks, query_id, query, rotated, within, known, k) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the candidates within `within`, by distance, then id.

    The ids in `known`, which gave that threshold, are never abandoned: without
    them there might be fewer than k in all parts together.
    """
    dims = len(query)
    rounding = ROUNDING * float(query @ query)
    alive = np.flatnonzero(ids != query_id)
    partial = np.zeros(len(alive))
    kept = np.isin(ids, known)
    for at, block in blocks:
        seen = at + block.shape[1]
        partial = partial + ((block[alive] - rotated[at:seen]) ** 2).sum(1)
        slack = 1 + CONFIDENCE / np.sqrt(seen) if seen < dims else 1 + 1e-9
        if seen < dims and np.isinf(within) and len(alive) > k:
            # Without a threshold yet, the k that look nearest give one.
            first = alive[np.argpartition(partial, k - 1)[:k]]
            within = float(np.sqrt(((vectors[first] - query) ** 2).sum(1).max()))
            kept[first] = True
        stays = kept[alive] | (partial * (dims / seen) <= (within * slack) ** 2 + rounding)
        alive, partial = alive[stays], partial[stays]
    distances = np.sqrt(((vectors[alive] - query) ** 2).sum(1))
    order = np.lexsort((ids[alive], distances))[:k]
    return ids[alive][order], distances[order]


def probed_lists(index: Index, queries: DataFrame, k: int, vec_id: str, vector: str, probed: float = PROBED) -> DataFrame:
    """A row per usable query and list to scan, with a distance within which k vectors, whose ids follow, lie."""
    wanted = queries.select(col(vec_id).cast("bigint").alias("vec_id"), col(vector).cast("array<double>").alias("vector"))
    wanted = wanted.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), index.dims))
    schema = "list int, query_id bigint, query binary, within double, known array<bigint>"
    return wanted.mapInArrow(_probe(queries.sparkSession.sparkContext.broadcast(index), k, probed), schema)


def search(index: Index | None, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", probed: float = PROBED) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` of the k nearest found to every usable query, itself left out.

    Ties go to the smaller id. The k nearest of the sample give the first threshold,
    within which k vectors are known to lie; all rows come from the scan. Each query
    scans `probed` of the lists, at least `LEAST_PROBED`, more if these hold fewer
    than k other vectors, and the lists of the vectors known to lie near. Of these,
    lists all of whose vectors are farther than k known ones, by the triangle
    inequality, are left out, which loses nothing: most of them where vectors form
    clusters. Large lists are scanned in parts, by hash of the vector's id, and so are
    many queries of one list, for which alone its rows are sent more than once; rows
    of lists without queries are not sent. Every part gives k candidates at most,
    whose best are the result.
    """
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    ship_package(spark)
    probes = probed_lists(index, queries, k, vec_id, vector, probed)
    asked = np.zeros(len(index.centroids), np.int64)
    for row in probes.groupBy("list").count().collect():  # one per list
        asked[row["list"]] = row["count"]

    def by_list(numbers: np.ndarray) -> Column:
        return F.get(F.split(F.lit(",".join(map(str, numbers.tolist()))), ","), F.col("list")).cast("int")

    chunks, parts = by_list(index.chunks), by_list(-(-asked // (4 * QUERY_CHUNK)))
    candidates = (
        spark.read.parquet(index.path)
        .drop("far")
        .withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks).cast("int"))
        .withColumn("parts", parts)
        .where("parts > 0")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .drop("parts")
    )
    dealt = probes.withColumn("part", F.pmod(F.xxhash64("query_id"), parts).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), chunks - 1))
    )
    key = ["list", "chunk", "part"]
    rotated = spark.sparkContext.broadcast((index.rotation, index.dims))
    found = (
        candidates.groupBy(*key)
        .cogroup(dealt.groupBy(*key))
        .applyInArrow(_scan(rotated, k), "query_id bigint, vec_id bigint, score double")
    )
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # ids may be repeated
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
