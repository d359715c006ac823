from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import ann, queries

SF_DIR = "/root/testdata/sf0.1"
SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, queries_, k=10):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for query in queries_:
        far = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(1))
        order = [at for at in np.lexsort((ids, far)) if ids[at] != query][:k]
        out[query] = [(int(ids[at]), float(far[at])) for at in order]
    return out


def found(frame):
    out = {}
    for row in sorted(frame.collect(), key=lambda row: (row["query_id"], row["rank"])):
        out.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
        assert row["rank"] == len(out[row["query_id"]])
    return out


def recall(got, expected):
    both = sum(len({i for i, _ in got[query]} & {i for i, _ in near}) for query, near in expected.items())
    return both / sum(map(len, expected.values()))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = found(queries.op10_dimension_scan(spark, SF_DIR))
    expected = brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert got.keys() == expected.keys()
    assert recall(got, expected) >= 0.9


def test_sample_smaller_than_the_table(spark):
    """Centroids and first thresholds from a few rows; the rest must come from the lists."""
    random = np.random.default_rng(4)
    rows = [(i, random.standard_normal(24).tolist()) for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index = ann.build(frame, training_rows=300)
    got = found(ann.search(index, frame.where("vec_id % 100 = 0")))
    expected = brute(rows, range(0, 4000, 100))
    assert all(len(near) == 10 for near in got.values())
    assert recall(got, expected) >= 0.9
    for query, near in got.items():
        exact = dict(brute([r for r in rows if r[0] in {query, *(i for i, _ in near)}], [query])[query])
        assert all(score == pytest.approx(exact[i], abs=1e-12) for i, score in near)


def test_third_of_the_rows_are_one_vector(spark, monkeypatch):
    """Ties go to the smallest ids, though the list is scanned in parts."""
    monkeypatch.setattr(ann, "CHUNK", 64)
    random = np.random.default_rng(5)
    rows = [(i, [1.0] * 16 if i % 3 == 0 else random.standard_normal(16).tolist()) for i in range(900)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = found(ann.search(ann.build(frame), frame.where("vec_id % 100 = 0")))
    assert got[0] == [(3 * at, 0.0) for at in range(1, 11)]
    assert got[300] == [(3 * at, 0.0) for at in range(10)]


def test_copies_beyond_the_sample(spark):
    """The first threshold is 0, as the sample holds ten copies; the smallest ids are outside of it."""
    random = np.random.default_rng(6)
    copy = random.standard_normal(64).tolist()
    rows = [(i, copy if i % 3 == 0 else random.standard_normal(64).tolist()) for i in range(6000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = found(ann.search(ann.build(frame, training_rows=300), frame.where("vec_id % 1500 = 0")))
    assert got == {query: [(3 * at, 0.0) for at in range(11) if 3 * at != query][:10] for query in (0, 1500, 3000, 4500)}


def test_all_rows_come_from_the_scan(spark, monkeypatch):
    """On a table as small as the sample once was, where the rows found are those of the scan, too."""
    random = np.random.default_rng(7)
    rows = [(i, random.standard_normal(24).tolist()) for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index = ann.build(frame)
    assert len(index.sample) <= len(rows) / 10
    monkeypatch.setattr(ann, "LEAST_PROBED", 1)
    got = found(ann.search(index, frame.where("vec_id % 100 = 0"), probed=0.01))
    assert all(len(near) == 10 for near in got.values())
    monkeypatch.setattr(ann, "nearest_in", lambda ids, *_: (ids[:0], np.zeros(0)))
    assert ann.search(index, frame.where("vec_id % 100 = 0")).collect() == []


def test_clusters_are_scanned_in_small_part_without_loss(spark):
    """At most a fifth of the vectors, with the lists left out for their radius alone, and more copies of the hot list."""
    random = np.random.default_rng(9)
    centers = 10 * random.standard_normal((60, 24))
    which = np.where(random.random(20_000) < 0.33, 0, random.integers(0, 60, 20_000))
    vectors = centers[which] + random.standard_normal((20_000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index, wanted = ann.build(frame), frame.where("vec_id % 100 = 0")
    probes = ann.probed_lists(index, wanted, 10, "vec_id", "embedding", 1.0).select("list").collect()
    scanned = sum(int(index.sizes[row["list"]]) for row in probes) / 200 / 20_000
    assert scanned <= 0.2
    assert recall(found(ann.search(index, wanted)), brute(rows, range(0, 20_000, 100))) >= 0.9


@pytest.mark.parametrize("parts", [1, 3])
def test_lists_left_out_lose_nothing(spark, monkeypatch, parts):
    """All lists probed and no candidate abandoned by the test: what is found is exact, however queries are split."""
    monkeypatch.setattr(ann, "QUERY_CHUNK", 1000 if parts == 1 else 2)
    random = np.random.default_rng(10)
    rows = [(i, (5.0 * (i % 7) + random.standard_normal(8)).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index = ann.build(frame)
    probes = ann.probed_lists(index, frame.where("vec_id % 100 = 0"), 10, "vec_id", "embedding", 1.0)
    near = {}
    lists = {r["vec_id"]: r["list"] for r in spark.read.parquet(index.path).select("vec_id", "list").collect()}
    for row in probes.collect():
        near.setdefault(row["query_id"], set()).add(row["list"])
    expected = brute(rows, range(0, 3000, 100))
    for query, best in expected.items():
        assert {lists[i] for i, _ in best} <= near[query]
    assert sum(map(len, near.values())) < len(near) * len(index.centroids)
    assert recall(found(ann.search(index, frame.where("vec_id % 100 = 0"))), expected) >= 0.9


def test_fewer_than_ten(spark):
    rows = [(100 * i, [float(i), 1.0]) for i in range(4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(ann.search(ann.build(frame), frame)) == brute(rows, [0, 100, 200, 300])


def test_unusable_rows_take_no_part(spark):
    good = [(i, [float(i % 7), float(i), 1.0]) for i in range(50)]
    bad = [
        (1000, None),
        (1100, []),
        (1200, [0.0, 0.0, 0.0]),
        (1300, [1.0, None, 2.0]),
        (1400, [float("nan"), 1.0, 1.0]),
        (1500, [float("inf"), 1.0, 1.0]),
        (1600, [1.0, 2.0]),
        (None, [1.0, 2.0, 3.0]),
    ]
    frame = spark.createDataFrame(good + bad, SCHEMA).withColumn("list", F.lit(1)).withColumn("score", F.lit(2))
    assert found(ann.search(ann.build(frame), frame.where("vec_id % 10 = 0"))) == brute(good, range(0, 50, 10))


def test_nothing_usable(spark):
    frame = spark.createDataFrame([(0, None), (1, [0.0])], SCHEMA)
    assert ann.search(ann.build(frame), frame).collect() == []
    assert ann.search(ann.build(frame.limit(0)), frame.limit(0)).collect() == []
