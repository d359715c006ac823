from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallywright.llm import mixing, queries
from tallywright.llm.common import word_count
from tests.llm.helpers import edge_documents, no_documents, words

SF_DIR = "/root/testdata/sf0.01"


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Shares by weight, stopping at the cap, the excess shared again until none is above."""
    names = sorted((name for name in sizes if name is not None)) + [None] * (None in sizes)
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [name for name in names if name not in capped]
        spare = total - sum(cap * sizes[name] for name in capped)
        share = {name: spare * weight[name] / sum(weight[n] for n in free) for name in free}
        above = {name for name in free if share[name] > cap * sizes[name]}
        if not above:
            return {**share, **{name: cap * sizes[name] for name in capped}}
        capped |= above


def check(rows, near):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for row in rows:
        sizes[row["source"]] += row["size"]
        taken[row["source"]] += row["taken"]
        target[row["source"]] = row["target"]
        assert row["taken"] == row["copies"] * row["size"] <= 3 * row["size"]
    expected = targets(sizes)
    for row in rows:
        assert row["source_size"] == sizes[row["source"]]
    for source, size in sizes.items():
        assert target[source] == pytest.approx(expected[source], rel=1e-9, abs=1e-9)
        assert abs(taken[source] - expected[source]) <= max(near * expected[source], 1)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op7_entropy_mix(spark, SF_DIR).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(words(text)) for i, text in texts.items()}
    assert len(rows) == len(texts)
    check(rows, near=0.01)
    assert sorted(rows) == sorted(queries.op7_entropy_mix(spark, SF_DIR).collect())


def test_rates_are_tilted_by_size_and_meet_the_target(spark):
    sizes = spark.createDataFrame([("a", 10, 50), ("a", 40, 20), ("b", 5, 30), ("b", 90, 1)], "source string, size bigint, n bigint")
    plan = mixing.solve(sizes)
    rated = sizes.join(plan, "source").withColumn("rate", mixing._rate(F.col("size"), 3))
    for row in rated.groupBy("source", "target").agg(F.sum(F.expr("rate * size * n")).alias("sum")).collect():
        assert row["sum"] == pytest.approx(row["target"], rel=1e-6)


def test_one_source_holds_a_third_and_most_are_small(spark):
    rows = spark.range(6000).selectExpr(
        "id AS doc_id",
        "IF(id % 3 = 0, 'hot', CONCAT('s', id % 37)) AS source",
        "CAST(1 + pmod(xxhash64(id), 50) * pmod(xxhash64(id, 1), 9) AS BIGINT) AS words",
    )
    check(mixing.mix(rows, "source", F.col("words"), ["doc_id"]).collect(), near=0.001)


def test_rows_alike_meet_the_target(spark):
    """A third of a source's rows are one row, and all of another's; reruns and layouts agree."""
    rows = spark.range(0, 9000, 1, 5).selectExpr(
        "IF(id % 3 = 0 OR id % 2 = 0, NULL, id) AS doc_id",
        "IF(id % 2 = 0, 'alike', 'mixed') AS source",
        "CAST(IF(id % 3 = 0 OR id % 2 = 0, 10, 5 + id % 9) AS BIGINT) AS words",
    )
    mixed = mixing.mix(rows, "source", F.col("words"), ["doc_id"]).collect()
    check(mixed, near=0.01)
    again = mixing.mix(rows.coalesce(2), "source", F.col("words"), ["doc_id"]).collect()
    assert sorted(map(repr, mixed)) == sorted(map(repr, again))


def test_odd_and_empty_tables(spark):
    frame = edge_documents(spark, extra=True)
    rows = mixing.mix(frame, "source", word_count(F.col("text")), ["doc_id", "text"]).collect()
    assert len(rows) == frame.count()
    for row in rows:
        assert row["size"] == len(words(row["text"]))
        assert row["taken"] <= 3 * row["size"]
    assert mixing.mix(no_documents(spark), "source", word_count(F.col("text")), ["doc_id"]).collect() == []


def test_sources_without_words(spark):
    frame = spark.createDataFrame([(1, "a", 0), (2, None, 0), (3, "b", None)], "doc_id bigint, source string, words bigint")
    rows = mixing.mix(frame, "source", F.col("words"), ["doc_id"]).collect()
    assert {(r["target"], r["taken"], r["copies"]) for r in rows} == {(0.0, 0, 0)}


def test_no_python_in_the_plan(spark, capsys):
    queries.op7_entropy_mix(spark, SF_DIR).explain()
    assert "Python" not in capsys.readouterr().out
