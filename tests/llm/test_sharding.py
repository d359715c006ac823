from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallywright.llm import queries, sharding
from tests.llm.helpers import edge_documents, no_documents

SF_DIR = "/root/testdata/sf0.01"


def test_moves_until_near_equal():
    weight = [(slot * 7919) % 1000 for slot in range(500)]
    first = sharding.first_map(500, 8)
    edited = sharding.rebalanced(first, weight, 8)
    load = [sum(w for w, s in zip(weight, edited) if s == shard) for shard in range(8)]
    assert max(load) - min(load) <= 0.01 * sum(load) / 8
    assert sum(a != b for a, b in zip(first, edited)) < 100  # an edit, not a new map


def test_one_slot_holding_most_stays_alone():
    edited = sharding.rebalanced(sharding.first_map(16, 4), [1000] + [10] * 15, 4)
    assert [shard for slot, shard in enumerate(edited) if slot and shard == edited[0]] == []


def test_query(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op2_slot_sharding(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    places, load = defaultdict(list), defaultdict(int)
    for row in rows:
        text = texts[row["doc_id"]]
        assert (row["size"], row["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        assert (row["law"], row["grown_shard"]) == ("bytes", None)
        places[row["shard"]].append(row["slot"])
        load[row["shard"]] += row["size"]
    assert sorted(load) == list(range(8))
    assert all(sorted(slots) == list(range(len(slots))) for slots in places.values())
    assert max(load.values()) <= 1.01 * min(load.values())
    assert rows == queries.op2_slot_sharding(spark, SF_DIR).collect() or sorted(rows) == sorted(
        queries.op2_slot_sharding(spark, SF_DIR).collect()
    )


def test_odd_and_empty_tables(spark):
    sized = edge_documents(spark, extra=True).withColumn("bytes", F.octet_length("text").cast("bigint"))
    rows = sharding.shard_by_bytes(sized, ["doc_id", "text"], "bytes", 3, slots=16).collect()
    assert len(rows) == sized.count()
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    empty = no_documents(spark).withColumn("bytes", F.lit(1).cast("bigint"))
    assert sharding.shard_by_bytes(empty, ["doc_id"], "bytes", 3).collect() == []


def test_rows_alike_are_spread(spark):
    """A third of the rows are one row, and some more repeat; shards are as equal as without."""
    alike = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.floor(F.col("id") / 4))
    docs = spark.range(0, 30_000, 1, 7).select(F.when(F.col("id") % 3 > 0, alike).alias("doc_id"), F.lit(5).cast("bigint").alias("bytes"))
    rows = sharding.shard_by_bytes(docs, ["doc_id", "bytes"], "bytes", 7).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 30_000 and max(sizes.values()) <= 1.01 * min(sizes.values())
    slots = defaultdict(list)
    for row in rows:
        slots[row["shard"]].append(row["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_both_versions_of_the_map_are_kept(spark, tmp_path):
    docs = spark.range(1000).withColumn("bytes", F.col("id") * F.col("id"))
    path = str(tmp_path / "map")
    sharding.shard_by_bytes(docs, ["id"], "bytes", 4, slots=64, path=path)
    first, second = (sharding.read_map(spark, path, version) for version in (1, 2))
    assert {r["slot"]: r["shard"] for r in first.collect()} == {slot: slot % 4 for slot in range(64)}
    assert second.agg(F.sum("rows"), F.sum("bytes")).first() == (1000, sum(i * i for i in range(1000)))


def test_no_python_in_the_plan(spark, capsys):
    queries.op2_slot_sharding(spark, SF_DIR).explain()
    assert "Python" not in capsys.readouterr().out
