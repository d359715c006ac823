from __future__ import annotations

import random

import numpy as np
import pytest

from tallywright.llm import minhash, queries
from tests.llm import helpers
from tests.llm.test_jaccard import corpus

SCHEMA = "doc_id bigint, text string"
SF_DIR = "/root/testdata/sf0.01"


def found(frame):
    rows = frame.collect()
    assert all(row["kept"] == (row["doc_id"] == row["component_id"]) for row in rows)
    return {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in rows}


def slow_signature(shingles, size):
    """The definition: every element's whole shuffle of the slots, one swap after the other."""
    least = [(1 << 64) - 1] * size
    for token in shingles:
        order = list(range(size))
        for step in range(size):
            drawn = int(minhash._mixed(np.array([(int(token) + (step + 1) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])
            swap = step + ((drawn >> 32) * (size - step) >> 32)
            order[step], order[swap] = order[swap], order[step]
            least[order[step]] = min(least[order[step]], step << 32 | drawn & 0xFFFFFFFF)
    return least


def test_signatures_are_whole_permutations_stopped_early():
    random_ = np.random.default_rng(1)
    sets = [random_.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300)]
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    made = minhash.signatures(np.concatenate(sets), owners, len(sets), 24)
    assert made.tolist() == [slow_signature(own, 24) for own in sets]


def test_chunks_of_a_long_set_change_nothing(monkeypatch):
    own = np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64)
    whole = minhash.signatures(own, np.zeros(1000, np.int64), 1, 50)
    monkeypatch.setattr(minhash, "CHUNK", 64)
    assert (minhash.signatures(own, np.zeros(1000, np.int64), 1, 50) == whole).all()


def test_estimates_vary_less_than_independent_slots():
    random_ = np.random.default_rng(3)
    errors = []
    for _ in range(300):
        shared = random_.integers(0, 1 << 63, 20).astype(np.uint64)
        pair = [np.r_[shared, random_.integers(0, 1 << 63, 10).astype(np.uint64)] for _ in range(2)]
        owners = np.repeat([0, 1], 30)
        a, b = minhash.signatures(np.concatenate(pair), owners, 2, 128)
        errors.append((a == b).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.8 * 0.25 / 128


def test_bands_miss_few_at_the_threshold():
    assert minhash.banding(85) == (5, 3)
    for percent in (50, 75, 95):
        slots, shared = minhash.banding(percent)
        assert shared >= minhash.LEAST_BANDS and slots * shared <= minhash.SIZE


@pytest.mark.parametrize("limit,sent", [(minhash.BLOCK_SHINGLES, 200_000), (300, 0)])
def test_as_brute_force(spark, limit, sent):
    """With small limits, blocks are compared in parts, and their places are joined."""
    docs = corpus(1)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    result = minhash.near_duplicates(frame, shingles_per_block=limit, sent_rows=sent)
    assert found(result) == helpers.near_duplicates(docs, 3, 85)


def test_other_thresholds(spark):
    docs = corpus(2, 100)
    frame = spark.createDataFrame(docs, SCHEMA)
    assert found(minhash.near_duplicates(frame, words=2, percent=60)) == helpers.near_duplicates(docs, 2, 60)


def test_large_groups(spark):
    """Many exact copies, a chain of near copies, and many texts around one passage."""
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    base = [f"w{i}" for i in range(100)]
    docs = [" ".join(base)] * 120
    step = list(base)
    for i in range(40):
        step = list(step)
        step[rnd.randrange(100)] = f"x{i}"
        docs.append(" ".join(step))
    docs += [" ".join(passage + [f"y{i}_{j}" for j in range(rnd.randint(5, 60))]) for i in range(60)]
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, SCHEMA).repartition(7)
    assert found(minhash.near_duplicates(frame)) == helpers.near_duplicates(docs, 3, 85)


def test_odd_rows(spark):
    frame = helpers.edge_documents(spark, extra=True)
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    got = sorted(minhash.near_duplicates(frame).collect(), key=repr)
    assert len(got) == len(rows)
    groups = helpers.near_duplicates([(at, text) for at, (_, text) in enumerate(rows)], 3, 85)
    expected = []
    for at, (doc_id, _) in enumerate(rows):
        ids = [rows[other][0] for other in groups if groups[other][1] == groups[at][1] and rows[other][0] is not None]
        least = doc_id if groups[at][0] == 0 else min(ids, default=None)
        expected.append((doc_id, groups[at][0], least, doc_id == least))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert minhash.near_duplicates(helpers.no_documents(spark)).count() == 0


def test_different_texts_under_one_id(spark):
    """An id that repeats does not tie its texts together."""
    docs = [(5, "a b c d e f"), (5, "g h i j k l"), (-3, "g h i j k l"), (9, "a b c d e f")]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == [(-3, 4, -3, True), (5, 4, -3, False), (5, 4, 5, True), (9, 4, 5, False)]


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op11_superminhash(spark, SF_DIR)) == helpers.near_duplicates(docs, 3, 85)
