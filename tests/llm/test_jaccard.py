from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tallywright.llm import jaccard, queries
from tallywright.llm.links import components
from tests.llm import helpers

SF_DIR = "/root/testdata/sf0.001"


def found(frame):
    return {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in frame.collect()}


def corpus(seed, n=150):
    """Families of near copies, chains, a passage that many share, one very common word, copies."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(30)]
    texts = []
    while len(texts) < n:
        text = rnd.choices(vocabulary, k=rnd.randint(3, 120))
        if rnd.random() < 0.4:
            at = rnd.randrange(len(text))
            text[at:at] = passage
        texts.append(text)
        for _ in range(rnd.choice([0, 0, 0, 1, 3, 8])):
            text = list(text)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary + ["the"] * 50)
            texts.append(text)
    return [(i, rnd.choice([" ", "\n", "  "]).join(text).title() if i % 2 else " ".join(text)) for i, text in enumerate(texts)]


@pytest.mark.parametrize("limit", [jaccard.BLOCK_SHINGLES, 300])
def test_as_brute_force(spark, limit):
    """With a small limit, blocks are compared in parts."""
    docs = corpus(1)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    result = jaccard.near_duplicates(frame, shingles_per_block=limit)
    assert found(result) == helpers.near_duplicates(docs)


def test_other_sizes_and_thresholds(spark):
    docs = corpus(2, 80)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(jaccard.near_duplicates(frame, words=2, percent=50)) == helpers.near_duplicates(docs, 2, 50)


def test_size_bands_follow_the_threshold(spark):
    """Two linked sets of 5 and 10 shingles in a block that is cut into parts by size."""
    docs = [(1, "a b c d e"), (2, "a b c d e f g h i j"), (3, "k l m n o p q r s t"), (4, "k l m n o")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for percent in (50, 100):
        result = found(jaccard.near_duplicates(frame, words=1, percent=percent, shingles_per_block=7))
        assert result == helpers.near_duplicates(docs, 1, percent)


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_every_link(seed):
    rnd = np.random.default_rng(seed)
    sets = []
    for _ in range(60):
        base = rnd.integers(0, 2**64, rnd.integers(1, 200), dtype=np.uint64)
        for _ in range(rnd.integers(1, 5)):
            kept = base[rnd.random(len(base)) < 0.9]
            more = rnd.integers(0, 2**64, rnd.integers(0, 10), dtype=np.uint64)
            if len(kept) + len(more):
                sets.append(np.unique(np.concatenate([kept, more])))
    links = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    ]
    first = jaccard.SignatureTree(sets, [-1] * len(sets)).linked()
    expected = helpers.components(range(len(sets)), links)
    groups = {}
    assert all(groups.setdefault(expected[i], first[i]) == first[i] for i in range(len(sets)))
    assert len(set(groups.values())) == len(groups)


def test_blocks_stay_small_when_counts_tell_nothing(spark, monkeypatch):
    """With hardly any counters, words that a fifth of the texts have are taken for rare ones, but put no block together."""
    rnd = random.Random(5)
    pool = [f"often{i}" for i in range(30)]
    docs = [(i, " ".join([f"own{i}x{k}" for k in range(94)] + rnd.sample(pool, 6))) for i in range(120)]
    docs += [(1000 + i, docs[i][1].replace("x7 ", "y ")) for i in range(10)]
    docs += [(2000 + i, " ".join(f"common{k}" for k in range(60) if k != i)) for i in range(25)]
    blocks, placed = jaccard._blocks, []
    monkeypatch.setattr(jaccard, "_blocks", lambda members, *a: placed.append(members.count()) or blocks(members, *a))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    result = jaccard.near_duplicates(frame, words=1, shingles_per_block=500, sketch_bits=2)
    assert found(result) == helpers.near_duplicates(docs, 1)
    assert 45 <= placed[0] <= 60  # the 45 texts that have near copies


def meetings(rows, size, level=0):
    """What `_meetings` makes of rows of token, owner and size that come in batches of `size`."""
    columns = [pa.array(part, kind) for part, kind in zip(zip(*sorted(rows)), (pa.int64(), pa.int64(), pa.int32()))]
    table = pa.table(columns, names=["token", "fp", "n"])
    found = pa.Table.from_batches(jaccard._meetings(75, level)(iter(table.to_batches(size)))).to_pylist()
    return (
        sorted((r["a"], r["b"], r["least"]) for r in found if r["token"] is None),
        sorted((r["token"], r["a"], r["n"], r["least"]) for r in found if r["token"] is not None),
    )


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_meetings_however_rows_come(size):
    """Short runs give pairs of similar size, long ones their owners once each, wherever batches end."""
    rnd = random.Random(size)
    sizes = {owner: rnd.randint(1, 400) for owner in range(40)}
    runs = {token: rnd.sample(sorted(sizes), rnd.choice([1, 2, 5, jaccard.FEW, jaccard.FEW + 1, 30])) for token in range(60)}
    rows = [(token, owner, sizes[owner]) for token, owners in runs.items() for owner in owners for _ in range(rnd.choice([1, 1, 3]))]
    pairs, many = meetings(rows, size)
    near = [
        sorted((a, b)) + [int(jaccard.enough(min(sizes[a], sizes[b])))]
        for owners in runs.values()
        if len(owners) <= jaccard.FEW
        for a, b in itertools.combinations(owners, 2)
        if 100 * min(sizes[a], sizes[b]) >= 75 * max(sizes[a], sizes[b])
    ]
    assert pairs == sorted(map(tuple, near))
    expected = [(t, o, sizes[o], int(jaccard.common(sizes[o]))) for t, owners in runs.items() if len(owners) > jaccard.FEW for o in owners]
    assert many == sorted(expected)


@pytest.mark.parametrize("percent", [50, 75, 90, 100])
@pytest.mark.parametrize("level", range(jaccard.LEVELS))
def test_limits_leave_out_no_link(percent, level):
    """If one of two sets has fewer common shingles than `common`, `enough` of those shared are of few classes."""
    n = np.arange(1, 3000)
    smallest = -(-percent * n // 100)
    for m in (smallest, (smallest + n) // 2, n):  # the sizes of the other set
        both = jaccard.shared(m, percent, level)
        assert (both - (jaccard.common(n, percent, level) - 1) >= jaccard.enough(m, percent, level)).all()
        assert (both - (jaccard.common(m, percent, level) - 1) >= jaccard.enough(m, percent, level)).all()
        assert (both - jaccard.enough(m, percent, level) + 1 >= jaccard.shared(m, percent, level + 1)).all()
    assert (jaccard.shared(n, percent, level) >= 1).all() and (jaccard.shared(n, percent, level) <= smallest).all()


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_stars_end_where_sizes_are_too_far_apart(size):
    rows = [(1, 30, 10), (1, 31, 12), (1, 32, 16), (1, 33, 22), (2, 33, 22), (2, 34, 23), (3, 35, 5)]
    table = pa.table(list(zip(*[(t, n, o) for t, o, n in rows])), names=["token", "n", "fp"])
    found = [r for batch in jaccard._stars(75)(iter(table.to_batches(size))) for r in batch.to_pylist()]
    assert [(r["a"], r["b"]) for r in found] == [(30, 31), (30, 32), (33, 34)]


def test_odd_table(spark):
    frame = helpers.edge_documents(spark, extra=True)
    rows = jaccard.near_duplicates(frame).collect()
    assert len(rows) == frame.count()
    ids = [(i, text) for i, text in enumerate(helpers.EDGE_TEXTS)]
    expected = helpers.near_duplicates(ids)
    for row in rows:
        if row["doc_id"] is not None:
            assert (row["n_shingles"], row["component_id"]) == expected[row["doc_id"]]
        elif row["n_shingles"] == 0:
            assert row["component_id"] is None


def test_empty_table(spark):
    assert jaccard.near_duplicates(helpers.no_documents(spark)).collect() == []


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert found(queries.op3_signature_join(spark, SF_DIR)) == helpers.near_duplicates(docs)


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    nodes = {node for a, b in links if a != b for node in (a, b)}
    expected = helpers.components(nodes, [(a, b) for a, b in links if a != b])
    assert {row["node"]: row["root"] for row in components(frame).collect()} == expected


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
