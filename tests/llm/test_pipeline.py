"""Every stage against brute force on what the stage before it kept."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import partial

import public_tokenizers
import tiktoken

import corpus_pipeline
from tallywright.llm import bpe, jaccard, mixing, queries
from tallywright.llm.common import stored
from tests.llm import helpers
from tests.llm.test_mixing import targets

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules",
        "language id",
        "near duplicates",
        "source mix",
        "byte-level bpe",
    ]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")

    def after(name):
        out = stored(stages[name](spark, docs, SF_DIR), "test_stage")
        if name != "byte-level bpe":
            assert out.columns == docs.columns
        return out, out.collect()

    verdict = {r["doc_id"]: r["kept"] for r in queries.op9_rule_cascade(spark, SF_DIR).collect()}
    docs, rows = after("quality rules")
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, kept in verdict.items() if kept)

    before = rows
    docs, rows = after("language id")
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before}
    assert len(rows) >= 0.97 * len(before)

    expected = helpers.near_duplicates([(r["doc_id"], r["text"]) for r in rows])
    docs, rows = after("near duplicates")
    assert sorted(r["doc_id"] for r in rows) == sorted({component for _, component in expected.values()})

    sizes, largest = defaultdict(int), defaultdict(int)
    for row in rows:
        size = len(helpers.words(row["text"]))
        sizes[row["source"]] += size
        largest[row["source"]] = max(largest[row["source"]], size)
    docs, rows = after("source mix")
    taken, copies = defaultdict(int), Counter(r["doc_id"] for r in rows)
    for row in rows:
        taken[row["source"]] += len(helpers.words(row["text"]))
    assert max(copies.values()) <= mixing.CAP
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= max(0.1 * target, largest[source])  # a handful of documents each

    before = Counter((r["doc_id"], r["text"]) for r in rows)
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, rows = after("byte-level bpe")
    assert Counter((r["doc_id"], r["text"]) for r in rows) == before
    for row in rows:
        assert row["ids"] == library.encode_ordinary(row["text"])
        assert row["n_tokens"] == len(row["ids"])


def test_odd_rows_go_through_every_stage(spark):
    texts = [" ".join(f"{a}{b}ing" for a in "qwrtp" for b in f"aeiou{chr(97 + k)}") for k in range(12)]
    rows = [(i, text, "en", "s", 1) for i, text in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1] + " more", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, helpers.DOCUMENTS).selectExpr("*", "1 AS size", "2 AS ids_", "3 AS `a.b`", "4 AS copies")
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF_DIR), "odd_stage")
        if name == "byte-level bpe":
            assert {*docs.columns, "ids", "n_tokens"} == {*out.columns}
        else:
            assert out.columns == docs.columns
        docs = out
    assert docs.count() > 0


def test_no_documents(spark):
    docs = helpers.no_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), "empty_stage")
    assert docs.count() == 0


def test_run(spark):
    first = corpus_pipeline.run(spark, SF_DIR)
    assert first.count() > 0
    assert sorted(map(repr, first.collect())) == sorted(map(repr, corpus_pipeline.run(spark, SF_DIR).collect()))


def test_repeated_ids_change_no_other_group(spark):
    """Ten groups of four copies keep the same documents whether or not another row repeats an id, and alike rows leave one."""
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    texts = [" ".join(f"g{g}w{i}" for i in range(30)) for g in range(10)]
    rows = [(i, texts[i // 4], "en", "s", 1) for i in range(40)]
    more = [(39, "quite another text of more than five words", "en", "s", 1)] + [rows[8]] * 20 + [(None, texts[3], "en", "s", 1)]
    more += [(None, "only rows without any id here", "en", "s", 1), (None, "Only rows without any id here", "en", "s", 1)]

    def kept(rows):
        return Counter(r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, helpers.DOCUMENTS), SF_DIR).collect())

    plain = Counter(range(0, 40, 4))
    assert kept(rows) == plain
    assert kept(rows + more) == plain + Counter([39, None])


def test_common_passages_put_no_documents_together(spark, monkeypatch):
    """Where counts of shingles tell nothing, only documents with near copies are compared whole; the same ones stay."""
    groups, blocks, placed = jaccard.groups, jaccard._blocks, []
    monkeypatch.setattr(jaccard, "groups", partial(groups, sketch_bits=2))
    monkeypatch.setattr(jaccard, "_blocks", lambda members, *a: placed.append(members.count()) or blocks(members, *a))
    passages = [" ".join(f"p{p}w{k}" for k in range(10)) for p in range(2)]
    texts = [" ".join(f"own{i}x{k}" for k in range(50)) + f" {passages[i % 2]} " + " ".join(f"own{i}y{k}" for k in range(50)) for i in range(80)]
    texts += [text.replace("x7 ", "z ") for text in texts[:10]]
    docs = spark.createDataFrame([(i, text, "en", "s", 1) for i, text in enumerate(texts)], helpers.DOCUMENTS).repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, SF_DIR)
    expected = helpers.near_duplicates(list(enumerate(texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({component for _, component in expected.values()})
    assert placed == [20]
