from __future__ import annotations

import itertools
import zlib

import numpy as np

from tallywright.llm import langid, queries
from tests.llm.helpers import edge_documents, no_documents

SF_DIR = "/root/testdata/sf0.01"


def test_proportions_of_a_mixture():
    """Words of two languages that differ clearly, and of a third that is never the likeliest."""
    first, second = [0.0, -6.0, -2.5], [-6.0, 0.0, -2.5]
    likelihood = np.array([first] * 70 + [second] * 30 + [first] * 10, np.float32)
    found, share = langid.infer(likelihood, np.array([100, 10]))
    assert found.tolist() == [0, 0]
    assert abs(share[0] - 0.7) < 0.02
    assert share[1] > 0.99


def test_a_few_stray_words_do_not_add_a_language():
    likelihood = np.array([[0.0, -3.0]] * 50 + [[-1.0, 0.0]] * 2, np.float32)
    assert langid.infer(likelihood, np.array([52]))[1].tolist() == [1.0]


def _brute(words):
    """The best of all sets of languages, by many steps of expectation-maximisation each."""
    best = (-np.inf,)
    for size in range(1, words.shape[1] + 1):
        for chosen in itertools.combinations(range(words.shape[1]), size):
            likelihood = np.exp(words[:, chosen].astype(np.float64))
            share = np.full(size, 1 / size)
            for _ in range(300):
                weighed = likelihood * share
                share = (weighed / weighed.sum(1, keepdims=True)).mean(0)
            value = np.log((likelihood * share).sum(1)).sum() - langid.PENALTY * size
            best = max(best, (value, chosen[share.argmax()], share.max()))
    return best[1:]


def test_more_than_four_languages_in_a_document():
    """The words of the fifth and sixth are not given to the likeliest four."""
    random = np.random.default_rng(9)
    documents = []
    for shares in ([0.35, 0.2, 0.15, 0.12, 0.1, 0.08, 0], [0.45, 0.15, 0.1, 0.1, 0.1, 0.1, 0], [0.9, 0.1, 0, 0, 0, 0, 0]):
        for _ in range(2):
            spoken = random.choice(7, 300, p=shares)
            words = random.normal(-9, 1, (300, 7))
            words[np.arange(300), spoken] += 5
            documents.append(words.astype(np.float32))
    found, share = langid.infer(np.concatenate(documents), np.full(len(documents), 300))
    for at, words in enumerate(documents):
        lang, score = _brute(words)
        assert found[at] == lang
        assert abs(share[at] - score) < 0.005


def test_held_out_accuracy(spark):
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op6_mixture_langid(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(known)
    right = []
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1
        if row["held_out"]:
            right.append(row["lang_pred"] == known[row["doc_id"]])
    assert sum(right) >= 0.98 * len(right)
    assert sorted(rows) == sorted(queries.op6_mixture_langid(spark, SF_DIR).collect())


def test_odd_and_empty_tables(spark):
    model = langid.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "text", "lang")
    rows = langid.predict(edge_documents(spark, extra=True), "text", model).collect()
    assert len(rows) == edge_documents(spark).count()
    for row in rows:
        if not any(c.isalpha() for c in row["text"] or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            assert row["lang_pred"] in model.languages
    assert langid.predict(no_documents(spark), "text", model).collect() == []


def test_nothing_to_learn_from(spark):
    model = langid.fit(no_documents(spark), "text", "lang")
    assert model.languages == ()
    rows = langid.predict(edge_documents(spark), "text", model).collect()
    assert {row["lang_pred"] for row in rows} == {"und"}


def test_training_takes_a_bounded_part(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert langid.fit(docs, "text", "lang", training_rows=300).languages == ("de", "en", "es", "fr")


def test_every_language_is_learned(spark):
    """Most labelled rows are one text; a rare language has a single row."""
    rows = spark.range(12_000).selectExpr(
        "id AS doc_id",
        "CASE WHEN id = 5 THEN 'zzz qqq zzq' WHEN id % 3 > 0 THEN 'always the same text' ELSE concat('andere worte ', id) END AS text",
        "CASE WHEN id = 5 THEN 'rare' WHEN id % 3 > 0 THEN 'xx' ELSE 'yy' END AS lang",
    )
    for key in ([], ["doc_id"]):
        model = langid.fit(rows, "text", "lang", training_rows=600, key=key)
        assert model.languages == ("rare", "xx", "yy")
    frame = spark.createDataFrame([("the same text always",), ("andere worte",)], "text string")
    assert [r["lang_pred"] for r in langid.predict(frame, "text", model).collect()] == ["xx", "yy"]
    assert langid.equal_parts([10, 500, 3, 900], 100) == [10, 43.5, 3, 43.5]
