from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallywright.llm import quality, queries
from tests.llm.helpers import edge_documents, measures, no_documents

SF_DIR = "/root/testdata/sf0.01"
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures_of_random_texts(spark):
    rnd = random.Random(5)
    pieces = ["a", "b", "a b c d e f g h ", "\n", "  ", "#", "|x", "é", "\x1c", "\t", "a a a a a a a a a"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(0, 40))) + rnd.choice([" ", ""]) for _ in range(300)]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    judged = quality.judge(frame, "text").select("text", *MEASURED).collect()
    assert len(judged) == len(texts)
    for row in judged:
        assert tuple(row)[1:] == measures(row["text"])


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = queries.op9_rule_cascade(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for row in rows:
        expected = measures(texts[row["doc_id"]])
        assert tuple(row[name] for name in MEASURED) == expected
        assert row["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (row["base_failed"] and row["kept"])
    good = [r for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    bad = [r for r in rows if labels.get(r["doc_id"]) == 0]
    assert sum(r["kept"] for r in bad) <= 0.05 * len(bad)


def test_order_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    text = F.col("text")
    verdicts = [
        docs.select(quality.rejected_by(order, text).isNull().alias("kept")).collect()
        for order in (quality.RULES, quality.RULES[::-1])
    ]
    assert verdicts[0] == verdicts[1]
    kept = docs.where(quality.rejected_by(quality.RULES, text).isNull())
    assert sorted(quality.keep(docs, "text").collect()) == sorted(kept.collect())


def test_later_rules_are_not_worked_out(spark):
    """A rule that cannot be evaluated hurts only documents that reach it, and so does its measure."""
    rules = (quality.Rule("few", lambda m: m("n_words") < 5), quality.Rule("never", lambda m: F.raise_error(F.concat(F.lit("reached "), m("n_lines")))))
    frame = spark.createDataFrame([("a b",), (None,), ("c",)], "text string")
    assert [r[0] for r in frame.select(quality.rejected_by(rules, F.col("text"))).collect()] == ["few"] * 3
    with pytest.raises(Exception, match="reached 2"):
        spark.createDataFrame([("a b c\nd e f",)], "text string").select(quality.rejected_by(rules, F.col("text"))).collect()


def test_every_measure_is_written_once(spark, capsys):
    """The chain splits a text into words and lines once each, however many rules ask for them."""
    frame = spark.createDataFrame([("a b",)], "text string")
    frame.select(quality.rejected_by(quality.RULES, F.col("text")).alias("by")).explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1].split("\n\n")[0]
    assert plan.count("split(") == 2


def test_the_order_is_the_same_in_every_run(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    orders = {tuple(r.name for r in quality.order_rules(docs.repartition(n), "text", sample_rows=300)) for n in (1, 3, 8)}
    assert len(orders) == 1


def test_cheap_rules_that_reject_come_first(spark):
    docs = spark.range(3000).selectExpr("IF(id % 2 = 0, 'few', concat_ws(' ', transform(sequence(1, 300), x -> concat('w', x * id)))) AS text")
    ordered = quality.order_rules(docs, "text")
    assert ordered[0].name == "few_words"
    assert {rule.name for rule in ordered} == {rule.name for rule in quality.RULES}


def test_odd_and_empty_tables(spark):
    rows = quality.judge(edge_documents(spark, extra=True), "text").collect()
    assert len(rows) == edge_documents(spark).count()
    for row in rows:
        assert tuple(row[name] for name in MEASURED) == measures(row["text"])
        assert row["base_failed"] or len(row["text"]) > 1000
    assert quality.judge(no_documents(spark), "text").collect() == []
    assert quality.keep(no_documents(spark), "text").collect() == []


def test_no_python_in_the_plan(spark, capsys):
    queries.op9_rule_cascade(spark, SF_DIR).explain()
    assert "Python" not in capsys.readouterr().out


def test_a_text_that_is_all_one_word(spark):
    frame = spark.createDataFrame([("x " * 30_000,), ("short",)], "text string")
    row = quality.judge(frame, "text").where("n_words > 100").first()
    assert row["n_repeat_words"] == 30_000
