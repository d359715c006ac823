"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of `docs`. Rows without an id, a language or
a source go through like any other; those without a text have no words and leave
with the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import bpe, jaccard, langid, mixing, quality
from tallywright.llm.common import col, hidden, release, stored, word_count

LEAST_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality.keep(docs, "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, half of whose words or more are in one language.

    The model is learned from the stage's own documents that have a language and
    are not held out. Without any, nothing can be judged, and all stay.
    """
    known = docs.where(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    model = langid.fit(known, "text", "lang", key=["doc_id"])
    if not model.languages:
        return docs
    lang, score = hidden("lang"), hidden("score")
    judged = langid.predict(docs, "text", model, lang, score)
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the smallest id.

    A row is known by a 128-bit digest of its id and text. Of several rows under
    the smallest id, or of a component without ids, the one with the smallest
    digest stays, and of rows alike in both one. Rows without words all stay.
    """
    tag = hidden("tag")
    written = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    tagged = docs.withColumn(tag, F.unhex(F.md5(written.cast("binary"))))
    found = stored(jaccard.groups(tagged, "doc_id", "text", tag).where("n > 0"), "near_duplicates")
    named = found.where(F.col("first") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = (
        named.groupBy("root", "tag")
        .agg(F.count("*").alias("rows"))
        .groupBy("root")
        .agg(F.min(F.struct("tag", "rows")).alias("least"))
        .select(F.col("least.tag").alias(tag), "least.rows")
    )
    chosen = stored(chosen, "near_duplicates_chosen")
    release(docs.sparkSession)  # before whole documents are dealt
    copies = found.select(F.col("tag").alias(tag)).distinct().join(chosen, tag, "left_anti")
    kept = tagged.join(copies, tag, "left_anti")
    repeated = chosen.where("rows > 1").select(tag)
    if not repeated.isEmpty():
        once = kept.join(repeated, tag, "left_semi").dropDuplicates([tag])
        kept = kept.join(repeated, tag, "left_anti").unionAll(once)
    return kept.select(*[col(name) for name in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    packed = docs.select(F.struct(*[col(name) for name in docs.columns]).alias("row"), "source", "doc_id", "text")
    mixed = mixing.mix(packed, "source", word_count(F.col("text")), ["doc_id", "text"])
    taken = mixed.where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, copies included."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, "text", ranks, public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", F.size("ids").cast("bigint"))
