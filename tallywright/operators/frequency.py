"""Counting operators: how often a value, a phrase or a group occurs.

All of them combine on the map side before their one shuffle, so a value held
by a large part of the rows (the blank key usually is) costs one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import semantics as S
from tallywright.operators.reduction import key_count, reduce_to_keys

# Columns go by these names until the end: a key may be called like a result.
_KEY, _SLOT, _COUNT, _TOTAL, _SHARE, _BUCKET = "_key", "_slot", "_count", "_total", "_share", "_bucket"

# Characters by which phrases are looked up, and how many shorter ones there may be.
GRAM = 5
MOST_SHORT = 100
_PHRASE, _GRAM, _ROW, _TEXT, _SHORT, _LONG = "_phrase", "_gram", "_row", "_text", "_short", "_long"

# Buckets of a pruning round, which are a table of so many rows, and how many of
# the fullest ones are looked into for a bound.
PRUNING_BUCKETS = 1 << 16
LOOKED_INTO = 4


def category_frequency(
    df: DataFrame,
    by: str,
    *,
    predicate: Column | None = None,
    count_as: str = "count",
    sort: bool = True,
) -> DataFrame:
    """Rows per value of `by`, most frequent first. NULL is a value, and so is ''."""
    S.distinct_names([by, count_as])
    counts = _kept(df, predicate).groupBy(F.col(by).alias(_KEY)).agg(F.count("*").alias(_COUNT))
    ordered = _most_frequent_first(counts, [_KEY]) if sort else counts
    return ordered.select(F.col(_KEY).alias(by), F.col(_COUNT).alias(count_as))


def keyword_count(df: DataFrame, text_col: str, phrases: Iterable[str], *, count_as: str = "count") -> DataFrame:
    """One row: how many texts hold at least one of the phrases."""
    return df.where(S.contains_any(text_col, phrases)).agg(F.count("*").alias(count_as))


def with_any_phrase(df: DataFrame, text_col: str, phrases: DataFrame, phrase_col: str, gram: int = GRAM) -> DataFrame:
    """The rows whose text holds at least one of many phrases, letter case included; NULL phrases hold nowhere.

    `contains_any` tests every phrase on every row. Here each phrase is known by
    its first `gram` characters; a text gives out its own runs of so many
    characters once each, and only phrases that begin with one of them are looked
    for. The work grows with the length of the texts and with what begins alike,
    not with the number of phrases. Shorter phrases are tested on every row, so there
    should be few; an empty phrase is in every text.
    """
    tested, found = _phrase_rows(df, text_col, phrases, phrase_col, gram)
    kept = tested.join(found.withColumn(_LONG, F.lit(1)), _ROW, "left").where(F.col(_SHORT) | F.col(_LONG).isNotNull())
    return kept.drop(_ROW, _SHORT, _LONG)


def _phrase_rows(
    df: DataFrame, text_col: str, phrases: DataFrame, phrase_col: str, gram: int
) -> tuple[DataFrame, DataFrame]:
    """`df` with a number per row and whether it holds a short phrase, and the numbers of other rows with a long one.

    Runs of characters that begin no phrase are left out by a filter where they
    arise, so only candidates are shuffled, if the phrases are too many to be broadcast.
    """
    listed = phrases.select(F.col(phrase_col).cast("string").alias(_PHRASE)).where(F.col(_PHRASE).isNotNull()).distinct()
    long = listed.where(F.length(_PHRASE) >= gram)
    begins = long.select(_PHRASE, F.get(_grams(F.col(_PHRASE), gram), F.lit(0)).alias(_GRAM))
    short = [row[0] for row in listed.where(F.length(_PHRASE) < gram).limit(MOST_SHORT + 1).collect()]
    if len(short) > MOST_SHORT:
        raise ValueError(f"more than {MOST_SHORT} phrases are shorter than {gram} characters; give a smaller gram")
    at_once = S.contains_any(text_col, short) if short else F.lit(False)
    tested = df.withColumns({_ROW: F.monotonically_increasing_id(), _SHORT: F.coalesce(at_once, F.lit(False))})
    texts = tested.where(~F.col(_SHORT)).select(_ROW, F.col(text_col).alias(_TEXT))
    runs = texts.withColumn(_GRAM, F.explode(F.array_distinct(_grams(F.col(_TEXT), gram))))
    candidates = reduce_to_keys(runs, begins, [_GRAM], key_count(begins, [_GRAM]))
    found = candidates.join(begins, _GRAM).where(F.col(_TEXT).contains(F.col(_PHRASE))).select(_ROW).distinct()
    return tested, found


def keyword_count_indexed(
    df: DataFrame, text_col: str, phrases: DataFrame, phrase_col: str, gram: int = GRAM, *, count_as: str = "count"
) -> DataFrame:
    """What `keyword_count` gives, for a table of phrases of any number."""
    tested, found = _phrase_rows(df.select(text_col), text_col, phrases, phrase_col, gram)
    both = tested.where(_SHORT).select(_ROW).unionAll(found)
    return both.agg(F.count("*").alias(count_as))


def _grams(text: Column, gram: int) -> Column:
    """All runs of `gram` characters of a text, in order; none of a shorter one."""

    def runs(characters: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(characters) - (gram - 1))
        found = F.transform(starts, lambda at: F.array_join(F.slice(characters, at, F.lit(gram)), ""))
        return F.when(F.size(characters) >= gram, found).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(F.split(text, "")), runs)[0]  # the characters are worked out once


def category_share(
    df: DataFrame,
    by: str,
    predicate: Column | None = None,
    scale: int = 2,
    denominator: int | Decimal | None = None,
    *,
    count_as: str = "count",
    percent_as: str = "percent",
    sort: bool = True,
) -> DataFrame:
    """Rows per value of `by`, and their percentage of all kept rows.

    The total is a scalar subquery over the counts. Spark reuses the shuffle of
    the counts for it, so the input is scanned once, and no window pulls all
    groups into one task. A literal `denominator` replaces the total.
    """
    S.distinct_names([by, count_as, percent_as])
    counts = _kept(df, predicate).groupBy(F.col(by).alias(_KEY)).agg(F.count("*").alias(_COUNT))
    total = counts.agg(F.sum(_COUNT)).scalar() if denominator is None else denominator
    if denominator is None:
        counts, total = counts.withColumn(_TOTAL, total), F.col(_TOTAL)
    shares = counts.withColumn(_SHARE, S.percent(_COUNT, total, scale))
    ordered = _most_frequent_first(shares, [_KEY]) if sort else shares
    return ordered.select(F.col(_KEY).alias(by), F.col(_COUNT).alias(count_as), F.col(_SHARE).alias(percent_as))


def slot_frequency(
    df: DataFrame,
    slots: Sequence[str],
    *,
    slot_as: str = "slot",
    value_as: str = "value",
    count_as: str = "count",
    sort: bool = True,
) -> DataFrame:
    """Rows per value in each of several like columns, from a single scan.

    The columns must have one type. A blank slot counts as a value, as it does
    in `category_frequency`.
    """
    S.distinct_names([slot_as, value_as, count_as])
    long_form = df.select(*slots).unpivot([], list(slots), _SLOT, _KEY)
    counts = long_form.groupBy(_SLOT, _KEY).agg(F.count("*").alias(_COUNT))
    ordered = _most_frequent_first(counts, [_SLOT, _KEY]) if sort else counts
    return ordered.select(
        F.col(_SLOT).alias(slot_as), F.col(_KEY).alias(value_as), F.col(_COUNT).alias(count_as)
    )


def top_groups(df: DataFrame, by: str, count_col: str, k: int, *, count_as: str = "count") -> DataFrame:
    """The `k` values of `by` with the most non-NULL `count_col`.

    Ties at the last place go to the smallest key. Every task keeps `k` rows
    only; there is no global sort.
    """
    S.distinct_names([by, count_as])
    counts = df.groupBy(F.col(by).alias(_KEY)).agg(F.count(count_col).alias(_COUNT))
    top = _most_frequent_first(counts, [_KEY]).limit(k)
    return top.select(F.col(_KEY).alias(by), F.col(_COUNT).alias(count_as))


def top_groups_pruned(
    df: DataFrame,
    by: str,
    count_col: str,
    k: int,
    *,
    rounds: int = 2,
    buckets: int = PRUNING_BUCKETS,
    count_as: str = "count",
) -> DataFrame:
    """What `top_groups` gives, without shuffling groups that cannot be among the first `k`.

    For tables with very many groups of which a few are large. In each round
    the groups are dealt into `buckets` by a hash of their own, and rows are
    counted per bucket: no group is larger than its bucket. The groups of the
    fullest buckets are counted exactly, and the `k`-th of them bounds the `k`-th
    of all from below; rows of emptier buckets than that go no further. What is
    left is counted exactly, so the result is that of `top_groups` on any data; a
    round costs two scans, which flat data do not repay.

    A task sends at most one row per bucket. The counts per bucket are broadcast:
    `buckets` rows at most, which is all that is ever sent to every task.
    """
    S.distinct_names([by, count_as])
    left = df.select(F.col(by).alias(_KEY), F.col(count_col).alias(_COUNT))
    for seed in range(rounds):
        left = _reachable(left, k, seed, buckets)
    counts = left.groupBy(_KEY).agg(F.count(_COUNT).alias(_COUNT))
    top = _most_frequent_first(counts, [_KEY]).limit(k)
    return top.select(F.col(_KEY).alias(by), F.col(_COUNT).alias(count_as))


def _reachable(rows: DataFrame, k: int, seed: int, buckets: int) -> DataFrame:
    """The rows whose bucket is at least as full as the `k`-th group known so far is large."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(_KEY)), F.lit(buckets)).cast("int").alias(_BUCKET)
    totals = rows.groupBy(bucket).agg(F.count(_COUNT).alias(_TOTAL))
    fullest = totals.orderBy(F.desc(_TOTAL), _BUCKET).limit(max(k, 1) * LOOKED_INTO)
    known = _in_buckets(rows, bucket, fullest).groupBy(_KEY).agg(F.count(_COUNT).alias(_COUNT))
    best = known.orderBy(F.desc(_COUNT)).limit(k)
    # With fewer than k groups known nothing is bounded.
    bound = best.agg(F.when(F.count("*") == k, F.min(_COUNT)).otherwise(F.lit(0))).scalar()
    return _in_buckets(rows, bucket, totals.where(F.col(_TOTAL) >= bound))


def _in_buckets(rows: DataFrame, bucket: Column, chosen: DataFrame) -> DataFrame:
    dealt = rows.withColumn("_own", bucket)
    return dealt.join(F.broadcast(chosen.select(_BUCKET)), dealt["_own"] == chosen[_BUCKET], "left_semi").drop("_own")


def _kept(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def _most_frequent_first(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.orderBy(S.largest_first(_COUNT), *[S.smallest_first(key) for key in keys])
