"""Numeric summaries, segment profiles and top rows."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import semantics as S
from tallywright.functions.exact import exact_aggregate, exact_mean, is_binary


def numeric_summary(df: DataFrame, cols: Sequence[str], scale: int = 2) -> DataFrame:
    """One row: rounded mean, minimum and maximum of each column over its values.

    Means of doubles are exact before they are rounded, whatever the order of the rows.
    """
    if any(is_binary(df, col) for col in cols):
        return _exact_summary(df, cols, scale)
    means = [S.rounded_mean(df, col, scale).alias(f"avg_{col}") for col in cols]
    ranges = [
        bound
        for col in cols
        for bound in (F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))
    ]
    return df.agg(*means, *ranges)


def _exact_summary(df: DataFrame, cols: Sequence[str], scale: int) -> DataFrame:
    names = [f"{i}" for i in range(len(cols))]
    binary, plain, means = _measures(df, cols, names, scale)
    for name, col in zip(names, cols, strict=True):
        plain |= {f"min_{name}": ("min", F.col(col)), f"max_{name}": ("max", F.col(col))}
    found = exact_aggregate(df, {}, binary, plain)
    ranges = [
        F.col(f"{bound}_{name}").alias(f"{bound}_{col}")
        for name, col in zip(names, cols, strict=True)
        for bound in ("min", "max")
    ]
    return found.select(*[mean.alias(f"avg_{col}") for mean, col in zip(means, cols, strict=True)], *ranges)


def _measures(df: DataFrame, cols: Sequence[str], names: Sequence[str], scale: int):
    """What `exact_aggregate` needs for rounded means of doubles and of other numbers, and the means of what it returns."""
    binary, plain, means = {}, {}, []
    for name, col in zip(names, cols, strict=True):
        if is_binary(df, col):
            binary[f"total_{name}"] = F.col(col)
            means.append(exact_mean(F.col(f"total_{name}"), scale))
        else:
            unit, digits = S.in_units(df, col)
            plain |= {f"sum_{name}": ("sum", unit), f"count_{name}": ("count", F.col(col))}
            total = S.whole_sum(F.col(f"sum_{name}"), digits)
            count = F.col(f"count_{name}").cast(S.WHOLE) * F.lit(Decimal(10**digits))
            means.append(S.rounded_quotient(total, count, scale))
    return binary, plain, means


def segment_profile(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    predicate: Column | None = None,
    scale: int = 2,
    *,
    count_as: str = "count",
    sort: bool = True,
) -> DataFrame:
    """Size and rounded means of every combination of `keys`, largest first.

    A segment whose measure is NULL throughout keeps its row, with a NULL mean.
    Means of doubles are exact before they are rounded, whatever the order of the rows.
    """
    means = [f"avg_{measure}" for measure in measures]
    S.distinct_names([*keys, count_as, *means])
    kept = df if predicate is None else df.where(predicate)
    # By private names until the end: a key may be called like a result.
    own_keys = [f"_key_{i}" for i in range(len(keys))]
    own_means = [f"_mean_{i}" for i in range(len(measures))]
    if any(is_binary(df, measure) for measure in measures):
        binary, plain, rounded = _measures(df, measures, own_means, scale)
        grouped = {own: F.col(key) for key, own in zip(keys, own_keys, strict=True)}
        found = exact_aggregate(kept, grouped, binary, {"_count": ("count", F.lit(1)), **plain})
        profile = found.select(
            *own_keys, "_count", *[mean.alias(own) for mean, own in zip(rounded, own_means, strict=True)]
        )
    else:
        profile = kept.groupBy(*[F.col(key).alias(own) for key, own in zip(keys, own_keys, strict=True)]).agg(
            F.count("*").alias("_count"),
            *[S.rounded_mean(df, m, scale).alias(own) for m, own in zip(measures, own_means, strict=True)],
        )
    if sort:
        profile = profile.orderBy(S.largest_first("_count"), *[S.smallest_first(own) for own in own_keys])
    names = zip([*own_keys, "_count", *own_means], [*keys, count_as, *means], strict=True)
    return profile.select(*[F.col(own).alias(name) for own, name in names])


def top_rows(df: DataFrame, id_col: str, measure: str, k: int) -> DataFrame:
    """The `k` rows with the largest measure; NULL ranks above every number.

    Ties at the last place go to the smallest id. Only the two columns are
    read, and every task keeps `k` rows.
    """
    ranked = df.select(id_col, measure).orderBy(S.largest_first(measure), S.smallest_first(id_col))
    return ranked.limit(k)
