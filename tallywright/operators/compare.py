"""Comparisons: treated against untreated, one channel against another, plan against fact.

Two of these are left joins whose right side may repeat a key, and whose result
counts the joined rows. Either side may hold a large part of its rows under one
key, so joining row by row could produce a number of pairs quadratic in the
size of that group. Both sides are therefore first reduced to counts per key,
and the number of pairs is obtained by multiplication, in whole decimals of 38
digits: a bigint ends where both sides hold three billion rows of one key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import semantics as S
from tallywright.functions.exact import FLAGS, PARTS, exact_aggregate, exact_mean, is_binary, merge_bins, sum_by_bins
from tallywright.operators.reduction import reduce_to_keys


def treatment_comparison(
    units: DataFrame,
    treatment: DataFrame,
    on: str | tuple[str, str],
    flag_col: str,
    outcome: str,
    labels: tuple[str, str] = ("treated", "untreated"),
    *,
    dedup_right: bool = False,
    exact: bool = False,
    status_as: str = "status",
    count_as: str = "count",
    mean_as: str | None = None,
) -> DataFrame:
    """Number and mean outcome of units with and without a positive `flag_col`.

    The result is that of units left-joined to treatment on `on` (one name, or
    the unit's and the treatment's): a unit with several treatment rows counts
    once per row. With `dedup_right` each unit row counts once, as treated if any
    of its treatment rows is positive.

    The join is one row to one row per key and keeps the partitioning of the two
    aggregations, so it adds no shuffle to them.

    With `exact`, the mean of a double is the double nearest to the true mean, whatever
    the order of the rows; units are then summed per key and bin (`functions.exact`),
    and a key's bins are shuffled once more for the join.
    """
    unit_key, treatment_key = (on, on) if isinstance(on, str) else on
    positive = F.coalesce(F.col(flag_col) > 0, F.lit(False))
    S.distinct_names([status_as, count_as, mean_as or f"avg_{outcome}"])
    # Integers are summed as `avg` sums them. Decimals are summed and weighed in
    # units of their last digit: a product of decimals may lose digits.
    if isinstance(S.data_type(units, outcome), T.DecimalType):
        value_sum, digits = S.unscaled(units, outcome)
        number = S.WHOLE
    else:
        value_sum, digits, number = F.sum(F.col(outcome).cast("double")), None, "double"

    treated = (
        treatment.where(F.col(treatment_key).isNotNull())
        .groupBy(F.col(treatment_key).alias("key"))
        .agg(F.count_if(positive).alias("positive"), F.count_if(~positive).alias("other"))
    )
    weights = _rows_per_unit(dedup_right)
    if exact and is_binary(units, outcome):
        names = (status_as, count_as, mean_as or f"avg_{outcome}")
        return _exact_comparison(units, treated, unit_key, outcome, labels, weights, names)

    per_key = units.groupBy(F.col(unit_key).alias("key")).agg(
        F.count("*").alias("units"),
        F.count(outcome).alias("outcomes"),
        value_sum.alias("outcome_sum"),
    )
    as_treated, as_untreated = weights
    weighed = per_key.join(treated, "key", "left").select(
        "units",
        "outcomes",
        "outcome_sum",
        F.when(F.col("key").isNotNull(), F.col("units")).otherwise(F.lit(0)).alias("ids"),
        as_treated.alias("w_treated"),
        as_untreated.alias("w_untreated"),
    )
    sums = weighed.agg(
        *[
            # A sum of no matching rows must not turn an infinite outcome into NaN.
            F.sum(F.when(F.col(weight) > 0, F.col(part).cast(kind) * F.col(weight).cast(kind))).alias(f"{part}_{weight}")
            for weight in ("w_treated", "w_untreated")
            for part, kind in (("units", S.WHOLE), ("ids", S.WHOLE), ("outcomes", S.WHOLE), ("outcome_sum", number))
        ]
    )

    def status_row(label: str, weight: str) -> Column:
        n = F.nullif(F.col(f"outcomes_{weight}").cast("double"), F.lit(0.0))
        total = F.col(f"outcome_sum_{weight}")
        total = total if digits is None else S.shifted(total, digits)
        row = F.struct(
            F.lit(label).alias(status_as),
            F.col(f"ids_{weight}").alias(count_as),
            (total.cast("double") / n).alias(mean_as or f"avg_{outcome}"),
        )
        # A status without joined rows has no row, as in any grouping.
        return F.when(F.col(f"units_{weight}") > 0, row)

    both = F.array(status_row(labels[0], "w_treated"), status_row(labels[1], "w_untreated"))
    return sums.select(F.inline(F.array_compact(both)))


def _exact_comparison(
    units: DataFrame,
    treated: DataFrame,
    unit_key: str,
    outcome: str,
    labels: tuple[str, str],
    weights: tuple[Column, Column],
    names: tuple[str, str, str],
) -> DataFrame:
    """`treatment_comparison` of a double: bins of units per key, weighed by the joined rows, then merged per status."""
    bins = sum_by_bins(units, {"key": F.col(unit_key)}, {"total": F.col(outcome)}, {"units": ("count", F.lit(1))})
    joined = bins.join(treated, F.col("k_key") == F.col("key"), "left")
    each = [F.struct(F.lit(at).alias("status"), weight.cast(S.WHOLE).alias("w")) for at, weight in enumerate(weights)]
    weighed = joined.select(
        F.inline(F.array(*each)),
        "slot",
        "bin",
        F.when(F.col("k_key").isNotNull(), F.col("p_units")).otherwise(F.lit(0)).alias("ids"),
        "n",
        *PARTS,
        *FLAGS,
    ).where(F.col("w") > 0)
    per_status = weighed.groupBy(F.col("status").alias("k_status"), "slot", "bin").agg(
        *[
            F.sum((F.col(part).cast(S.WHOLE) * F.col("w")).cast(S.WHOLE)).alias(name)
            for part, name in [("ids", "p_ids"), ("n", "n"), *zip(PARTS, PARTS, strict=True)]
        ],
        *[F.max(flag).alias(flag) for flag in FLAGS],
    )
    merged = merge_bins(per_status, ["status"], ["total"], {"ids": "count"})
    status_as, count_as, mean_as = names
    return merged.select(
        F.when(F.col("status") == 0, labels[0]).otherwise(labels[1]).alias(status_as),
        F.col("ids").cast(S.WHOLE).alias(count_as),
        exact_mean(F.col("total")).alias(mean_as),
    )


def _rows_per_unit(dedup_right: bool) -> tuple[Column, Column]:
    """Joined rows, treated and untreated, that one unit row of a key yields."""
    positive, other = F.coalesce("positive", F.lit(0)), F.coalesce("other", F.lit(1))
    if dedup_right:
        treated = (positive > 0).cast("int")
        return treated, 1 - treated
    return positive, other


def first_match_segment(
    df: DataFrame,
    flags: Sequence[tuple[S.ColumnOrName, str]],
    default: str,
    id_col: str,
    outcome: str,
    predicate: Column | None = None,
    *,
    exact: bool = False,
    segment_as: str = "segment",
    count_as: str = "count",
    mean_as: str | None = None,
) -> DataFrame:
    """Size and mean outcome per label, each row taking the first flag that is true.

    With `exact`, the mean of a double is the double nearest to the true mean, whatever
    the order of the rows, for a second small aggregation.
    """
    mean_name = mean_as or f"avg_{outcome}"
    S.distinct_names([segment_as, count_as, mean_name])
    kept = df if predicate is None else df.where(predicate)
    if exact and is_binary(df, outcome):
        label = S.first_match(flags, default)
        found = exact_aggregate(kept, {"s": label}, {"t": F.col(outcome)}, {"c": ("count", F.col(id_col))})
        return found.select(F.col("s").alias(segment_as), F.col("c").alias(count_as), exact_mean(F.col("t")).alias(mean_name))
    return kept.groupBy(S.first_match(flags, default).alias(segment_as)).agg(
        F.count(id_col).alias(count_as),
        S.mean(df, outcome).alias(mean_name),
    )


def plan_fulfilment(
    plan: DataFrame,
    actual: DataFrame,
    on: Sequence[str | tuple[str, str]],
    by: str,
    scale: int = 2,
    *,
    dedup_right: bool = False,
    planned_keys: int | None = None,
    co_located: bool = False,
    planned_as: str = "planned",
    completed_as: str = "completed",
    rate_as: str = "completion_rate",
) -> DataFrame:
    """Planned and completed rows per value of `by`, and the percentage completed.

    The result is that of plan left-joined to actual on the pairs in `on`: a
    plan row met by several actual rows counts once per actual row, both as
    planned and as completed; one with a NULL in its key counts as planned. With
    `dedup_right` every plan row counts once.

    The join is one row to one row per key and `by`. The other side is dealt to the join by an exchange of its
    own, not left where its aggregation put it, so that adaptive execution may
    split a key whose many values of `by` would otherwise fall to one task.

    With `planned_keys`, about how many keys the plan has (`key_count` finds out),
    actual rows that meet no plan row are left out by a filter before they are
    shuffled: worth it where most of them do not. With `co_located` both sides
    are joined where they lie: on tables bucketed alike by the keys, nothing is
    shuffled before the join; a hot key is then one task.
    """
    pairs = [(name, name) if isinstance(name, str) else name for name in on]
    S.distinct_names([by, planned_as, completed_as, rate_as])
    keys = [f"key_{i}" for i in range(len(pairs))]
    plan_keys = [F.col(left).alias(key) for (left, _), key in zip(pairs, keys, strict=True)]
    actual_keys = [F.col(right).alias(key) for (_, right), key in zip(pairs, keys, strict=True)]

    whole_key = reduce(and_, [F.col(key).isNotNull() for key in keys])
    planned = plan.select(*plan_keys, F.col(by).alias("by")).groupBy(*keys, "by").agg(F.count("*").alias("plan_rows"))
    met = F.lit(1).cast("bigint") if dedup_right else F.count("*")
    if planned_keys is None:
        matchable = actual.where(reduce(and_, [F.col(right).isNotNull() for _, right in pairs]))
    else:
        matchable = reduce_to_keys(actual, plan, [(right, left) for left, right in pairs], planned_keys)
    keyed = matchable.select(*actual_keys)
    if co_located:
        done, join_keys = keyed.groupBy(*keys).agg(met.alias("actual_rows")), keys
    else:
        # Rows without a whole key meet nothing; they are dealt by what they are grouped by.
        spread = F.when(whole_key, F.lit(0).cast("bigint")).otherwise(F.xxhash64("by"))
        planned = planned.withColumn("spread", spread)
        # The digest depends on the keys alone, so there is one row per key; but rows
        # dealt by both are not where a join on the keys needs them.
        digested = keyed.withColumn("digest", F.xxhash64(*keys))
        done = digested.groupBy(*keys, "digest").agg(met.alias("actual_rows")).drop("digest")
        # Always 0; a literal would be taken out of the join keys.
        done = done.withColumn("spread", F.least(F.col("actual_rows"), F.lit(0)).cast("bigint"))
        join_keys = [*keys, "spread"]

    plan_rows = F.col("plan_rows").cast(S.WHOLE)
    pairs_made = (plan_rows * F.col("actual_rows").cast(S.WHOLE)).cast(S.WHOLE)
    joined = planned.join(done, join_keys, "left").select(
        "by",
        F.coalesce(pairs_made, plan_rows).alias("planned"),
        F.coalesce(pairs_made, F.lit(0).cast(S.WHOLE)).alias("completed"),
    )
    totals = joined.groupBy("by").agg(
        F.sum("planned").alias("planned"), F.sum("completed").alias("completed")
    )
    return totals.select(
        F.col("by").alias(by),
        F.col("planned").alias(planned_as),
        F.col("completed").alias(completed_as),
        S.percent("completed", F.col("planned"), scale).alias(rate_as),
    )
