"""One test per rule of the semantic contract."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from fractions import Fraction
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tallywright import functions as fn
from tallywright import operators as op
from tallywright.functions import semantics as S
from tests.conftest import rows


def values(spark, schema, *data):
    return spark.createDataFrame([row if isinstance(row, tuple) else (row,) for row in data], schema)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def date_lit(text):
    return F.lit(None).cast("date") if text is None else S.day_literal(text)


def no_codegen(conf):
    conf(codegen__wholeStage="false", codegen__factoryMode="NO_CODEGEN")


# -- keys and NULLs ---------------------------------------------------------


def test_null_and_empty_keys_are_two_groups(spark):
    df = values(spark, "k string", None, None, None, "", "", "a")
    assert rows(op.category_frequency(df, "k")) == [(None, 3), ("", 2), ("a", 1)]
    assert rows(op.slot_frequency(df, ["k"])) == [("k", None, 3), ("k", "", 2), ("k", "a", 1)]
    assert rows(op.top_groups(df.withColumn("id", F.lit(1)), "k", "id", 2)) == [(None, 3), ("", 2)]


def test_top_groups_counts_non_null_only(spark):
    df = values(spark, "k string, id int", ("a", None), ("a", None), ("a", 1), ("b", 1), ("b", 2), ("c", None))
    assert rows(op.top_groups(df, "k", "id", 3)) == [("b", 2), ("a", 1), ("c", 0)]


def test_group_without_values_has_null_mean(spark):
    df = values(spark, "k string, m decimal(12,1)", ("a", None), ("a", None), ("b", Decimal(3)))
    assert rows(op.segment_profile(df, ["k"], ["m"])) == [("a", 2, None), ("b", 1, Decimal("3.00"))]


@pytest.mark.parametrize("codegen", [True, False])
def test_summary_of_nothing(spark, conf, codegen):
    if not codegen:
        no_codegen(conf)
    df = values(spark, "m decimal(12,1)", None)
    assert rows(op.numeric_summary(df, ["m"])) == [(None, None, None)]
    assert rows(op.numeric_summary(df.limit(0), ["m"])) == [(None, None, None)]


def test_averages_skip_their_own_nulls(spark):
    df = values(spark, "low int, high int", (112000, 70000), (None, 70000), (None, 80000))
    assert rows(op.numeric_summary(df, ["low", "high"]))[0][:2] == (Decimal("112000.00"), Decimal("73333.33"))


# -- rounding ---------------------------------------------------------------


def test_percent_rounds_half_away_from_zero(spark):
    assert one(spark, fn.percent(F.lit(1), F.lit(800))) == Decimal("0.13")  # 0.125
    assert one(spark, fn.percent(F.lit(201), F.lit(20000))) == Decimal("1.01")  # 1.005
    assert one(spark, fn.percent(F.lit(2), F.lit(3), 4)) == Decimal("66.6667")


def test_percent_does_not_round_twice(spark):
    # 0.0049999957 would become 0.005000 at six digits and 0.01 at two.
    assert one(spark, fn.percent(F.lit(49999957), F.lit(10**12))) == Decimal("0.00")


def test_mean_rounds_exactly(spark):
    halves = values(spark, "m decimal(12,2)", Decimal("1000.01"), Decimal("1000.02"))
    assert rows(op.numeric_summary(halves, ["m"]))[0][0] == Decimal("1000.02")  # 1000.015
    negative = values(spark, "m decimal(12,2)", Decimal("-1000.01"), Decimal("-1000.02"))
    assert rows(op.numeric_summary(negative, ["m"]))[0][0] == Decimal("-1000.02")
    # 0.0049999975: avg of decimal(12,1) keeps five digits and would give 0.01.
    near = spark.range(400_001).select(F.when(F.col("id") < 20000, Decimal("0.1")).otherwise(0).alias("m"))
    near = near.select(F.col("m").cast("decimal(12,1)"))
    assert rows(op.numeric_summary(near, ["m"]))[0][0] == Decimal("0.00")


def test_mean_of_large_integers_is_exact(spark):
    df = values(spark, "m bigint", 2**62, 2**62, 2**62, 2**62 + 2)
    assert rows(op.numeric_summary(df, ["m"], 1))[0][0] == Decimal(2**62) + Decimal("0.5")


def test_shares_with_a_given_denominator(spark):
    df = values(spark, "k string", "a", "a", "b")
    assert rows(op.category_share(df, "k", denominator=8)) == [
        ("a", 2, Decimal("25.00")),
        ("b", 1, Decimal("12.50")),
    ]
    with pytest.raises(ValueError, match="denominator"):
        op.category_share(df, "k", denominator=0)


def test_share_of_no_rows(spark):
    df = values(spark, "k string", "a")
    assert rows(op.category_share(df, "k", F.col("k") == "z")) == []


# -- integers and dates -----------------------------------------------------


@pytest.mark.parametrize(
    ("part", "by", "expected"), [(7, 2, 3), (-7, 2, -3), (663670, 25, 26546), (45136, 6, 7522), (5, 0, None)]
)
def test_whole_div_truncates(spark, part, by, expected):
    assert one(spark, fn.whole_div(F.lit(part), F.lit(by))) == expected


def events(spark, *data):
    return spark.createDataFrame(
        [(user, None if day is None else dt.date.fromisoformat(day)) for user, day in data], "user bigint, day date"
    )


def cohorts(df, **options):
    return rows(op.repeat_cohorts(df, "user", "day", "2024-12-03", **options))


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("codegen", [True, False])
def test_single_events_do_not_divide_by_zero(spark, conf, codegen, ansi):
    conf(ansi__enabled=ansi)
    if not codegen:
        no_codegen(conf)
    df = events(spark, (1, "2020-01-01"), (2, "2020-01-01"), (2, "2020-01-04"), (2, "2020-01-08"))
    assert cohorts(df) == [(2020, "2-3", 1, 3.0, 7.0, 3.0, 4.0)]
    assert cohorts(df, min_events=1, bands=[(1, 1, "1")], other_band="2+") == [
        (2020, "1", 1, 1.0, 0.0, None, 4.0),
        (2020, "2+", 1, 3.0, 7.0, 3.0, 4.0),
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Tokyo"])
@pytest.mark.parametrize(
    ("since", "until", "years"),
    [
        ("2020-02-29", "2023-02-28", 2),
        ("2020-02-29", "2023-03-01", 3),
        ("2020-02-29", "2024-02-29", 4),
        ("2010-12-03", "2024-12-02", 13),
        ("2010-12-03", "2024-12-03", 14),
        ("2017-10-15", "2018-10-15", 1),  # midnight does not exist in one zone
        ("0214-12-31", "2024-12-03", 1809),
        ("2025-06-01", "2024-12-03", 0),
        ("2026-12-03", "2024-12-03", -2),
        ("2026-12-02", "2024-12-03", -1),
        (None, "2024-12-03", None),
    ],
)
def test_completed_years(spark, conf, zone, since, until, years):
    conf(session__timeZone=zone)
    assert one(spark, fn.completed_years(date_lit(since), date_lit(until))) == years


def test_null_dates_count_as_events(spark):
    df = events(spark, (1, "2020-01-01"), (1, None), (1, "2020-01-08"), (2, None), (2, None))
    # Two intervals, not one; and a user without any date has a cohort of its own.
    assert cohorts(df) == [(2020, "2-3", 1, 3.0, 7.0, 3.0, 4.0), (None, "2-3", 1, 2.0, None, None, None)]


def test_events_without_user_enter_means_only(spark):
    df = events(spark, (None, "2020-01-01"), (None, "2020-01-03"), (1, "2020-01-01"), (1, "2020-01-01"), (1, None))
    assert cohorts(df) == [(2020, "2-3", 1, 2.5, 1.0, 1.0, 4.0)]


def test_as_of_defaults_to_today(spark):
    this_year = dt.date.today().year
    df = events(spark, (1, "2000-01-01"), (1, "2000-01-02"))
    assert rows(op.repeat_cohorts(df, "user", "day"))[0][-1] == this_year - 2000


def test_ancient_dates_survive_parquet(spark, tmp_path):
    df = events(spark, (1, "0201-05-01"), (1, "2018-06-01"))
    df.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(str(day) for _, day in rows(back)) == ["0201-05-01", "2018-06-01"]
    assert cohorts(back)[0][:2] == (201, "2-3")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_range_includes_its_last_day(spark, conf, kind, zone):
    conf(session__timeZone=zone)
    stamps = ["2021-12-31 23:59:59", "2022-01-01 00:00:00", "2023-12-31 00:00:00", "2023-12-31 10:00:00"]
    text = values(spark, "id int, t string", *enumerate([*stamps, "2024-01-01 00:00:00", None]))
    df = text.select("id", F.col("t").cast("timestamp_ntz").cast(kind).alias("t"))
    found = rows(op.monthly_volume(df, "t", "id", "2022-01-01", "2023-12-31"))
    assert found == [(dt.date(2022, 1, 1), 1), (dt.date(2023, 12, 1), 2)]


def test_range_at_the_end_of_the_calendar(spark):
    df = values(spark, "id int, t date", (1, dt.date(9999, 12, 31)))
    assert rows(op.monthly_volume(df, "t", "id", "9999-01-01", "9999-12-31")) == [(dt.date(9999, 12, 1), 1)]


def test_bucket_may_be_named_like_an_input_column(spark):
    df = values(spark, "id int, month date", (1, dt.date(2022, 1, 3)), (2, dt.date(2022, 1, 9)))
    assert rows(op.monthly_volume(df, "month", "id", "2022-01-01", "2022-12-31")) == [(dt.date(2022, 1, 1), 2)]


@pytest.mark.parametrize(("unit", "first"), [("year", 1), ("quarter", 4), ("month", 5)])
def test_other_units(spark, unit, first):
    df = values(spark, "id int, t date", (1, dt.date(2022, 5, 17)))
    result = op.monthly_volume(df, "t", "id", "2022-01-01", "2022-12-31", unit=unit)
    assert result.columns == [unit, "count"]
    assert rows(result) == [(dt.date(2022, first, 1), 1)]


def test_unknown_unit_is_refused(spark):
    with pytest.raises(ValueError, match="unit"):
        fn.date_bucket("t", "fortnight")


def test_a_timestamp_is_no_day():
    with pytest.raises(TypeError):
        S.day_literal(dt.datetime(2022, 1, 1))


# -- order ------------------------------------------------------------------


def test_top_rows_puts_null_first_and_breaks_ties(spark):
    df = values(spark, "id int, m int", (1, 5), (2, None), (9, 7), (4, 7), (3, 7))
    assert rows(op.top_rows(df, "id", "m", 3)) == [(2, None), (3, 7), (4, 7)]


def test_top_groups_breaks_ties_by_key(spark):
    df = values(spark, "k string, id int", *[(k, 1) for k in "ddccbbaaa"])
    assert rows(op.top_groups(df, "k", "id", 2)) == [("a", 3), ("b", 2)]


def test_cohorts_sort_null_year_last(spark):
    df = events(spark, (1, None), (1, None), (2, "2020-01-01"), (2, "2020-01-01"))
    assert [row[0] for row in cohorts(df)] == [2020, None]


# -- text and cases ---------------------------------------------------------


def test_phrases_are_case_sensitive_and_literal(spark):
    df = values(spark, "t string", "Аналитик данных", "аналитик данных", None, "100%", "100", "a_b", "axb")
    assert rows(op.keyword_count(df, "t", ["Аналитик данных"])) == [(1,)]
    assert rows(op.keyword_count(df, "t", ["100%", "a_b"])) == [(2,)]
    with pytest.raises(ValueError, match="phrase"):
        op.keyword_count(df, "t", [])


def test_a_text_with_both_phrases_counts_once(spark):
    assert rows(op.keyword_count(values(spark, "t string", "x y", "x", "z"), "t", ["x", "y"])) == [(2,)]


def test_phrase_at_the_very_end_of_a_long_text(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 2_000_000), F.lit("end")).alias("t"))
    assert rows(op.keyword_count(df, "t", ["aend"])) == [(1,)]


def test_first_true_flag_wins(spark):
    df = values(
        spark,
        "id int, a boolean, b boolean, m int",
        (1, True, True, 1),
        (2, None, True, 3),
        (3, None, None, None),
        (4, False, None, 8),
        (None, True, None, 4),
    )
    result = op.first_match_segment(df, [("a", "first"), ("b", "second")], "none", "id", "m")
    assert sorted(rows(result)) == [("first", 1, 2.5), ("none", 2, 8.0), ("second", 1, 3.0)]
    kept = op.first_match_segment(df, [("a", "first")], "none", "id", "m", F.col("m") > 3)
    assert sorted(rows(kept)) == [("first", 0, 4.0), ("none", 1, 8.0)]


def test_no_flags_leave_the_default(spark):
    df = values(spark, "id int, m int", (1, 2))
    assert rows(op.first_match_segment(df, [], "none", "id", "m")) == [("none", 1, 2.0)]


def test_column_names_in_cyrillic(spark):
    df = values(spark, "id int, `метка` boolean, m int", (1, True, 2))
    result = op.first_match_segment(df, [("метка", "да")], "нет", "id", "m", segment_as="сеть", count_as="всего")
    assert result.columns == ["сеть", "всего", "avg_m"]
    assert rows(result) == [("да", 1, 2.0)]


# -- joins ------------------------------------------------------------------


def compare(spark, units, treatment, **options):
    left = spark.createDataFrame(units, "id bigint, m int")
    right = spark.createDataFrame(treatment, "unit bigint, flag int")
    return sorted(rows(op.treatment_comparison(left, right, ("id", "unit"), "flag", "m", **options)))


def test_treatment_rows_multiply_units(spark):
    units = [(1, 10), (2, 20), (3, 60), (None, 5)]
    treatment = [(1, 2), (1, 3), (1, 0), (2, None), (9, 1), (None, 1)]
    # Unit 1: two treated rows, one not; 2 and 3 untreated; no id: untreated, uncounted.
    expected = [("treated", 2, 10.0), ("untreated", 3, (10 + 20 + 60 + 5) / 4)]
    assert compare(spark, units, treatment) == expected
    expected = [("treated", 1, 10.0), ("untreated", 2, (20 + 60 + 5) / 3)]
    assert compare(spark, units, treatment, dedup_right=True) == expected


def test_absent_status_has_no_row(spark):
    assert compare(spark, [(1, 10)], [(1, 1)]) == [("treated", 1, 10.0)]
    assert compare(spark, [(1, 10)], []) == [("untreated", 1, 10.0)]
    assert compare(spark, [], [(1, 1)]) == []


def test_outcomes_may_be_missing(spark):
    assert compare(spark, [(1, None), (2, None), (3, 4)], [(1, 1)]) == [
        ("treated", 1, None),
        ("untreated", 2, 4.0),
    ]


def test_infinite_outcome_stays_with_its_status(spark):
    units = spark.createDataFrame([(1, float("inf")), (2, 3.0)], "id int, m double")
    treatment = spark.createDataFrame([(1, 1)], "id int, flag int")
    result = op.treatment_comparison(units, treatment, "id", "flag", "m", ("yes", "no"))
    assert sorted(rows(result)) == [("no", 1, 3.0), ("yes", 1, float("inf"))]


def test_decimal_outcomes(spark):
    units = spark.createDataFrame([(1, Decimal("0.1")), (2, Decimal("0.2"))], "id int, m decimal(12,1)")
    treatment = spark.createDataFrame([(1, 1)] * 3, "id int, flag int")
    result = op.treatment_comparison(units, treatment, "id", "flag", "m")
    assert sorted(rows(result)) == [("treated", 3, pytest.approx(0.1)), ("untreated", 1, 0.2)]


def fulfil(spark, plan, actual, **options):
    left = spark.createDataFrame(plan, "user bigint, day int, kind string")
    right = spark.createDataFrame(actual, "user bigint, day int")
    return sorted(rows(op.plan_fulfilment(left, right, ["user", "day"], "kind", **options)))


def test_actual_rows_multiply_plans(spark):
    plan = [(1, 1, "a"), (1, 2, "a"), (None, 1, "a"), (2, None, "a"), (1, 1, "b")]
    actual = [(1, 1), (1, 1), (None, 1), (2, None), (3, 3)]
    # The day met twice counts twice; NULL keys are planned but never met.
    assert fulfil(spark, plan, actual) == [("a", 5, 2, Decimal("40.00")), ("b", 2, 2, Decimal("100.00"))]
    assert fulfil(spark, plan, actual, dedup_right=True) == [
        ("a", 4, 1, Decimal("25.00")),
        ("b", 1, 1, Decimal("100.00")),
    ]


def test_keys_may_have_different_names(spark):
    plan = spark.createDataFrame([(1, 1, None), (1, 2, None)], "user int, day int, kind string")
    actual = spark.createDataFrame([(1, 1)], "who int, day int")
    result = op.plan_fulfilment(plan, actual, [("user", "who"), "day"], "kind")
    assert rows(result) == [(None, 2, 1, Decimal("50.00"))]


def test_plan_compared_with_itself(spark):
    plan = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 1, "b")], "user int, day int, kind string")
    result = op.plan_fulfilment(plan, plan, ["user", "day"], "kind")
    assert sorted(rows(result)) == [("a", 4, 4, Decimal("100.00")), ("b", 1, 1, Decimal("100.00"))]


def test_plan_keys_may_include_the_group(spark):
    plan = spark.createDataFrame([(1, "a"), (2, "b")], "user int, kind string")
    result = op.plan_fulfilment(plan, plan.where("user = 1"), ["user", "kind"], "kind")
    assert sorted(rows(result)) == [("a", 1, 1, Decimal("100.00")), ("b", 1, 0, Decimal("0.00"))]


def test_large_groups_do_not_produce_pairs(spark):
    """Ten billion joined rows, from a hundred thousand on each side."""
    many = spark.range(100_000).select(F.lit(1).alias("user"), F.lit("a").alias("kind"), F.lit(1).alias("m"))
    fulfilled = op.plan_fulfilment(many, many.select("user"), ["user"], "kind")
    assert rows(fulfilled) == [("a", 10**10, 10**10, Decimal("100.00"))]
    compared = op.treatment_comparison(many, many.select("user", "m"), "user", "m", "m")
    assert rows(compared) == [("treated", 10**10, 1.0)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_pairs_beyond_a_bigint(spark, conf, ansi):
    """Counts of a hot key above three billion on both sides, put in as combined rows."""
    conf(ansi__enabled=ansi)
    n = 3_100_000_000
    assert one(spark, F.lit(n).cast(fn.semantics.WHOLE) * F.lit(n).cast(fn.semantics.WHOLE)) == n * n
    side = spark.range(1).select(F.lit(1).alias("k"), F.lit("a").alias("kind"), F.lit(Decimal("1.5")).alias("m"))
    many = reduce(lambda df, _: df.unionAll(df), range(8), side)  # 256 rows, 65536 pairs
    assert rows(op.plan_fulfilment(many, many, ["k"], "kind")) == [("a", 65536, 65536, Decimal("100.00"))]
    assert one(spark, fn.percent(F.lit(Decimal(n * n)), F.lit(Decimal(n * n)))) == Decimal("100.00")
    assert one(spark, fn.percent(F.lit(Decimal(n * n // 3)), F.lit(Decimal(n * n)))) == Decimal("33.33")


def test_small_decimal_outcomes_keep_their_digits(spark):
    for kind, values in (("decimal(20,10)", ["0.0000000001", "0.0000000002"]), ("decimal(38,18)", ["1.234567890123456789"])):
        units = spark.createDataFrame([(1, Decimal(v)) for v in values], f"id int, m {kind}")
        treatment = spark.createDataFrame([(1, 1)] * 3, "id int, flag int")
        [(_, count, mean)] = rows(op.treatment_comparison(units, treatment, "id", "flag", "m"))
        assert count == 3 * len(values)
        assert mean == pytest.approx(float(sum(Fraction(v) for v in values) / len(values)), rel=1e-15)


def test_results_may_be_called_like_keys(spark):
    frame = spark.createDataFrame([(1, "x")] * 7 + [(9, "x")] * 3, "count int, id string")
    assert rows(op.top_groups(frame, "count", "id", 1, count_as="n")) == [(1, 7)]
    shares = op.category_share(frame.withColumnRenamed("count", "percent"), "percent", percent_as="share")
    assert rows(shares) == [(1, 7, Decimal("70.00")), (9, 3, Decimal("30.00"))]
    profile = op.segment_profile(frame, ["count"], ["count"], count_as="n")
    assert rows(profile) == [(1, 7, Decimal("1.00")), (9, 3, Decimal("9.00"))]
    for call in (
        lambda: op.top_groups(frame, "count", "id", 1),
        lambda: op.category_frequency(frame, "count"),
        lambda: op.category_share(frame, "count"),
        lambda: op.slot_frequency(frame, ["id"], value_as="COUNT"),
        lambda: op.segment_profile(frame, ["count"], []),
        lambda: op.plan_fulfilment(frame, frame, ["id"], "completion_rate"),
        lambda: op.treatment_comparison(frame, frame, "id", "count", "count", count_as="status"),
    ):
        with pytest.raises(ValueError, match="two output columns"):
            call()


def test_binary_fractions_have_no_exact_mean(spark):
    """None in one aggregation, that is: operators take two (`test_exact.py`)."""
    frame = spark.createDataFrame([(0.1,)], "m double")
    with pytest.raises(TypeError, match="decimal"):
        fn.rounded_mean(frame, "m")


@pytest.mark.parametrize(
    ("kind", "values", "scale", "expected"),
    [
        ("decimal(38,2)", ["1.00", "2.00", "2.00"], 8, "1.66666667"),
        ("decimal(4,2)", ["-0.01", "-0.02"], 2, "-0.02"),
        ("decimal(4,2)", ["0.01", "0.02"], 2, "0.02"),
        ("bigint", [2**62, 2**62, 2**62 + 1], 0, str(2**62)),
        ("int", [1, 2], 0, "2"),
    ],
)
def test_means_round_once(spark, kind, values, scale, expected):
    frame = spark.createDataFrame([(Decimal(v) if "decimal" in kind else v,) for v in values], f"m {kind}")
    assert rows(frame.agg(fn.rounded_mean(frame, "m", scale)))[0][0] == Decimal(expected)


def test_percent_of_odd_totals(spark):
    part, total = 2315800000011, 4000000000019
    assert one(spark, fn.percent(F.lit(part), F.lit(total))) == Decimal("57.89")
    assert one(spark, fn.percent(F.lit(5), Decimal("2.5"))) == Decimal("200.00")
    assert one(spark, fn.percent(F.lit(1), Decimal("0.4"))) == Decimal("250.00")
    assert one(spark, fn.percent(F.lit(1), F.lit(0))) is None
    with pytest.raises(ValueError, match="positive"):
        fn.percent(F.lit(1), 0)


def test_column_names_in_another_letter_case(spark):
    frame = spark.createDataFrame([(Decimal("1.50"), 1)], "Salary decimal(4,2), Id int")
    assert rows(op.numeric_summary(frame, ["salary"])) == [(Decimal("1.50"),) * 3]
    assert rows(op.treatment_comparison(frame, frame, "id", "ID", "salary")) == [("treated", 1, 1.5)]


def test_a_single_text_is_no_list_of_phrases(spark):
    frame = spark.createDataFrame([("gold",)], "name string")
    with pytest.raises(TypeError):
        op.keyword_count(frame, "name", "ring")


def test_bands_must_reach_down_to_the_fewest_events(spark):
    frame = spark.createDataFrame([(1, None)], "u int, d date")
    with pytest.raises(ValueError, match="no band"):
        op.repeat_cohorts(frame, "u", "d", min_events=1)
    with pytest.raises(ValueError, match="no band"):
        op.repeat_cohorts(frame, "u", "d", bands=((2, 3, "2-3"), (5, 6, "5-6")))
