"""Properties that must hold on any data, checked on random data with hot keys and NULLs."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallywright import operators as op
from tests.conftest import rows

SEEDS = [1, 2, 3]


def half_up(part, total, scale=2):
    """Exact percentage, rounded half away from zero."""
    units = Fraction(part * 100, total) * 10**scale
    whole, rest = divmod(units.numerator, units.denominator)
    return Decimal(whole + (2 * rest >= units.denominator)).scaleb(-scale)


def skewed_key(rng, n):
    """A third of the keys hot, a tenth NULL, the rest spread."""
    draw = rng.random()
    return 0 if draw < 0.33 else None if draw < 0.43 else rng.randrange(n)


@pytest.fixture(params=SEEDS)
def rng(request):
    return random.Random(request.param)


@pytest.fixture
def table(spark, rng):
    data = [
        (i, skewed_key(rng, 40), rng.choice(["a", "b", "", None, "c"]), rng.choice([None, rng.randrange(-50, 99)]))
        for i in range(600)
    ]
    return spark.createDataFrame(data, "id int, k int, s string, m int")


def test_frequencies_and_shares_add_up(table):
    n = table.count()
    counts = rows(op.category_frequency(table, "k"))
    assert sum(count for _, count in counts) == n
    assert dict(counts) == Counter(row.k for row in table.collect())
    assert [count for _, count in counts] == sorted((count for _, count in counts), reverse=True)
    shares = rows(op.category_share(table, "k"))
    assert [row[:2] for row in shares] == counts
    assert [share for *_, share in shares] == [half_up(count, n) for _, count in counts]


def test_top_groups_are_a_prefix_of_all_frequencies(table):
    counts = rows(op.category_frequency(table, "k"))
    for k in (0, 1, 7, 1000):
        assert rows(op.top_groups(table, "k", "id", k)) == counts[:k]


def test_top_rows_are_a_prefix_of_all_rows(table):
    everything = sorted(table.collect(), key=lambda r: (r.m is not None, -(r.m or 0), r.id))
    assert rows(op.top_rows(table, "id", "m", 25)) == [(r.id, r.m) for r in everything[:25]]


def test_slots_equal_single_frequencies(table):
    both = table.select("s", F.col("k").cast("string").alias("k"))
    together = sorted(rows(op.slot_frequency(both, ["s", "k"])), key=str)
    apart = [(slot, *row) for slot in ("s", "k") for row in rows(op.category_frequency(both, slot))]
    assert together == sorted(apart, key=str)


def test_profile_means(table):
    groups = {}
    for row in table.collect():
        groups.setdefault((row.k, row.s), []).append(row.m)
    expected = []
    for key, measures in groups.items():
        kept = [m for m in measures if m is not None]
        mean = None
        if kept:
            mean = (Decimal(sum(kept)) / len(kept)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        expected.append((*key, len(measures), mean))
    assert sorted(rows(op.segment_profile(table, ["k", "s"], ["m"])), key=str) == sorted(expected, key=str)


@pytest.fixture
def sides(spark, rng):
    left = [
        (skewed_key(rng, 30), rng.randrange(5), rng.choice("xyz"), rng.choice([None, rng.randrange(9)]))
        for _ in range(400)
    ]
    right = [(skewed_key(rng, 30), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, 0, 1])) for _ in range(300)]
    return (
        spark.createDataFrame(left, "k int, day int, kind string, m int"),
        spark.createDataFrame(right, "k int, day int, flag int"),
    )


def test_comparison_equals_the_join_row_by_row(sides):
    left, right = sides[0].collect(), sides[1].collect()
    joined = []
    for unit in left:
        met = [row.flag for row in right if unit.k is not None and row.k == unit.k] or [None]
        joined += [(unit, (flag or 0) > 0) for flag in met]
    expected = {}
    for status, treated in (("treated", True), ("untreated", False)):
        mine = [unit for unit, t in joined if t is treated]
        outcomes = [unit.m for unit in mine if unit.m is not None]
        expected[status] = (sum(unit.k is not None for unit in mine), sum(outcomes) / len(outcomes))
    found = {status: rest for status, *rest in rows(op.treatment_comparison(*sides, "k", "flag", "m"))}
    assert {status: tuple(rest) for status, rest in found.items()} == expected


def test_deduplicated_comparison_counts_units_once(sides):
    left, right = sides[0].collect(), sides[1].collect()
    positive = {row.k for row in right if row.k is not None and (row.flag or 0) > 0}
    found = {row[0]: row[1] for row in rows(op.treatment_comparison(*sides, "k", "flag", "m", dedup_right=True))}
    with_id = [unit for unit in left if unit.k is not None]
    treated = sum(unit.k in positive for unit in with_id)
    assert found == {"treated": treated, "untreated": len(with_id) - treated}


@pytest.mark.parametrize("dedup", [False, True])
def test_fulfilment_equals_the_join_row_by_row(sides, dedup):
    left, right = sides[0].collect(), sides[1].collect()
    actual = [(row.k, row.day) for row in right if row.k is not None and row.day is not None]
    met = Counter(set(actual) if dedup else actual)
    planned, completed = Counter(), Counter()
    for row in left:
        n = met[row.k, row.day]
        planned[row.kind] += n or 1
        completed[row.kind] += n
    expected = [(kind, planned[kind], completed[kind], half_up(completed[kind], planned[kind])) for kind in planned]
    found = rows(op.plan_fulfilment(*sides, ["k", "day"], "kind", dedup_right=dedup))
    assert sorted(found) == sorted(expected)
    assert all(done <= total for _, total, done, _ in found)


ALL = {
    "frequency": lambda t: op.category_frequency(t, "k"),
    "share": lambda t: op.category_share(t, "k", F.col("m") > 3),
    "summary": lambda t: op.numeric_summary(t, ["m", "id"]),
    "profile": lambda t: op.segment_profile(t, ["s", "k"], ["m"]),
    "top groups": lambda t: op.top_groups(t, "s", "id", 3),
    "top rows": lambda t: op.top_rows(t, "id", "m", 9),
    "segment": lambda t: op.first_match_segment(
        t, [(F.col("m") > 50, "high"), (F.col("m") > 0, "low")], "no", "id", "m"
    ),
    "comparison": lambda t: op.treatment_comparison(t, t, "k", "m", "id"),
    "fulfilment": lambda t: op.plan_fulfilment(t, t.where("m > 0"), ["k", "m"], "s"),
    "cohorts": lambda t: op.repeat_cohorts(
        t.select("k", F.date_add(F.lit("2020-02-29").cast("date"), F.col("m")).alias("d")), "k", "d", "2024-12-03"
    ),
}


@pytest.mark.parametrize("name", ALL)
def test_result_depends_neither_on_layout_nor_on_code_generation(spark, conf, table, name):
    expected = sorted(rows(ALL[name](table)), key=str)
    for layout in (table.coalesce(1), table.repartition(7), table.repartition(5, "k")):
        assert sorted(rows(ALL[name](layout)), key=str) == expected
    conf(adaptive__enabled="false", autoBroadcastJoinThreshold="-1")
    assert sorted(rows(ALL[name](table)), key=str) == expected
    conf(codegen__wholeStage="false", codegen__factoryMode="NO_CODEGEN")
    assert sorted(rows(ALL[name](table)), key=str) == expected
    conf(ansi__enabled="false")
    assert sorted(rows(ALL[name](table)), key=str) == expected


@pytest.fixture
def dated(spark, rng):
    start = dt.date(2019, 2, 25)
    data = [
        (i, skewed_key(rng, 150), rng.choice([None, *[start + dt.timedelta(days=rng.randrange(2200))] * 12]))
        for i in range(900)
    ]
    return spark.createDataFrame(data, "id int, user int, day date")


def full_years(since, until):
    if since > until:
        return -full_years(until, since)
    return until.year - since.year - ((until.month, until.day) < (since.month, since.day))


def mean(values):
    kept = [value for value in values if value is not None]
    return sum(kept) / len(kept) if kept else None


def test_cohorts_equal_brute_force(dated):
    as_of = dt.date(2022, 2, 28)  # before some first events
    per_user = {}
    for row in dated.collect():
        per_user.setdefault(row.user, []).append(row.day)
    groups = {}
    for user, days in per_user.items():
        n, known = len(days), [day for day in days if day is not None]
        if n < 2:
            continue
        first, last = (min(known), max(known)) if known else (None, None)
        span = (last - first).days if known else None
        band = "2-3" if n <= 3 else "4-5" if n <= 5 else "6+"
        key = (first.year if known else None, band)
        gap = None if span is None else span // (n - 1)
        groups.setdefault(key, []).append((user, n, span, gap, full_years(first, as_of) if known else None))
    expected = []
    for key, users in groups.items():
        ids, *columns = zip(*users, strict=True)
        expected.append((*key, sum(user is not None for user in ids), *map(mean, columns)))
    found = rows(op.repeat_cohorts(dated, "user", "day", as_of))
    assert len(found) > 5
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert found == sorted(found, key=lambda row: (row[0] is None, row[0] or 0, row[1]))


def test_volumes_equal_brute_force(dated):
    first, last = dt.date(2020, 2, 29), dt.date(2021, 12, 31)
    days = [row.day for row in dated.collect() if row.day is not None and first <= row.day <= last]
    expected = sorted(Counter(day.replace(day=1) for day in days).items())
    assert rows(op.monthly_volume(dated, "day", "id", first, last)) == expected


def test_segments_equal_brute_force(table):
    found = rows(op.first_match_segment(table, [(F.col("m") > 50, "high"), (F.col("k") == 0, "hot")], "no", "k", "m"))
    groups = {}
    for row in table.collect():
        label = "high" if (row.m or 0) > 50 else "hot" if row.k == 0 else "no"
        groups.setdefault(label, []).append(row)
    expected = [
        (label, sum(row.k is not None for row in group), mean([row.m for row in group]))
        for label, group in groups.items()
    ]
    assert sorted(found) == sorted(expected)


def test_summary_equals_brute_force(table):
    known = [row.m for row in table.collect() if row.m is not None]
    average = (Decimal(sum(known)) / len(known)).quantize(Decimal("0.01"), ROUND_HALF_UP)
    assert rows(op.numeric_summary(table, ["m"])) == [(average, min(known), max(known))]
