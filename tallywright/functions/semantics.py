"""Column helpers that fix the result semantics the reports depend on.

Each helper is a composition of built-in Spark functions, so it stays inside
whole-stage code generation, and each gives the same answer with ANSI mode on
or off, with code generation on or off, and in any session time zone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DateLike = dt.date | str
ColumnOrName = Column | str

# Units for which `trunc` yields a DATE; any other word makes it yield NULL.
BUCKET_UNITS = ("year", "quarter", "month", "week")

# Whole numbers of any size that sums and products of counts can reach.
WHOLE = "decimal(38,0)"


def as_column(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def data_type(df: DataFrame, col: ColumnOrName) -> T.DataType:
    """Type of a column, found as Spark finds it: in any letter case where names ignore it."""
    return df.select(as_column(col)).schema[0].dataType


def distinct_names(names: Iterable[str]) -> None:
    """Raises unless the output columns can be told apart, letter case aside."""
    seen = set()
    for name in names:
        if name.lower() in seen:
            raise ValueError(f"two output columns would be called {name!r}")
        seen.add(name.lower())


def day_literal(value: DateLike) -> Column:
    """A DATE literal; by way of text, as Python dates of early years do not convert."""
    if isinstance(value, dt.datetime):
        raise TypeError("a day is expected, not a timestamp")
    day = value if isinstance(value, dt.date) else dt.date.fromisoformat(value)
    return F.lit(day.isoformat()).cast("date")


# -- ordering ---------------------------------------------------------------


def largest_first(col: ColumnOrName) -> Column:
    """Descending with NULL on top, which decides what a top-k keeps."""
    return as_column(col).desc_nulls_first()


def smallest_first(col: ColumnOrName) -> Column:
    """Ascending with NULL at the end."""
    return as_column(col).asc_nulls_last()


# -- numbers ----------------------------------------------------------------


def whole_div(part: ColumnOrName, by: ColumnOrName) -> Column:
    """Integer quotient, truncated towards zero; NULL for a zero divisor.

    The divisor is guarded here rather than by a filter on the rows, because
    the optimizer may evaluate the division before the filter.
    """
    return F.call_function("div", as_column(part), F.nullif(as_column(by), F.lit(0)))


def shifted(whole: Column, digits: int) -> Column:
    """A whole number divided by a power of ten, exactly."""
    if not digits:
        return whole.cast(WHOLE)
    # These two precisions make a product of 38 digits that keeps its scale.
    unit = F.lit(Decimal(1).scaleb(-digits)).cast(f"decimal({digits},{digits})")
    return whole.cast(f"decimal({37 - digits},0)") * unit


def rounded_quotient(part: Column, by: Column, scale: int) -> Column:
    """`part` / `by`, whole numbers, rounded once and half away from zero; NULL for a zero divisor.

    Done by quotient and remainder: a decimal division would round first.
    """
    by = F.nullif(by.cast(WHOLE), F.lit(0).cast(WHOLE))
    size = F.abs(part.cast(WHOLE) * F.lit(Decimal(10**scale)))
    rest = size % by
    whole = ((size - rest) / by).cast(WHOLE) + F.when(rest * 2 >= by, 1).otherwise(0)
    return shifted(F.when(part < 0, -whole).otherwise(whole), scale)


def percent(part: ColumnOrName, total: ColumnOrName | int | Decimal, scale: int = 2) -> Column:
    """`part` as a percentage of `total`, rounded half away from zero.

    `part` is a count. `total` is a count, too, or a positive literal, which may
    have a fraction.
    """
    part = as_column(part).cast(WHOLE)
    if isinstance(total, int | Decimal):
        if total <= 0:
            raise ValueError("the denominator must be positive")
        over, under = Decimal(total).as_integer_ratio()
        return rounded_quotient(part * F.lit(Decimal(100 * under)), F.lit(Decimal(over)), scale)
    return rounded_quotient(part * F.lit(Decimal(100)), as_column(total), scale)


def unscaled(df: DataFrame, col: ColumnOrName) -> tuple[Column, int]:
    """Aggregate: exact sum in units of the last digit, and how many digits that are."""
    addend, digits = in_units(df, col)
    return whole_sum(F.sum(addend), digits), digits


def in_units(df: DataFrame, col: ColumnOrName) -> tuple[Column, int]:
    """What to add up for an exact sum, and how many digits it has after the point."""
    kind = data_type(df, col)
    if isinstance(kind, T.IntegralType):
        return as_column(col).cast("decimal(20,0)"), 0
    if not isinstance(kind, T.DecimalType):
        raise TypeError(f"an exact mean needs integers or decimals, not {kind.simpleString()}; cast to a decimal first")
    return as_column(col), kind.scale


def whole_sum(total: Column, digits: int) -> Column:
    """A sum of decimals in units of the last digit."""
    return total.cast(WHOLE) if not digits else (total * F.lit(Decimal(10**digits))).cast(WHOLE)


def mean(df: DataFrame, name: str) -> Column:
    """Aggregate: unrounded mean of `name` as a double.

    `avg` of a decimal stops four digits after its input; this does not.
    """
    if isinstance(data_type(df, name), T.DecimalType):
        return F.sum(name).cast("double") / F.nullif(F.count(name), F.lit(0))
    return F.avg(name)


def rounded_mean(df: DataFrame, name: str, scale: int = 2) -> Column:
    """Aggregate: mean of `name` over its non-NULL rows, rounded half away from zero, once.

    For integers and decimals; means of binary fractions depend on the order of
    the rows. A group without any value gives NULL.
    """
    total, digits = unscaled(df, name)
    count = F.count(as_column(name)).cast(WHOLE) * F.lit(Decimal(10**digits))
    return rounded_quotient(total, count, scale)


# -- dates ------------------------------------------------------------------


def day_span(first: ColumnOrName, last: ColumnOrName) -> Column:
    """Whole days from `first` to `last`."""
    return F.datediff(as_column(last), as_column(first))


def completed_years(since: ColumnOrName, until: ColumnOrName) -> Column:
    """Full years between two dates; counted towards zero if `since` is later.

    Works on calendar fields only: `months_between` takes 28 February for the
    anniversary of 29 February, and timestamp arithmetic depends on the session
    time zone.
    """
    since, until = as_column(since), as_column(until)

    def full_years(start: Column, end: Column) -> Column:
        not_reached = _day_in_year(end) < _day_in_year(start)
        return F.year(end) - F.year(start) - not_reached.cast("int")

    return F.when(since <= until, full_years(since, until)).otherwise(-full_years(until, since))


def _day_in_year(day: Column) -> Column:
    return F.month(day) * 100 + F.dayofmonth(day)


def date_bucket(col: ColumnOrName, unit: str = "month") -> Column:
    """First day of the year, quarter, month or week of a date or timestamp."""
    if unit not in BUCKET_UNITS:
        raise ValueError(f"unit must be one of {BUCKET_UNITS}, not {unit!r}")
    return F.trunc(as_column(col), unit)


def within_days(col: ColumnOrName, first: DateLike, last: DateLike) -> Column:
    """True from the start of day `first` to the end of day `last`.

    The bounds are half-open on the raw column: a timestamp on the last day is
    kept, and both bounds reach the Parquet scan.
    """
    day_after = F.date_add(day_literal(last), 1)
    return (as_column(col) >= day_literal(first)) & (as_column(col) < day_after)


def within_months(year_col: ColumnOrName, month_col: ColumnOrName, first: DateLike, last: DateLike) -> Column:
    """True for the years and months that hold any day from `first` to `last`.

    Uses the two columns alone, so on columns that a table's folders are laid out
    by it decides which folders are read.
    """

    def month_number(day: DateLike) -> int:
        if isinstance(day, dt.datetime):
            raise TypeError("a day is expected, not a timestamp")
        own = day if isinstance(day, dt.date) else dt.date.fromisoformat(day)
        return own.year * 12 + own.month

    number = as_column(year_col).cast("int") * 12 + as_column(month_col).cast("int")
    return number.between(month_number(first), month_number(last))


# -- text and cases ---------------------------------------------------------


def contains_any(col: ColumnOrName, phrases: Iterable[str]) -> Column:
    """True if the text holds at least one phrase, letter case included."""
    if isinstance(phrases, str):
        raise TypeError("a list of phrases is expected, not a single text")
    tests = [as_column(col).contains(phrase) for phrase in phrases]
    if not tests:
        raise ValueError("at least one phrase is needed")
    return reduce(or_, tests)


def first_match(arms: Sequence[tuple[ColumnOrName, str]], default: str) -> Column:
    """Label of the first arm that is true; NULL counts as false."""
    return _case([(as_column(test), label) for test, label in arms], default)


def band(col: ColumnOrName, bands: Sequence[tuple[int, int, str]], default: str) -> Column:
    """Label of the first closed range `(low, high, label)` that holds the value."""
    return _case([(as_column(col).between(low, high), label) for low, high, label in bands], default)


def _case(arms: Sequence[tuple[Column, str]], default: str) -> Column:
    if not arms:
        return F.lit(default)
    (test, label), *others = arms
    case = F.when(test, F.lit(label))
    for test, label in others:
        case = case.when(test, F.lit(label))
    return case.otherwise(F.lit(default))
