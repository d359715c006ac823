"""Activity over time: volumes per period and cohorts of repeat users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import semantics as S
from tallywright.sources.versions import VersionedTable

ACTIVITY = T.StructType(
    [
        T.StructField("user", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("first", T.DateType()),
        T.StructField("last", T.DateType()),
    ]
)


def monthly_volume(
    events: DataFrame,
    date_col: str,
    count_col: str,
    start: S.DateLike,
    end: S.DateLike,
    unit: str = "month",
    *,
    partitioned_by: tuple[str, str] | None = None,
    bucket_as: str | None = None,
    count_as: str = "count",
    sort: bool = True,
) -> DataFrame:
    """Events per month (or other unit) from day `start` to day `end`, both included.

    `partitioned_by` names the year and month columns that a table's folders are
    laid out by, with the day's own year and month in them: only folders of the
    range are then read.
    """
    bucket_as = bucket_as or unit
    S.distinct_names([bucket_as, count_as])
    in_range = events.where(S.within_days(date_col, start, end))
    if partitioned_by is not None:
        in_range = in_range.where(S.within_months(*partitioned_by, start, end))
    volume = in_range.groupBy(S.date_bucket(date_col, unit).alias(bucket_as)).agg(
        F.count(count_col).alias(count_as)
    )
    return volume.orderBy(S.smallest_first(bucket_as)) if sort else volume


def repeat_cohorts(
    events: DataFrame,
    user_col: str,
    date_col: str,
    as_of: S.DateLike | None = None,
    bands: Sequence[tuple[int, int, str]] = ((2, 3, "2-3"), (4, 5, "4-5")),
    other_band: str = "6+",
    min_events: int = 2,
    *,
    sort: bool = True,
) -> DataFrame:
    """Users with repeated events, by year of the first event and frequency band.

    Per user: events, days from first to last, mean gap in whole days, and full
    years from the first event to `as_of` (today if not given). Per cohort: the
    number of users and the means of those four.

    The bands must follow each other without a gap from `min_events` on;
    `other_band` is what lies above them.

    Rows count as events even where the date is NULL. Events without a user
    form one group that enters the means but not the number of users.
    """
    return cohorts(
        user_activity(events, user_col, date_col), as_of, bands, other_band, min_events, sort=sort
    )


def user_activity(events: DataFrame, user_col: str, date_col: str) -> DataFrame:
    """Per user (`user`) the number of events (`n`) and the days of the `first` and the `last`.

    Activities of parts of the events merge to that of all: see `merged_activity`.
    """
    day = F.to_date(date_col)
    return events.groupBy(F.col(user_col).alias("user")).agg(
        F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last")
    )


def merged_activity(known: DataFrame, new: DataFrame) -> DataFrame:
    """Activity over the events of both; a user in both has one row, and so have events without a user.

    Each side has one row per user, so no user is hot however many events they have.
    """
    both = known.unionByName(new)
    return both.groupBy("user").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def add_events(state: VersionedTable, label: str, events: DataFrame, user_col: str, date_col: str) -> bool:
    """Merges the events of one step, such as a day, into the activity kept in `state`; whether they were new.

    A step is merged once, by its label. What is read and shuffled is the state
    and the step's events, not those of earlier steps.
    """
    if label in {own for _, own in state.versions()}:
        return False
    merged = merged_activity(state.read(), user_activity(events, user_col, date_col))
    return state.write(merged.withColumn("n", F.col("n").cast("bigint")), label)


def cohorts(
    activity: DataFrame,
    as_of: S.DateLike | None = None,
    bands: Sequence[tuple[int, int, str]] = ((2, 3, "2-3"), (4, 5, "4-5")),
    other_band: str = "6+",
    min_events: int = 2,
    *,
    sort: bool = True,
) -> DataFrame:
    """What `repeat_cohorts` gives, from the activity per user."""
    above = min_events
    for low, high, label in bands:
        if not low <= above <= high + 1:
            raise ValueError(f"no band holds {above} events, which come before the band {label!r}")
        above = high + 1
    today = F.current_date() if as_of is None else S.day_literal(as_of)
    per_user = activity.where(F.col("n") >= min_events)
    described = per_user.select(
        "user",
        "n",
        F.year("first").alias("first_year"),
        S.band("n", bands, other_band).alias("frequency_band"),
        S.day_span("first", "last").alias("active_days"),
        S.completed_years("first", today).alias("tenure"),
    )
    grouped = described.groupBy("first_year", "frequency_band").agg(
        F.count("user").alias("user_count"),
        F.avg("n").alias("avg_events_per_user"),
        F.avg("active_days").alias("avg_activity_days"),
        F.avg(S.whole_div("active_days", F.col("n") - 1)).alias("avg_days_between_events"),
        F.avg("tenure").alias("avg_years_since_first"),
    )
    if not sort:
        return grouped
    return grouped.orderBy(S.smallest_first("first_year"), S.smallest_first("frequency_band"))
