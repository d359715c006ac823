"""Counts over rows that keep arriving: categories, and volumes per day and month.

A stream keeps one count per category, or per day that late rows may still
belong to, and gives out those that changed. They are saved per micro-batch,
written over when a batch is repeated after a failure, so nothing counts twice.
Counts only grow, so the latest of a key is its largest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallywright.functions import semantics as S


def frequency(events: DataFrame, by: str, *, count_as: str = "count") -> DataFrame:
    """Rows per value of `by` so far. NULL is a value, and so is ''.

    The state has one row per value, however many rows there are; it is never
    dropped, as any value may come again.
    """
    S.distinct_names([by, count_as])
    return events.groupBy(F.col(by)).agg(F.count("*").alias(count_as))


def daily_volume(
    events: DataFrame,
    time_col: str,
    count_col: str,
    late: str = "7 days",
    *,
    day_as: str = "day",
    count_as: str = "count",
) -> DataFrame:
    """Events per day so far; rows may come `late` by so much after the latest one seen.

    A day's state is dropped once no row that late can belong to it: at most the
    days of that span are kept, whatever the length of the stream. Rows that come
    later still are left out, and so are rows without a time. Days are those of
    UTC, so the session must keep that time.
    """
    S.distinct_names([day_as, count_as])
    if events.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT"):
        raise ValueError("days of a stream are those of UTC; set spark.sql.session.timeZone to it")
    timed = events.select(F.col(time_col).cast("timestamp").alias("_time"), F.col(count_col).alias("_counted"))
    days = timed.withWatermark("_time", late).groupBy(F.window("_time", "1 day").alias("_day"))
    return days.agg(F.count("_counted").alias(count_as)).select(F.to_date("_day.start").alias(day_as), count_as)


def save_updates(counts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes the counts that each micro-batch changed below `path`; `start()` begins.

    Every batch has a folder of its own by its number, which a repeated batch
    writes over.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)


def latest(spark: SparkSession, path: str, keys: Sequence[str], count_as: str = "count") -> DataFrame:
    """The last count of every key among saved updates."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max(count_as).alias(count_as))


def volume_of_days(
    days: DataFrame,
    start: S.DateLike,
    end: S.DateLike,
    unit: str = "month",
    *,
    day: str = "day",
    count: str = "count",
    bucket_as: str | None = None,
    count_as: str = "count",
    sort: bool = True,
) -> DataFrame:
    """Events per month (or other unit) from counts per day, both ends included."""
    bucket_as = bucket_as or unit
    S.distinct_names([bucket_as, count_as])
    in_range = days.where(S.within_days(day, start, end))
    volume = in_range.groupBy(S.date_bucket(day, unit).alias(bucket_as)).agg(F.sum(count).alias(count_as))
    return volume.orderBy(S.smallest_first(bucket_as)) if sort else volume
