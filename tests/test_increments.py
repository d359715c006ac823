"""Results kept up to date: streams, versions, merged activity, folders by month."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallywright import operators as op
from tallywright import streaming
from tallywright.sources import VersionedTable, new_folder, versions
from tests.conftest import rows

EVENTS = "user bigint, ts timestamp, kind string, id bigint"


def some_events(seed, days, per_day, late_days=3):
    """Rows by the day they arrive on; some are late, some lack a time, a user or a kind, one user is hot."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 28)
    out = []
    for day in range(days):
        own = []
        for i in range(per_day):
            at = start + dt.timedelta(days=day - rng.choice([0, 0, 0, rng.randint(0, late_days)]), seconds=rng.randrange(86400))
            user = 7 if rng.random() < 0.34 else None if rng.random() < 0.1 else rng.randrange(60)
            own.append((user, at if rng.random() < 0.97 else None, rng.choice(["a", "b", "", None]), i if rng.random() < 0.9 else None))
        out.append(own)
    return out


def arrive(spark, path, batch):
    spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(path)


def run(counts, path):
    streaming.save_updates(counts, f"{path}/counts", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("files_at_once", [1, 100])
def test_a_stream_ends_like_the_whole(spark, tmp_path, files_at_once):
    """Files in three batches with late rows, and a restart in between."""
    came = str(tmp_path / "events")
    batches = some_events(1, 3, 200)
    for at, batch in enumerate(batches):
        arrive(spark, came, batch)
        # The same query is started anew for each batch and goes on where it ended.
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(came)
        run(streaming.frequency(stream, "kind", count_as="num"), str(tmp_path / "kinds"))
        run(streaming.daily_volume(stream, "ts", "id", "4 days", count_as="num"), str(tmp_path / "days"))
        whole = spark.createDataFrame([r for b in batches[: at + 1] for r in b], EVENTS)
        kinds = streaming.latest(spark, str(tmp_path / "kinds" / "counts"), ["kind"], "num")
        assert sorted(map(repr, rows(kinds))) == sorted(map(repr, rows(op.category_frequency(whole, "kind", count_as="num"))))
        days = streaming.latest(spark, str(tmp_path / "days" / "counts"), ["day"], "num")
        args = ("2024-01-26", "2024-01-30")
        months = streaming.volume_of_days(days, *args, count="num", count_as="num")
        assert rows(months) == rows(op.monthly_volume(whole, "ts", "id", *args, count_as="num"))


def test_rows_beyond_the_lateness_are_left_out(spark, tmp_path):
    came, out = str(tmp_path / "events"), str(tmp_path / "days")
    for day, times in ((20, 1), (21, 1), (2, 5), (20, 1)):
        arrive(spark, came, [(1, dt.datetime(2024, 1, day, 12), "a", 1)] * times)
        stream = spark.readStream.schema(EVENTS).parquet(came)
        run(streaming.daily_volume(stream, "ts", "id", "3 days"), out)
    days = streaming.latest(spark, f"{out}/counts", ["day"])
    assert sorted(rows(days)) == [(dt.date(2024, 1, 20), 2), (dt.date(2024, 1, 21), 1)]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "counts")
    came = str(tmp_path / "events")
    arrive(spark, came, [(1, None, "a", 1)] * 3)
    run(streaming.frequency(spark.readStream.schema(EVENTS).parquet(came), "kind"), path)
    before = rows(streaming.latest(spark, f"{path}/counts", ["kind"]))
    # The same batch again, as after a failure before it was noted as done.
    run(streaming.frequency(spark.readStream.schema(EVENTS).parquet(came), "kind").select("*"), path)
    spark.createDataFrame([("a", 3)], "kind string, count bigint").write.mode("overwrite").parquet(f"{path}/counts/batch={0:012d}")
    assert rows(streaming.latest(spark, f"{path}/counts", ["kind"])) == before == [("a", 3)]


def test_days_are_those_of_utc(spark, conf):
    conf(session__timeZone="Asia/Tokyo")
    with pytest.raises(ValueError, match="UTC"):
        streaming.daily_volume(spark.range(1).select(F.current_timestamp().alias("t"), "id"), "t", "id")


def test_increments_end_like_the_full_run(spark, tmp_path):
    """After every day, hot user, events without user or time, and late ones included."""
    state = VersionedTable(spark, str(tmp_path / "state"), op.ACTIVITY)
    days = some_events(2, 5, 150, late_days=40)
    bands = {"bands": ((2, 3, "2-3"), (4, 9, "4-9")), "other_band": "10+"}
    assert rows(op.cohorts(state.read(), "2025-01-01")) == []
    for at, day in enumerate(days):
        events = spark.createDataFrame(day, EVENTS)
        assert op.add_events(state, f"day-{at}", events, "user", "ts")
        assert not op.add_events(state, f"day-{at}", events, "user", "ts")
        whole = spark.createDataFrame([r for d in days[: at + 1] for r in d], EVENTS)
        assert rows(op.cohorts(state.read(), "2025-01-01", **bands)) == rows(
            op.repeat_cohorts(whole, "user", "ts", "2025-01-01", **bands)
        )
    assert [n for n, _ in state.versions()] == [1, 2, 3, 4, 5]


def test_versions(spark, tmp_path):
    """Only whole versions count; a reader keeps its own; a failed write is written over."""
    table = VersionedTable(spark, str(tmp_path / "t"), spark.range(0).schema)
    assert table.versions() == [] and rows(table.read()) == []
    assert table.write(spark.range(3), "a")
    reader = table.read()
    broken = tmp_path / "t" / "v00000002-b"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half a file")
    assert table.versions() == [(1, "a")]
    assert table.write(table.read().union(spark.range(3, 5)), "b")
    assert sorted(rows(table.read())) == [(i,) for i in range(5)]
    assert reader.count() == 3
    assert not table.write(spark.range(1), "a")
    with pytest.raises(ValueError, match="label"):
        table.write(spark.range(1), "a/b")
    table.forget_before(1)
    assert table.versions() == [(2, "b")] and table.read().count() == 5


def test_only_folders_of_the_range_are_read(spark, tmp_path):
    """Folders outside the range hold files that cannot be read; the first and last day belong to it."""
    path = tmp_path / "t"
    days = spark.range(400).select(F.date_add(F.lit("2023-12-01").cast("date"), F.col("id").cast("int")).alias("d"), "id")
    days.withColumns({"y": F.year("d"), "m": F.month("d")}).write.partitionBy("y", "m").parquet(str(path))
    expected = rows(op.monthly_volume(days, "d", "id", "2024-02-29", "2024-11-01"))
    for folder in path.glob("y=*/m=*"):
        year, month = (int(part.split("=")[1]) for part in (folder.parent.name, folder.name))
        if not (2024, 2) <= (year, month) <= (2024, 11):
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not a table")
            for file in folder.glob(".*.crc"):
                file.unlink()
    frame = spark.read.schema("d date, id bigint, y int, m int").parquet(str(path))
    found = op.monthly_volume(frame, "d", "id", "2024-02-29", "2024-11-01", partitioned_by=("y", "m"))
    assert rows(found) == expected
    assert expected[0] == (dt.date(2024, 2, 1), 1) and expected[-1] == (dt.date(2024, 11, 1), 1)
    with pytest.raises(Exception, match="not a Parquet|FAILED_READ_FILE|magic"):
        rows(op.monthly_volume(frame.where("id >= 0"), "d", "id", "2023-12-01", "2024-11-01", partitioned_by=("y", "m")))


class Session:
    """As much of a session as the choice of a folder looks at."""

    def __init__(self, named, master):
        self.sparkContext, self.conf, self.master, self.applicationId = self, self, master, f"{named} {master}"
        self.named = named

    def getConf(self):
        return self

    def get(self, *_):
        return self.named


def test_shared_folders(spark):
    assert versions.shared_folder(Session("hdfs://store/tmp/", "yarn")) == "hdfs://store/tmp"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            versions.shared_folder(Session(None, master))
    local = Session(None, "local[4]")
    assert versions.shared_folder(local) == versions.shared_folder(local) != versions.shared_folder(Session(None, "local[2]"))
    assert new_folder(spark, "x") != new_folder(spark, "x")
