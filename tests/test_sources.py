"""Reading the report tables from files and from the catalog."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.plans import donors, vacancies
from tallywright.sources import BONUSES, DONATIONS, PLAN, USERS, read_files, read_table, read_vacancies, vacancies_schema
from tallywright.workload.operators import table
from tests.conftest import rows


def test_declared_schema_gives_money_as_decimals():
    schema = vacancies_schema(key_slots=4, soft_slots=1)
    assert schema["salary_from"].dataType == T.DecimalType(12, 1)
    assert [name for name in schema.names if "skills" in name] == [
        "key_skills_1",
        "key_skills_2",
        "key_skills_3",
        "key_skills_4",
        "soft_skills_1",
    ]


@pytest.mark.parametrize("schema", [USERS, DONATIONS, BONUSES, PLAN, vacancies_schema(3, 2)])
def test_files_with_a_declared_schema(spark, tmp_path, schema):
    path = str(tmp_path / "t")
    spark.createDataFrame([], schema).write.parquet(path)
    assert [(f.name, f.dataType) for f in read_files(spark, path, schema).schema] == [
        (f.name, f.dataType) for f in schema
    ]
    assert read_files(spark, path).columns == schema.names


def test_reports_over_catalog_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS giving")
    spark.createDataFrame([(1, 7, dt.date(2022, 5, 1)), (2, 7, dt.date(2022, 5, 31))], DONATIONS).write.mode(
        "overwrite"
    ).saveAsTable("giving.donations")
    donations = read_table(spark, "giving.donations")
    assert rows(donors.donations_by_month(donations)) == [(dt.date(2022, 5, 1), 2)]
    assert rows(donors.repeat_donor_cohorts(donations, "2024-12-03"))[0][:4] == (2022, "2-3 донации", 1, 2.0)


def test_partitioned_table_is_pruned_by_the_period(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    day = F.date_add(F.lit("2021-06-01").cast("date"), F.col("id").cast("int"))
    months = spark.range(1200).withColumn("donation_date", F.trunc(day, "month"))
    months.write.partitionBy("donation_date").parquet(path)
    result = donors.donations_by_month(read_files(spark, path))
    result.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(donation_date" in plan
    assert len(rows(result)) == 24


def test_skill_slots_are_found_by_name(spark):
    schema = vacancies_schema(key_slots=1, soft_slots=1)
    frame = spark.createDataFrame([(*[None] * 8, "SQL", "x")], schema)
    assert sorted(rows(vacancies.skill_mentions_all_slots(frame))) == [
        ("key_skills_1", "SQL", 1),
        ("soft_skills_1", "x", 1),
    ]


def skills_file(spark, path, key_slots, soft_slots):
    schema = vacancies_schema(key_slots, soft_slots)
    names = [name for name in schema.names if "skills" in name]
    spark.createDataFrame([(*[None] * (len(schema) - len(names)), *names)], schema).write.parquet(path)
    return names


def test_every_skill_slot_of_a_file_is_read(spark, tmp_path):
    names = skills_file(spark, str(tmp_path / "t"), 5, 3)
    mentions = vacancies.skill_mentions_all_slots(read_vacancies(spark, str(tmp_path / "t")))
    assert sorted(rows(mentions)) == sorted((name, name, 1) for name in names)
    with pytest.raises(ValueError, match="key_skills_4, key_skills_5, soft_skills_3"):
        read_files(spark, str(tmp_path / "t"), vacancies_schema(3, 2))


def test_missing_columns_are_noticed(spark, tmp_path):
    spark.createDataFrame([("a",)], "name string").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no column .*salary_from"):
        read_files(spark, str(tmp_path / "t"), vacancies_schema(1, 1))


def test_rewritten_files_are_read_with_their_own_schema(spark, tmp_path):
    path = str(tmp_path / "region.parquet")
    for name in ("first", "second"):
        spark.createDataFrame([(1,)], f"{name} int").write.mode("overwrite").parquet(path)
        assert rows(table(spark, str(tmp_path), "region").select(name)) == [(1,)]
