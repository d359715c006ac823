"""Declared schemas of the report tables, and how to read them.

A declared schema spares the inference pass over the files and keeps money and
dates in the types that the rounding and day rules need.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 1)
SIGN_IN_FLAGS = ("autho_vk", "autho_ok", "autho_tg", "autho_yandex", "autho_google")


SKILL_KINDS = ("key_skills", "soft_skills")


def vacancies_schema(key_slots: int, soft_slots: int) -> T.StructType:
    """One row per vacancy; the number of skill columns depends on the extract.

    `read_vacancies` finds it in the files.
    """
    schema = T.StructType()
    for name in ("name", "area", "employer", "employment", "schedule", "experience"):
        schema.add(name, T.StringType())
    schema.add("salary_from", MONEY).add("salary_to", MONEY)
    for kind, slots in zip(SKILL_KINDS, (key_slots, soft_slots), strict=True):
        for slot in range(1, slots + 1):
            schema.add(f"{kind}_{slot}", T.StringType())
    return schema


USERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("region", T.StringType()),
        T.StructField("confirmed_donations", T.IntegerType()),
        *[T.StructField(flag, T.BooleanType()) for flag in SIGN_IN_FLAGS],
    ]
)
DONATIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType()),
        T.StructField("donation_date", T.DateType()),
    ]
)
BONUSES = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("user_bonus_count", T.IntegerType()),
    ]
)
PLAN = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("donation_date", T.DateType()),
        T.StructField("donation_type", T.StringType()),
    ]
)


def read_files(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files, with a declared schema where one is known.

    Raises if the files lack a column of the schema, which would be read as NULL
    throughout, or hold more skill columns than it has, which would be left out.
    """
    if schema is None:
        return spark.read.parquet(path)
    present = {name.lower() for name in spark.read.parquet(path).columns}
    declared = {name.lower() for name in schema.names}
    missing = sorted(declared - present)
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    if declared & {f"{kind}_1" for kind in SKILL_KINDS}:
        more = sorted(present.intersection(_skill_columns(present)) - declared)
        if more:
            raise ValueError(f"{path} has skill columns beyond the schema: {', '.join(more)}")
    return spark.read.schema(schema).parquet(path)


def read_vacancies(spark: SparkSession, path: str) -> DataFrame:
    """Vacancies with as many skill columns as the files have."""
    skills = _skill_columns(name.lower() for name in spark.read.parquet(path).columns)
    key_slots, soft_slots = (sum(name.startswith(kind) for name in skills) for kind in SKILL_KINDS)
    return read_files(spark, path, vacancies_schema(key_slots, soft_slots))


def _skill_columns(names: Iterable[str]) -> list[str]:
    return [name for name in names if re.fullmatch(rf"({'|'.join(SKILL_KINDS)})_\d+", name)]


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by its (schema-qualified) name."""
    return spark.table(name)


def write_bucketed(df: DataFrame, name: str, by: str | Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Writes a catalog table in `buckets` by the hash of its key, sorted by it, and reads it.

    Two tables bucketed alike by the columns they are joined or grouped on need
    no shuffle for that: the rows of a key already lie in one file. The number
    of buckets must be the same on both sides, and suit the larger one; a bucket
    is read by one task, so aim at some 200 MB each. Rows are dealt to the writers
    by the same hash first, so that every bucket is one file.

    With `path` the files lie there, and dropping the table leaves them; otherwise
    they lie in the warehouse. An existing table of the name is an error.
    """
    keys = [by] if isinstance(by, str) else list(by)
    if buckets < 1 or not keys:
        raise ValueError("at least one bucket and one key are needed")
    writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return read_table(df.sparkSession, name)
