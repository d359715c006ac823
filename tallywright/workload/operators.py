"""Each operator over the given tables, beside SQL that states the same result.

The callables take a session and the folder of the Parquet tables. Rounded
results are decimals; they are cast to double at the very end, on both sides,
since the two engines divide decimals differently. For the same reason the SQL
rounds in whole hundredths.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright import operators as op
from tallywright import streaming
from tallywright.functions import contains_any, date_bucket
from tallywright.sources import VersionedTable, new_folder, read_files, write_bucketed

AS_OF = "2024-12-03"
MONEY = "decimal(18,2)"
TINY = Decimal("0.0000000003")
PART_WORDS = ("ring", "bolt")
TEXT_WORDS = ("under", "Then")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with the schema of its files."""
    return read_files(spark, f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Whole decimals (numbers of pairs) as bigints, other decimals as doubles, everything else unchanged."""

    def simple(field: T.StructField) -> Column:
        if not isinstance(field.dataType, T.DecimalType):
            return F.col(field.name)
        return F.col(field.name).cast("double" if field.dataType.scale else "bigint").alias(field.name)

    return df.select(*map(simple, df.schema))


def sql_mean(cents: str) -> str:
    """Mean of non-negative hundredths, rounded half up, in units."""
    return f"CAST((2 * SUM({cents}) + COUNT({cents})) // (2 * NULLIF(COUNT({cents}), 0)) AS DOUBLE) / 100"


def sql_percent(part: str, total: str) -> str:
    return f"CAST((20000 * CAST({part} AS HUGEINT) + {total}) // (2 * {total}) AS DOUBLE) / 100"


def sql_cents(col: str) -> str:
    return f"CAST(ROUND({col} * 100) AS BIGINT)"


def _sql_mean_1024(cents: str) -> str:
    """Mean of hundredths over 1024: both numbers are exact as doubles, so the quotient is rounded once."""
    return f"CAST(SUM({cents}) AS DOUBLE) / CAST(1024 * COUNT({cents}) AS DOUBLE)"


def _sql_round_1024(cents: str) -> str:
    """The same for non-negative ones, rounded half up to two digits."""
    whole = f"(200 * SUM({cents}) + 1024 * COUNT({cents})) // (2048 * COUNT({cents}))"
    return f"CAST({whole} AS DOUBLE) / 100"


# -- H1: numeric summary ----------------------------------------------------


def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return plain(op.numeric_summary(orders.select(F.col("o_totalprice").cast(MONEY)), ["o_totalprice"]))


def numeric_summary_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    priced = lines.select(
        F.col("l_extendedprice").cast(MONEY),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast(MONEY)).alias("l_quantity"),
    )
    return plain(op.numeric_summary(priced, ["l_extendedprice", "l_quantity"]))


def _binary(col: str) -> Column:
    """Hundredths over 1024: a double that has a binary fraction, and whose exact sum SQL can state."""
    return F.round(F.col(col) * 100).cast("bigint").cast("double") / 1024


def numeric_summary_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of doubles: exact sums, rounded once."""
    return op.numeric_summary(table(spark, sf_dir, "orders").select(_binary("o_totalprice").alias("price")), ["price"])


def segment_profile_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", _binary("l_extendedprice").alias("price"))
    return op.segment_profile(lines, ["l_returnflag", "l_linestatus"], ["price"], count_as="num")


def first_match_segment_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("price", _binary("l_extendedprice"))
    flags = [(F.col("l_quantity") >= 40, "bulk"), (F.col("l_returnflag") == "R", "returned")]
    return op.first_match_segment(lines, flags, "plain", "l_orderkey", "price", exact=True, count_as="num")


def treatment_comparison_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumn("balance", _binary("c_acctbal"))
    orders = table(spark, sf_dir, "orders").withColumn("large", (F.col("o_totalprice") > 200000).cast("int"))
    on = ("c_custkey", "o_custkey")
    return plain(op.treatment_comparison(customer, orders, on, "large", "balance", exact=True, count_as="num"))


# -- H2 to H6: category frequencies -----------------------------------------


def freq_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.category_frequency(table(spark, sf_dir, "customer"), "c_nationkey", count_as="num")


def freq_employer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.category_frequency(table(spark, sf_dir, "part"), "p_brand", count_as="num")


def freq_employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.category_frequency(table(spark, sf_dir, "customer"), "c_mktsegment", count_as="num")


def freq_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.category_frequency(table(spark, sf_dir, "orders"), "o_orderstatus", count_as="num")


def freq_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.category_frequency(table(spark, sf_dir, "orders"), "o_orderpriority", count_as="num")


def freq_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.category_frequency(table(spark, sf_dir, "lineitem"), "l_partkey", count_as="num")


def freq_blank_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select(
        F.when(F.col("lang") == "en", F.lit(None)).when(F.col("lang") == "fr", "").otherwise(F.col("source")).alias("k")
    )
    return op.category_frequency(keyed, "k", count_as="num")


# -- H7, H8: phrases and shares ---------------------------------------------


def keyword_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keyword_count(table(spark, sf_dir, "part"), "p_name", PART_WORDS, count_as="num")


def keyword_count_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keyword_count(table(spark, sf_dir, "documents"), "text", TEXT_WORDS, count_as="num")


def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return plain(op.category_share(part, "p_type", contains_any("p_name", PART_WORDS), count_as="num"))


def category_share_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return plain(
        op.category_share(part, "p_type", contains_any("p_name", PART_WORDS), denominator=1157, count_as="num")
    )


def category_share_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return plain(op.category_share(documents, "source", contains_any("text", TEXT_WORDS), count_as="num"))


def category_share_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(op.category_share(table(spark, sf_dir, "lineitem"), "l_suppkey", scale=4, count_as="num"))


def keyword_count_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in which the first two words of any part of one brand stand together."""
    part = table(spark, sf_dir, "part")
    phrases = part.where(F.col("p_brand") == "Brand#11").select(F.substring_index("p_name", " ", 2).alias("phrase"))
    return op.keyword_count_indexed(part, "p_name", phrases, "phrase", count_as="num")


# -- H9: segment profiles ---------------------------------------------------


def segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.col("p_size") > 25
    part = table(spark, sf_dir, "part").select(
        "p_name",
        "p_brand",
        "p_type",
        F.when(large, "large").otherwise("small").alias("size"),
        F.when(large, F.col("p_retailprice").cast(MONEY)).alias("price"),
    )
    return plain(
        op.segment_profile(
            part, ["p_brand", "p_type", "size"], ["price"], contains_any("p_name", PART_WORDS), count_as="num"
        )
    )


def segment_profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        "l_suppkey",
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity").cast(MONEY).alias("quantity"),
    )
    return plain(
        op.segment_profile(lines, ["l_suppkey", "l_returnflag", "l_linestatus"], ["price", "quantity"], count_as="num")
    )


# -- H10: slots -------------------------------------------------------------


def slot_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.slot_frequency(table(spark, sf_dir, "part"), ["p_brand", "p_type"], count_as="num_mention")


def slot_frequency_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.slot_frequency(table(spark, sf_dir, "part"), ["p_brand"], count_as="num_mention")


def slot_frequency_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several frequencies of one table in one scan, with blanks in one slot."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_linestatus",
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("l_returnflag"),
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
        F.col("l_suppkey").cast("string").alias("l_suppkey"),
    )
    return op.slot_frequency(lines, lines.columns, count_as="num_mention")


# -- D1, D2, D3: top groups, volumes, top rows ------------------------------


def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_groups(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", 5, count_as="num")


def top_groups_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_groups(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 5, count_as="num")


def monthly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return op.monthly_volume(orders, "o_orderdate", "o_orderkey", "1996-01-01", "1997-12-31", count_as="num")


def monthly_volume_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timestamp column: the last day belongs to the range."""
    events = table(spark, sf_dir, "events")
    return op.monthly_volume(events, "ts", "event_id", "2024-01-05", "2024-01-20", count_as="num")


def monthly_volume_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return op.monthly_volume(
        lines, "l_shipdate", "l_orderkey", "1996-02-15", "1999-11-30", unit="quarter", count_as="num"
    )


def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_rows(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", 10)


def top_rows_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL ranks first and so takes places in the top ten."""
    unknown = (F.col("c_nationkey") == 3) & (F.col("c_custkey") < 80)
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(~unknown, F.col("c_acctbal")).alias("c_acctbal")
    )
    return op.top_rows(customer, "c_custkey", "c_acctbal", 10)


# -- D4: treated against untreated ------------------------------------------


def treatment_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return plain(op.treatment_comparison(documents, labels, "doc_id", "quality", "n_chars", count_as="num"))


def _customers_and_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast(MONEY))
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_totalprice") > 250000).cast("int")).alias("large"),
    )
    return customer, orders


def treatment_comparison_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many treatment rows per unit: each one counts."""
    customer, orders = _customers_and_orders(spark, sf_dir)
    on = ("c_custkey", "o_custkey")
    return plain(op.treatment_comparison(customer, orders, on, "large", "c_acctbal", count_as="num"))


def treatment_comparison_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = _customers_and_orders(spark, sf_dir)
    on = ("c_custkey", "o_custkey")
    compared = op.treatment_comparison(customer, orders, on, "large", "c_acctbal", dedup_right=True, count_as="num")
    return plain(compared)


def treatment_comparison_small_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of ten decimals, most of them zeros, weighed by several treatment rows."""
    customer, orders = _customers_and_orders(spark, sf_dir)
    tiny = customer.select("c_custkey", (F.col("c_custkey").cast("decimal(20,10)") * TINY).cast("decimal(20,10)").alias("m"))
    return plain(op.treatment_comparison(tiny, orders, ("c_custkey", "o_custkey"), "large", "m", count_as="num"))


def treatment_comparison_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key holds a third of the rows on both sides; each unit row counts once."""
    lines = table(spark, sf_dir, "lineitem")
    hot = F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.col("l_suppkey"))
    units = lines.select(hot.alias("k"), F.col("l_linenumber").alias("outcome"))
    treatment = lines.select(hot.alias("k"), (F.col("l_linestatus") == "F").cast("int").alias("flag"))
    return plain(op.treatment_comparison(units, treatment, "k", "flag", "outcome", dedup_right=True, count_as="num"))


# -- D5: first matching segment ---------------------------------------------


def first_match_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    def seen(condition):
        return F.max(F.when(condition, F.lit(True)))

    kind = F.col("event_type")
    users = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            seen((kind == "purchase") & (F.col("value") > 150)).alias("buyer"),
            seen((kind == "signup") & (F.col("value") > 100)).alias("newcomer"),
            seen((kind == "click") & (F.col("value") > 100)).alias("visitor"),
            F.count("*").alias("n_events"),
        )
    )
    return op.first_match_segment(
        users,
        [("buyer", "buyer"), ("newcomer", "newcomer"), ("visitor", "visitor")],
        "other",
        "user_id",
        "n_events",
        count_as="num",
    )


def first_match_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as expressions over rows, with a predicate."""
    lines = table(spark, sf_dir, "lineitem")
    return op.first_match_segment(
        lines,
        [
            (F.col("l_discount") > 0.08, "discounted"),
            (F.col("l_quantity") >= 40, "bulk"),
            (F.col("l_returnflag") == "R", "returned"),
        ],
        "plain",
        "l_orderkey",
        "l_linenumber",
        F.col("l_linestatus") == "F",
        count_as="num",
    )


# -- D6: repeat cohorts -----------------------------------------------------


def repeat_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.repeat_cohorts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", AS_OF)


def repeat_cohorts_hot_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows without a user, and days with a time of day."""
    events = table(spark, sf_dir, "events").select(
        F.when(~F.col("event_type").isin("click", "error"), F.col("event_id")).alias("user_id"), "ts"
    )
    halved = events.withColumn("user_id", F.floor(F.col("user_id") / 4))
    return op.repeat_cohorts(halved, "user_id", "ts", AS_OF, bands=((2, 2, "2"), (3, 3, "3")), other_band="4+")


# -- D7: plan against fact --------------------------------------------------


def _events_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts").alias("day")
    plan = events.where(F.col("event_type") == "view").select(
        "user_id", day, F.when(F.col("value") > 20, "dear").otherwise("cheap").alias("kind")
    )
    return plan, events.where(F.col("event_type") == "purchase").select("user_id", day)


def plan_fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, actual = _events_plan(spark, sf_dir)
    return plain(op.plan_fulfilment(plan, actual, ["user_id", "day"], "kind"))


def plan_fulfilment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, actual = _events_plan(spark, sf_dir)
    fulfilled = op.plan_fulfilment(plan, actual, ["user_id", "day"], "kind", dedup_right=True)
    return plain(fulfilled)


def plan_fulfilment_rare_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No key is frequent in the plan: a few lines per order and year."""
    plan = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), date_bucket("l_shipdate", "year").alias("year"), "l_returnflag"
    )
    actual = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), date_bucket("o_orderdate", "year").alias("year")
    )
    return plain(op.plan_fulfilment(plan, actual, ["id", "year"], "l_returnflag"))


def plan_fulfilment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large sides, and a third of the rows of both without a supplier, which never match."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_suppkey")).alias("supplier"),
        date_bucket("l_shipdate").alias("month"),
        "l_linestatus",
        "l_linenumber",
    )
    plan = lines.where(F.col("l_linestatus") == "O")
    actual = lines.where(F.col("l_linestatus") == "F")
    return plain(op.plan_fulfilment(plan, actual, ["supplier", "month"], "l_linenumber"))


def plan_fulfilment_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One supplier holds a third of the rows of both sides, matches, and has many values of `by`."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.col("l_suppkey")).alias("supplier"),
        "l_linestatus",
        F.pmod("l_orderkey", F.lit(1000)).alias("order_group"),
    )
    plan, actual = lines.where(F.col("l_linestatus") == "O"), lines.where(F.col("l_linestatus") == "F")
    return plain(op.plan_fulfilment(plan, actual, ["supplier"], "order_group"))


# -- reduced, bucketed and pruned forms ---------------------------------------


def _few_planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One order in a hundred is planned; every line is a fact."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag")
    return lines.where(F.col("id") % 100 == 0), lines.select("id")


def plan_fulfilment_few_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that meet no plan are filtered out before they are shuffled."""
    plan, actual = _few_planned(spark, sf_dir)
    keys = op.key_count(plan, ["id"])
    return plain(op.plan_fulfilment(plan, actual, ["id"], "l_returnflag", planned_keys=keys))


def bucketed(df: DataFrame, by: str, buckets: int = 8) -> DataFrame:
    """A copy in the catalog, in buckets by a key."""
    return write_bucketed(df, f"tallywright_{uuid.uuid4().hex}", by, buckets)


def treatment_comparison_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides lie in buckets by the key: neither is shuffled."""
    customers, orders = _customers_and_orders(spark, sf_dir)
    return plain(
        op.treatment_comparison(
            bucketed(customers, "c_custkey"),
            bucketed(orders, "o_custkey"),
            ("c_custkey", "o_custkey"),
            "large",
            "c_acctbal",
            count_as="num",
        )
    )


def plan_fulfilment_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for plan and fact; a NULL key lies in a bucket like any other."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_suppkey")).alias("supplier"),
        "l_linestatus",
        "l_linenumber",
    )
    plan = bucketed(lines.where(F.col("l_linestatus") == "O").select("supplier", "l_linenumber"), "supplier")
    actual = bucketed(lines.where(F.col("l_linestatus") == "F").select("supplier"), "supplier")
    return plain(op.plan_fulfilment(plan, actual, ["supplier"], "l_linenumber", co_located=True))


def top_groups_pruned_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows in ten groups, the others in many small ones."""
    key = F.when(F.col("l_partkey") % 3 == 0, F.lit(-1) - F.col("l_linenumber")).otherwise(F.col("l_orderkey"))
    keyed = table(spark, sf_dir, "lineitem").select(key.alias("k"), "l_partkey")
    return op.top_groups_pruned(keyed, "k", "l_partkey", 5, count_as="num")


def top_groups_pruned_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing can be pruned, and many groups tie."""
    return op.top_groups_pruned(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 5, buckets=64, count_as="num")


# -- kept up to date: streams, increments, folders by month --------------------


def _arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _saved(spark: SparkSession, counts: DataFrame, keys: list[str]) -> DataFrame:
    """What a stream has counted once it has seen all files there are."""
    path = new_folder(spark, "stream")
    streaming.save_updates(counts, f"{path}/counts", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return streaming.latest(spark, f"{path}/counts", keys, "num")


def stream_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _arriving(spark, sf_dir, "events")
    return _saved(spark, streaming.frequency(events, "event_type", count_as="num"), ["event_type"])


def stream_monthly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days counted as they come; months from the days."""
    events = _arriving(spark, sf_dir, "events")
    days = _saved(spark, streaming.daily_volume(events, "ts", "event_id", count_as="num"), ["day"])
    return streaming.volume_of_days(days, "2024-01-05", "2024-01-20", count="num", count_as="num")


def repeat_cohorts_by_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity per customer, merged year by year."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    state = VersionedTable(spark, new_folder(spark, "activity"), op.ACTIVITY)
    first, last = orders.agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    for year in range(first, last + 1):
        op.add_events(state, str(year), orders.where(F.year("o_orderdate") == year), "o_custkey", "o_orderdate")
    return op.cohorts(state.read(), AS_OF)


def monthly_volume_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy in folders by year and month, of which only those of the range are read."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    path = new_folder(spark, "orders_by_month")
    dated = orders.withColumns({"year": F.year("o_orderdate"), "month_of_year": F.month("o_orderdate")})
    dated.repartition("year", "month_of_year").write.partitionBy("year", "month_of_year").parquet(path)
    return op.monthly_volume(
        read_files(spark, path),
        "o_orderdate",
        "o_orderkey",
        "1996-02-10",
        "1997-03-31",
        partitioned_by=("year", "month_of_year"),
        count_as="num",
    )


# -- keys that are called like results ---------------------------------------


def top_groups_key_called_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("count"), "c_custkey")
    return op.top_groups(customer, "count", "c_custkey", 5, count_as="num")


def category_share_key_called_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("percent"))
    return plain(op.category_share(part, "percent", count_as="num", percent_as="share"))


def plan_fulfilment_group_called_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, actual = _events_plan(spark, sf_dir)
    plan = plan.withColumnRenamed("kind", "completion_rate")
    return plain(op.plan_fulfilment(plan, actual, ["user_id", "day"], "completion_rate", rate_as="rate"))


QUERIES = {
    run.__name__: run
    for run in (
        numeric_summary,
        numeric_summary_two,
        numeric_summary_doubles,
        segment_profile_doubles,
        first_match_segment_doubles,
        treatment_comparison_doubles,
        freq_area,
        freq_employer,
        freq_employment,
        freq_schedule,
        freq_experience,
        freq_many_keys,
        freq_blank_key,
        keyword_count,
        keyword_count_text,
        keyword_count_indexed,
        category_share,
        category_share_literal,
        category_share_text,
        category_share_many_keys,
        segment_profile,
        segment_profile_lines,
        slot_frequency,
        slot_frequency_one,
        slot_frequency_all,
        top_groups,
        top_groups_many_keys,
        monthly_volume,
        monthly_volume_ts,
        monthly_volume_quarters,
        top_rows,
        top_rows_nulls,
        treatment_comparison,
        treatment_comparison_fanout,
        treatment_comparison_dedup,
        treatment_comparison_small_units,
        treatment_comparison_hot_key,
        first_match_segment,
        first_match_segment_lines,
        repeat_cohorts,
        repeat_cohorts_hot_user,
        plan_fulfilment,
        plan_fulfilment_dedup,
        plan_fulfilment_rare_keys,
        plan_fulfilment_lines,
        plan_fulfilment_hot_key,
        plan_fulfilment_few_planned,
        treatment_comparison_bucketed,
        plan_fulfilment_bucketed,
        top_groups_pruned_skewed,
        top_groups_pruned_flat,
        stream_frequency,
        stream_monthly_volume,
        repeat_cohorts_by_increments,
        monthly_volume_partitioned,
        top_groups_key_called_count,
        category_share_key_called_percent,
        plan_fulfilment_group_called_rate,
    )
}


def _sql_frequency(source: str, col: str) -> str:
    return f"SELECT {col}, COUNT(*) AS num FROM {source} GROUP BY {col} ORDER BY num DESC"


def _sql_share(source: str, col: str, where: str, total: str) -> str:
    return f"""
        WITH counts AS (SELECT {col}, COUNT(*) AS num FROM {source} WHERE {where} GROUP BY {col})
        SELECT {col}, num, {sql_percent('num', total)} AS percent FROM counts ORDER BY num DESC"""


_IN_PART_WORDS = "(p_name LIKE '%ring%' OR p_name LIKE '%bolt%')"
_IN_TEXT_WORDS = "(text LIKE '%under%' OR text LIKE '%Then%')"
_ALL_COUNTS = "(SELECT CAST(SUM(num) AS BIGINT) FROM counts)"


def _sql_treatment(units: str, treatment: str, unit_key: str, treatment_key: str, flag: str, outcome: str) -> str:
    return f"""
        WITH units AS ({units}), treatment AS ({treatment})
        SELECT CASE WHEN t.{flag} > 0 THEN 'treated' ELSE 'untreated' END AS status,
               COUNT(u.{unit_key}) AS num,
               CAST(SUM(u.{outcome}) AS DOUBLE) / COUNT(u.{outcome}) AS avg_{outcome}
        FROM units u LEFT JOIN treatment t ON u.{unit_key} = t.{treatment_key}
        GROUP BY 1"""


_CUSTOMERS = f"SELECT c_custkey, CAST(c_acctbal AS {MONEY}) AS c_acctbal FROM customer"
_LARGE_ORDERS = """
    SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey,
           CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_totalprice > 250000 AS INTEGER) END AS large
    FROM orders"""


def _sql_cohorts(source: str, user: str, day: str, band: str) -> str:
    return f"""
        WITH per_user AS (
            SELECT {user} AS u, COUNT(*) AS n, MIN({day}) AS f, MAX({day}) - MIN({day}) AS span
            FROM {source} GROUP BY 1 HAVING COUNT(*) > 1
        ), described AS (
            SELECT u, n, span, CAST(year(f) AS INTEGER) AS first_year, {band} AS frequency_band,
                   span // NULLIF(n - 1, 0) AS gap, extract(year FROM age(DATE '{AS_OF}', f)) AS tenure
            FROM per_user
        )
        SELECT first_year, frequency_band, COUNT(u) AS user_count, AVG(n) AS avg_events_per_user,
               AVG(span) AS avg_activity_days, AVG(gap) AS avg_days_between_events,
               AVG(tenure) AS avg_years_since_first
        FROM described GROUP BY 1, 2 ORDER BY 1, 2"""


def _sql_fulfilment(plan: str, actual: str, keys: tuple[str, str], by: str) -> str:
    return f"""
        WITH plan AS ({plan}), actual AS (SELECT *, 1 AS met FROM ({actual})), counts AS (
            SELECT {by}, COUNT(*) AS planned, COUNT(met) AS completed
            FROM plan LEFT JOIN actual USING ({', '.join(keys)}) GROUP BY {by}
        )
        SELECT {by}, planned, completed, {sql_percent('completed', 'planned')} AS completion_rate FROM counts"""


_VIEW_PLAN = """
    SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN value > 20 THEN 'dear' ELSE 'cheap' END AS kind
    FROM events WHERE event_type = 'view'"""
_PURCHASES = "SELECT {} user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'"
_LINES = """
    SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_suppkey END AS supplier,
           CAST(date_trunc('month', l_shipdate) AS DATE) AS month {}
    FROM lineitem WHERE l_linestatus = '{}'"""

_PRICE, _QUANTITY = sql_cents("l_extendedprice"), sql_cents("l_quantity")

ORACLE = {
    "numeric_summary": f"""
        SELECT {sql_mean(sql_cents('o_totalprice'))} AS avg_o_totalprice,
               MIN(o_totalprice) AS min_o_totalprice, MAX(o_totalprice) AS max_o_totalprice FROM orders""",
    "numeric_summary_two": f"""
        WITH priced AS (
            SELECT {_PRICE} AS price, CASE WHEN l_returnflag = 'R' THEN {_QUANTITY} END AS quantity FROM lineitem
        )
        SELECT {sql_mean('price')} AS avg_l_extendedprice, {sql_mean('quantity')} AS avg_l_quantity,
               CAST(MIN(price) AS DOUBLE) / 100 AS min_l_extendedprice,
               CAST(MAX(price) AS DOUBLE) / 100 AS max_l_extendedprice,
               CAST(MIN(quantity) AS DOUBLE) / 100 AS min_l_quantity,
               CAST(MAX(quantity) AS DOUBLE) / 100 AS max_l_quantity
        FROM priced""",
    "numeric_summary_doubles": f"""
        SELECT {_sql_round_1024(sql_cents('o_totalprice'))} AS avg_price,
               MIN({sql_cents('o_totalprice')}) / 1024 AS min_price, MAX({sql_cents('o_totalprice')}) / 1024 AS max_price
        FROM orders""",
    "segment_profile_doubles": f"""
        SELECT l_returnflag, l_linestatus, COUNT(*) AS num, {_sql_round_1024(sql_cents('l_extendedprice'))} AS avg_price
        FROM lineitem GROUP BY ALL""",
    "first_match_segment_doubles": f"""
        SELECT CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'plain' END AS segment,
               COUNT(l_orderkey) AS num, {_sql_mean_1024(sql_cents('l_extendedprice'))} AS avg_price
        FROM lineitem GROUP BY 1""",
    "treatment_comparison_doubles": f"""
        SELECT CASE WHEN o_totalprice > 200000 THEN 'treated' ELSE 'untreated' END AS status,
               COUNT(c_custkey) AS num, {_sql_mean_1024(sql_cents('c_acctbal'))} AS avg_balance
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
    "freq_area": _sql_frequency("customer", "c_nationkey"),
    "freq_employer": _sql_frequency("part", "p_brand"),
    "freq_employment": _sql_frequency("customer", "c_mktsegment"),
    "freq_schedule": _sql_frequency("orders", "o_orderstatus"),
    "freq_experience": _sql_frequency("orders", "o_orderpriority"),
    "freq_many_keys": _sql_frequency("lineitem", "l_partkey"),
    "freq_blank_key": _sql_frequency(
        "(SELECT CASE WHEN lang = 'en' THEN NULL WHEN lang = 'fr' THEN '' ELSE source END AS k FROM documents)", "k"
    ),
    "keyword_count": f"SELECT COUNT(*) AS num FROM part WHERE {_IN_PART_WORDS}",
    "keyword_count_text": f"SELECT COUNT(*) AS num FROM documents WHERE {_IN_TEXT_WORDS}",
    "category_share": _sql_share("part", "p_type", _IN_PART_WORDS, _ALL_COUNTS),
    "category_share_literal": _sql_share("part", "p_type", _IN_PART_WORDS, "1157"),
    "category_share_text": _sql_share("documents", "source", _IN_TEXT_WORDS, _ALL_COUNTS),
    "category_share_many_keys": f"""
        WITH counts AS (SELECT l_suppkey, COUNT(*) AS num FROM lineitem GROUP BY l_suppkey)
        SELECT l_suppkey, num,
               CAST((2000000 * CAST(num AS HUGEINT) + {_ALL_COUNTS}) // (2 * {_ALL_COUNTS}) AS DOUBLE) / 10000
                   AS percent
        FROM counts ORDER BY num DESC""",
    "segment_profile": f"""
        WITH kept AS (
            SELECT p_brand, p_type, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size,
                   CASE WHEN p_size > 25 THEN {sql_cents('p_retailprice')} END AS price
            FROM part WHERE {_IN_PART_WORDS}
        )
        SELECT p_brand, p_type, size, COUNT(*) AS num, {sql_mean('price')} AS avg_price
        FROM kept GROUP BY p_brand, p_type, size ORDER BY num DESC""",
    "segment_profile_lines": f"""
        SELECT l_suppkey, l_returnflag, l_linestatus, COUNT(*) AS num,
               {sql_mean(_PRICE)} AS avg_price, {sql_mean(_QUANTITY)} AS avg_quantity
        FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus ORDER BY num DESC""",
    "slot_frequency": """
        SELECT 'p_brand' AS slot, p_brand AS value, COUNT(*) AS num_mention FROM part GROUP BY p_brand
        UNION ALL
        SELECT 'p_type' AS slot, p_type AS value, COUNT(*) AS num_mention FROM part GROUP BY p_type""",
    "slot_frequency_one": """
        SELECT 'p_brand' AS slot, p_brand AS value, COUNT(*) AS num_mention FROM part GROUP BY p_brand""",
    "slot_frequency_all": """
        SELECT 'l_linestatus' AS slot, l_linestatus AS value, COUNT(*) AS num_mention FROM lineitem GROUP BY 2
        UNION ALL
        SELECT 'l_returnflag', CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, COUNT(*) FROM lineitem GROUP BY 2
        UNION ALL
        SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), COUNT(*) FROM lineitem GROUP BY 2
        UNION ALL
        SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), COUNT(*) FROM lineitem GROUP BY 2""",
    "top_groups": """
        SELECT c_nationkey, COUNT(c_custkey) AS num FROM customer GROUP BY c_nationkey
        ORDER BY num DESC, c_nationkey LIMIT 5""",
    "keyword_count_indexed": """
        WITH phrases AS (
            SELECT DISTINCT array_to_string(list_slice(string_split(p_name, ' '), 1, 2), ' ') AS phrase
            FROM part WHERE p_brand = 'Brand#11'
        )
        SELECT COUNT(*) AS num FROM part WHERE EXISTS (SELECT 1 FROM phrases WHERE contains(p_name, phrase))""",
    "plan_fulfilment_few_planned": _sql_fulfilment(
        "SELECT l_orderkey AS id, l_returnflag FROM lineitem WHERE l_orderkey % 100 = 0",
        "SELECT l_orderkey AS id FROM lineitem",
        ("id",),
        "l_returnflag",
    ),
    "treatment_comparison_bucketed": _sql_treatment(
        _CUSTOMERS, _LARGE_ORDERS, "c_custkey", "o_custkey", "large", "c_acctbal"
    ),
    "plan_fulfilment_bucketed": """
        WITH lines AS (
            SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_suppkey END AS supplier, l_linestatus, l_linenumber
            FROM lineitem
        ), plan AS (
            SELECT supplier, l_linenumber, COUNT(*) AS n FROM lines WHERE l_linestatus = 'O' GROUP BY ALL
        ), actual AS (
            SELECT supplier, COUNT(*) AS met FROM lines WHERE l_linestatus = 'F' GROUP BY ALL
        ), counts AS (
            SELECT l_linenumber, CAST(SUM(n * coalesce(met, 1)) AS BIGINT) AS planned,
                   CAST(SUM(n * coalesce(met, 0)) AS BIGINT) AS completed
            FROM plan LEFT JOIN actual USING (supplier) GROUP BY l_linenumber
        )
        SELECT l_linenumber, planned, completed, """
    + sql_percent("completed", "planned")
    + """ AS completion_rate FROM counts""",
    "top_groups_pruned_skewed": """
        SELECT CASE WHEN l_partkey % 3 = 0 THEN -1 - l_linenumber ELSE l_orderkey END AS k, COUNT(l_partkey) AS num
        FROM lineitem GROUP BY 1 ORDER BY num DESC, k LIMIT 5""",
    "top_groups_pruned_flat": """
        SELECT l_orderkey, COUNT(l_partkey) AS num FROM lineitem GROUP BY l_orderkey
        ORDER BY num DESC, l_orderkey LIMIT 5""",
    "stream_frequency": "SELECT event_type, COUNT(*) AS num FROM events GROUP BY event_type",
    "stream_monthly_volume": """
        SELECT CAST(date_trunc('month', ts) AS DATE) AS month, COUNT(event_id) AS num FROM events
        WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1 ORDER BY 1""",
    "monthly_volume_partitioned": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(o_orderkey) AS num FROM orders
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-10' AND DATE '1997-03-31' GROUP BY 1 ORDER BY 1""",
    "top_groups_many_keys": """
        SELECT l_orderkey, COUNT(l_partkey) AS num FROM lineitem GROUP BY l_orderkey
        ORDER BY num DESC, l_orderkey LIMIT 5""",
    "monthly_volume": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(o_orderkey) AS num FROM orders
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1 ORDER BY 1""",
    "monthly_volume_ts": """
        SELECT CAST(date_trunc('month', ts) AS DATE) AS month, COUNT(event_id) AS num FROM events
        WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1 ORDER BY 1""",
    "monthly_volume_quarters": """
        SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, COUNT(l_orderkey) AS num FROM lineitem
        WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-02-15' AND DATE '1999-11-30' GROUP BY 1 ORDER BY 1""",
    "top_rows": """
        SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 10""",
    "top_rows_nulls": """
        SELECT c_custkey, CASE WHEN c_nationkey = 3 AND c_custkey < 80 THEN NULL ELSE c_acctbal END AS c_acctbal
        FROM customer ORDER BY 2 DESC NULLS FIRST, c_custkey LIMIT 10""",
    "treatment_comparison": _sql_treatment(
        "SELECT * FROM documents", "SELECT * FROM labels", "doc_id", "doc_id", "quality", "n_chars"
    ),
    "treatment_comparison_fanout": _sql_treatment(
        _CUSTOMERS, _LARGE_ORDERS, "c_custkey", "o_custkey", "large", "c_acctbal"
    ),
    "treatment_comparison_dedup": _sql_treatment(
        _CUSTOMERS,
        f"SELECT o_custkey, MAX(large) AS large FROM ({_LARGE_ORDERS}) GROUP BY o_custkey",
        "c_custkey",
        "o_custkey",
        "large",
        "c_acctbal",
    ),
    "treatment_comparison_small_units": _sql_treatment(
        f"SELECT c_custkey, CAST(c_custkey * {TINY:f} AS DECIMAL(20,10)) AS m FROM customer",
        _LARGE_ORDERS,
        "c_custkey",
        "o_custkey",
        "large",
        "m",
    ),
    "treatment_comparison_hot_key": _sql_treatment(
        "SELECT CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_suppkey END AS k, l_linenumber AS outcome FROM lineitem",
        """SELECT CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_suppkey END AS k,
                  MAX(CAST(l_linestatus = 'F' AS INTEGER)) AS flag FROM lineitem GROUP BY 1""",
        "k",
        "k",
        "flag",
        "outcome",
    ),
    "first_match_segment": """
        WITH users AS (
            SELECT user_id, COUNT(*) AS n_events,
                   bool_or(event_type = 'purchase' AND value > 150) AS buyer,
                   bool_or(event_type = 'signup' AND value > 100) AS newcomer,
                   bool_or(event_type = 'click' AND value > 100) AS visitor
            FROM events GROUP BY user_id
        )
        SELECT CASE WHEN buyer THEN 'buyer' WHEN newcomer THEN 'newcomer' WHEN visitor THEN 'visitor'
                    ELSE 'other' END AS segment,
               COUNT(user_id) AS num, AVG(n_events) AS avg_n_events
        FROM users GROUP BY 1""",
    "first_match_segment_lines": """
        SELECT CASE WHEN l_discount > 0.08 THEN 'discounted' WHEN l_quantity >= 40 THEN 'bulk'
                    WHEN l_returnflag = 'R' THEN 'returned' ELSE 'plain' END AS segment,
               COUNT(l_orderkey) AS num, AVG(l_linenumber) AS avg_l_linenumber
        FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""",
    "repeat_cohorts": _sql_cohorts(
        "orders",
        "o_custkey",
        "CAST(o_orderdate AS DATE)",
        "CASE WHEN n BETWEEN 2 AND 3 THEN '2-3' WHEN n BETWEEN 4 AND 5 THEN '4-5' ELSE '6+' END",
    ),
    "repeat_cohorts_hot_user": _sql_cohorts(
        "events",
        "CASE WHEN event_type NOT IN ('click', 'error') THEN event_id // 4 END",
        "CAST(ts AS DATE)",
        "CASE WHEN n = 2 THEN '2' WHEN n = 3 THEN '3' ELSE '4+' END",
    ),
    "plan_fulfilment": _sql_fulfilment(_VIEW_PLAN, _PURCHASES.format(""), ("user_id", "day"), "kind"),
    "plan_fulfilment_dedup": _sql_fulfilment(_VIEW_PLAN, _PURCHASES.format("DISTINCT"), ("user_id", "day"), "kind"),
    "plan_fulfilment_rare_keys": _sql_fulfilment(
        "SELECT l_orderkey AS id, year(l_shipdate) AS year, l_returnflag FROM lineitem",
        "SELECT o_orderkey AS id, year(o_orderdate) AS year FROM orders",
        ("id", "year"),
        "l_returnflag",
    ),
    "plan_fulfilment_lines": _sql_fulfilment(
        _LINES.format(", l_linenumber", "O"), _LINES.format("", "F"), ("supplier", "month"), "l_linenumber"
    ),
    "plan_fulfilment_hot_key": f"""
        WITH lines AS (
            SELECT CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_suppkey END AS supplier, l_linestatus,
                   l_orderkey % 1000 AS order_group
            FROM lineitem
        ), plan AS (
            SELECT supplier, order_group, COUNT(*) AS n FROM lines WHERE l_linestatus = 'O' GROUP BY ALL
        ), actual AS (
            SELECT supplier, COUNT(*) AS met FROM lines WHERE l_linestatus = 'F' GROUP BY ALL
        ), counts AS (
            SELECT order_group, CAST(SUM(n * coalesce(met, 1)) AS BIGINT) AS planned,
                   CAST(SUM(n * coalesce(met, 0)) AS BIGINT) AS completed
            FROM plan LEFT JOIN actual USING (supplier) GROUP BY order_group
        )
        SELECT order_group, planned, completed, {sql_percent('completed', 'planned')} AS completion_rate FROM counts""",
    "top_groups_key_called_count": """
        SELECT c_nationkey AS "count", COUNT(c_custkey) AS num FROM customer GROUP BY c_nationkey
        ORDER BY num DESC, c_nationkey LIMIT 5""",
    "category_share_key_called_percent": f"""
        WITH counts AS (SELECT p_type AS percent, COUNT(*) AS num FROM part GROUP BY p_type)
        SELECT percent, num, {sql_percent('num', _ALL_COUNTS)} AS share FROM counts""",
    "plan_fulfilment_group_called_rate": f"""
        SELECT kind AS completion_rate, planned, completed, completion_rate AS rate
        FROM ({_sql_fulfilment(_VIEW_PLAN, _PURCHASES.format(""), ("user_id", "day"), "kind")})""",
}
ORACLE["repeat_cohorts_by_increments"] = ORACLE["repeat_cohorts"]
