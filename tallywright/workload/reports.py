"""Each report over tables of its own shape, derived from the given ones.

The given tables hold neither vacancies nor donors, so parts stand for
vacancies, customers for users, and orders for donations, bonuses and plans.
The derivations are projections: the work grows with the given tables. Blank
keys, NULL measures, repeated bonus rows and unmet plans all occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.plans import donors as d
from tallywright.plans import fixed_values as fixed
from tallywright.plans import vacancies as v
from tallywright.workload.operators import plain, sql_cents, sql_mean, sql_percent, table

AS_OF = "2024-12-03"
YEARS_ON = 26  # brings the orders into the period of the monthly report
ANALYST, SYSTEM_ANALYST = fixed.TITLE_PHRASES


# -- derived tables ---------------------------------------------------------


def vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size")
    price = F.col("p_retailprice").cast("decimal(12,2)")
    word = F.split_part(name, F.lit(" "), F.lit(1))
    return table(spark, sf_dir, "part").select(
        F.when(name.contains("ring"), F.concat(F.lit(f"{ANALYST} "), name))
        .when(name.contains("bolt"), F.concat(F.lit(f"Ведущий {SYSTEM_ANALYST} "), name))
        .when(name.contains("gear"), F.concat(F.lit(f"{ANALYST.lower()} "), name))
        .when(~name.contains("rod"), name)
        .alias("name"),
        F.col("p_brand").alias("area"),
        F.when(size > 17, F.col("p_brand")).alias("employer"),
        F.col("p_type").alias("employment"),
        F.when(size > 40, "late").when(size > 10, "day").otherwise("").alias("schedule"),
        F.when(size < 10, "none").when(size < 30, "some").otherwise("much").alias("experience"),
        F.when(size > 25, price).alias("salary_from"),
        F.when(size < 40, price + size).alias("salary_to"),
        F.when(size > 30, F.lit(None)).when(size > 20, "").otherwise(word).alias("key_skills_1"),
        F.when(size > 10, F.split_part(name, F.lit(" "), F.lit(2))).alias("key_skills_2"),
        F.col("p_type").alias("soft_skills_1"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment, balance, nation = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(nation > 8, F.concat(F.lit("region "), nation.cast("string"))).alias("region"),
        F.when(balance > 0, F.floor(balance / 100).cast("int")).alias("confirmed_donations"),
        (segment == "BUILDING").alias("autho_vk"),
        (balance > 9000).alias("autho_ok"),
        (segment == "MACHINERY").alias("autho_tg"),
        (balance > 5000).alias("autho_yandex"),
        F.when(segment != "FURNITURE", nation < 5).alias("autho_google"),
    )


def _order_date() -> Column:
    return F.add_months(F.to_date("o_orderdate"), 12 * YEARS_ON)


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("user_id"),
        _order_date().alias("donation_date"),
    )


def bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") == "F")
        .select(
            F.col("o_custkey").alias("user_id"),
            F.when(priority == "2-HIGH", 0).when(priority != "1-URGENT", 3).alias("user_bonus_count"),
        )
    )


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.when(late, F.date_add(_order_date(), 1)).otherwise(_order_date()).alias("donation_date"),
        F.when(F.col("o_totalprice") > 100000, "free").otherwise("paid").alias("donation_type"),
    )


_SQL_TABLES = f"""
    vacancies AS (
        SELECT CASE WHEN p_name LIKE '%ring%' THEN '{ANALYST} ' || p_name
                    WHEN p_name LIKE '%bolt%' THEN 'Ведущий {SYSTEM_ANALYST} ' || p_name
                    WHEN p_name LIKE '%gear%' THEN '{ANALYST.lower()} ' || p_name
                    WHEN p_name NOT LIKE '%rod%' THEN p_name END AS name,
               p_brand AS area,
               CASE WHEN p_size > 17 THEN p_brand END AS employer,
               p_type AS employment,
               CASE WHEN p_size > 40 THEN 'late' WHEN p_size > 10 THEN 'day' ELSE '' END AS schedule,
               CASE WHEN p_size < 10 THEN 'none' WHEN p_size < 30 THEN 'some' ELSE 'much' END AS experience,
               CASE WHEN p_size > 25 THEN {sql_cents('p_retailprice')} END AS from_cents,
               CASE WHEN p_size < 40 THEN {sql_cents('p_retailprice')} + 100 * p_size END AS to_cents,
               CASE WHEN p_size > 30 THEN NULL WHEN p_size > 20 THEN ''
                    ELSE split_part(p_name, ' ', 1) END AS key_skills_1,
               CASE WHEN p_size > 10 THEN split_part(p_name, ' ', 2) END AS key_skills_2,
               p_type AS soft_skills_1
        FROM part
    ), analysts AS (
        SELECT * FROM vacancies WHERE name LIKE '%{ANALYST}%' OR name LIKE '%{SYSTEM_ANALYST}%'
    ), users AS (
        SELECT c_custkey AS id,
               CASE WHEN c_nationkey > 8 THEN 'region ' || c_nationkey END AS region,
               CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal / 100) AS INTEGER) END AS confirmed_donations,
               c_mktsegment = 'BUILDING' AS autho_vk,
               c_acctbal > 9000 AS autho_ok,
               c_mktsegment = 'MACHINERY' AS autho_tg,
               c_acctbal > 5000 AS autho_yandex,
               CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_nationkey < 5 END AS autho_google
        FROM customer
    ), dated AS (
        SELECT *, CAST(CAST(o_orderdate AS DATE) + INTERVAL {YEARS_ON} YEAR AS DATE) AS day FROM orders
    ), donations AS (
        SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS user_id,
               day AS donation_date
        FROM dated
    ), bonuses AS (
        SELECT o_custkey AS user_id,
               CASE WHEN o_orderpriority = '2-HIGH' THEN 0
                    WHEN o_orderpriority <> '1-URGENT' THEN 3 END AS user_bonus_count
        FROM orders WHERE o_orderstatus = 'F'
    ), plan AS (
        SELECT o_custkey AS user_id, CASE WHEN o_orderstatus = 'P' THEN day + 1 ELSE day END AS donation_date,
               CASE WHEN o_totalprice > 100000 THEN 'free' ELSE 'paid' END AS donation_type
        FROM dated
    )"""


def _sql(select: str, *more_tables: str) -> str:
    return f"WITH {', '.join([_SQL_TABLES, *more_tables])} {select}"


# -- reports ----------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]


def _of(report: Callable[..., DataFrame], *sources: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(report(*[source(spark, sf_dir) for source in sources]))

    return run


QUERIES: dict[str, Query] = {
    "report_salary_summary": _of(v.salary_summary, vacancies),
    "report_vacancies_by_area": _of(v.vacancies_by_area, vacancies),
    "report_vacancies_by_employer": _of(v.vacancies_by_employer, vacancies),
    "report_vacancies_by_employment": _of(v.vacancies_by_employment, vacancies),
    "report_vacancies_by_schedule": _of(v.vacancies_by_schedule, vacancies),
    "report_vacancies_by_experience": _of(v.vacancies_by_experience, vacancies),
    "report_analyst_vacancy_count": _of(v.analyst_vacancy_count, vacancies),
    "report_analyst_grade_share": _of(v.analyst_grade_share, vacancies),
    "report_analyst_workplaces": _of(v.analyst_workplaces, vacancies),
    "report_skill_mentions": _of(v.skill_mentions, vacancies),
    "report_skill_mentions_all_slots": _of(v.skill_mentions_all_slots, vacancies),
    "report_top_regions": _of(d.top_regions, users),
    "report_donations_by_month": _of(d.donations_by_month, donations),
    "report_most_active_donors": _of(d.most_active_donors, users),
    "report_bonus_effect": _of(d.bonus_effect, users, bonuses),
    "report_sign_in_networks": _of(d.sign_in_networks, users),
    "report_repeat_donor_cohorts": _of(lambda events: d.repeat_donor_cohorts(events, AS_OF), donations),
    "report_plan_completion": _of(d.plan_completion, plan, donations),
}


def _sql_by(col: str, count_as: str = v.NUM) -> str:
    return _sql(f"SELECT {col}, COUNT(*) AS {count_as} FROM vacancies GROUP BY {col} ORDER BY {count_as} DESC")


_SIGN_IN_CASE = " ".join(f"WHEN {flag} THEN '{label}'" for flag, label in fixed.SIGN_IN_LABELS)
_BAND_CASE = " ".join(f"WHEN n BETWEEN {low} AND {high} THEN '{label}'" for low, high, label in fixed.FREQUENCY_BANDS)
_GOT, _GOT_NOT = fixed.BONUS_LABELS

ORACLE = {
    "report_salary_summary": _sql(f"""
        SELECT {sql_mean('from_cents')} AS avg_salary_from, {sql_mean('to_cents')} AS avg_salary_to,
               CAST(MIN(from_cents) AS DOUBLE) / 100 AS min_salary_from,
               CAST(MAX(from_cents) AS DOUBLE) / 100 AS max_salary_from,
               CAST(MIN(to_cents) AS DOUBLE) / 100 AS min_salary_to,
               CAST(MAX(to_cents) AS DOUBLE) / 100 AS max_salary_to
        FROM vacancies"""),
    "report_vacancies_by_area": _sql_by("area"),
    "report_vacancies_by_employer": _sql_by("employer"),
    "report_vacancies_by_employment": _sql_by("employment"),
    "report_vacancies_by_schedule": _sql_by("schedule"),
    "report_vacancies_by_experience": _sql_by("experience"),
    "report_analyst_vacancy_count": _sql("SELECT COUNT(*) AS count FROM analysts"),
    "report_analyst_grade_share": _sql(
        f"""
        SELECT experience, {v.NUM}, {sql_percent(v.NUM, '(SELECT COUNT(*) FROM analysts)')} AS percent_vacancies
        FROM counts ORDER BY {v.NUM} DESC""",
        f"counts AS (SELECT experience, COUNT(*) AS {v.NUM} FROM analysts GROUP BY experience)",
    ),
    "report_analyst_workplaces": _sql(f"""
        SELECT employer, COUNT(*) AS {v.NUM}, {sql_mean('from_cents')} AS avg_salary_from,
               {sql_mean('to_cents')} AS avg_salary_to, employment, schedule
        FROM analysts GROUP BY employer, employment, schedule ORDER BY {v.NUM} DESC"""),
    "report_skill_mentions": _sql_by("key_skills_1", "num_mention"),
    "report_skill_mentions_all_slots": _sql(
        " UNION ALL ".join(
            f"SELECT '{slot}' AS slot, {slot} AS skill, COUNT(*) AS num_mention FROM vacancies GROUP BY {slot}"
            for slot in ("key_skills_1", "key_skills_2", "soft_skills_1")
        )
    ),
    "report_top_regions": _sql("""
        SELECT region, COUNT(id) AS donor_count FROM users GROUP BY region
        ORDER BY donor_count DESC, region NULLS LAST LIMIT 5"""),
    "report_donations_by_month": _sql(f"""
        SELECT CAST(date_trunc('month', donation_date) AS DATE) AS month, COUNT(id) AS donation_count
        FROM donations WHERE donation_date BETWEEN DATE '{fixed.PERIOD[0]}' AND DATE '{fixed.PERIOD[1]}'
        GROUP BY 1 ORDER BY 1"""),
    "report_most_active_donors": _sql("""
        SELECT id, confirmed_donations FROM users ORDER BY confirmed_donations DESC NULLS FIRST, id LIMIT 10"""),
    "report_bonus_effect": _sql(f"""
        SELECT CASE WHEN user_bonus_count > 0 THEN '{_GOT}' ELSE '{_GOT_NOT}' END AS {fixed.BONUS_STATUS},
               COUNT(id) AS {fixed.DONOR_COUNT}, AVG(confirmed_donations) AS {fixed.MEAN_DONATIONS}
        FROM users LEFT JOIN bonuses ON user_id = id GROUP BY 1"""),
    "report_sign_in_networks": _sql(f"""
        SELECT CASE {_SIGN_IN_CASE} ELSE '{fixed.NO_SIGN_IN}' END AS {fixed.NETWORK},
               COUNT(id) AS {fixed.DONOR_COUNT}, AVG(confirmed_donations) AS {fixed.MEAN_DONATIONS}
        FROM users GROUP BY 1"""),
    "report_repeat_donor_cohorts": _sql(
        f"""
        SELECT CAST(year(f) AS INTEGER) AS first_donation_year,
               CASE {_BAND_CASE} ELSE '{fixed.FREQUENCY_OTHER}' END AS donation_frequency_group,
               COUNT(user_id) AS donor_count, AVG(n) AS avg_donations_per_donor,
               AVG(span) AS avg_activity_duration_days, AVG(span // NULLIF(n - 1, 0)) AS avg_days_between_donations,
               AVG(extract(year FROM age(DATE '{AS_OF}', f))) AS avg_years_since_first_donation
        FROM per_user GROUP BY 1, 2 ORDER BY 1, 2""",
        """per_user AS (
            SELECT user_id, COUNT(*) AS n, MIN(donation_date) AS f, MAX(donation_date) - MIN(donation_date) AS span
            FROM donations GROUP BY user_id HAVING COUNT(*) > 1)""",
    ),
    "report_plan_completion": _sql(
        f"""
        SELECT donation_type, total_planned_donations, completed_donations,
               {sql_percent('completed_donations', 'total_planned_donations')} AS completion_rate FROM counts""",
        """counts AS (
            SELECT donation_type, COUNT(*) AS total_planned_donations, COUNT(id) AS completed_donations
            FROM plan LEFT JOIN donations USING (user_id, donation_date) GROUP BY donation_type)""",
    ),
}
