"""The seven donor reports, each a plan over the tables it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tallywright import operators as op
from tallywright.functions.semantics import DateLike
from tallywright.plans import fixed_values as fixed


def top_regions(users: DataFrame, k: int = 5) -> DataFrame:
    return op.top_groups(users, "region", "id", k, count_as="donor_count")


def donations_by_month(
    donations: DataFrame, start: DateLike = fixed.PERIOD[0], end: DateLike = fixed.PERIOD[1]
) -> DataFrame:
    return op.monthly_volume(donations, "donation_date", "id", start, end, count_as="donation_count")


def most_active_donors(users: DataFrame, k: int = 10) -> DataFrame:
    return op.top_rows(users, "id", "confirmed_donations", k)


def bonus_effect(users: DataFrame, bonuses: DataFrame, dedup_right: bool = False) -> DataFrame:
    return op.treatment_comparison(
        users,
        bonuses,
        ("id", "user_id"),
        "user_bonus_count",
        "confirmed_donations",
        fixed.BONUS_LABELS,
        dedup_right=dedup_right,
        status_as=fixed.BONUS_STATUS,
        count_as=fixed.DONOR_COUNT,
        mean_as=fixed.MEAN_DONATIONS,
    )


def sign_in_networks(users: DataFrame, predicate: Column | None = None) -> DataFrame:
    """All users by default; a predicate can keep, say, those who donated."""
    return op.first_match_segment(
        users,
        fixed.SIGN_IN_LABELS,
        fixed.NO_SIGN_IN,
        "id",
        "confirmed_donations",
        predicate,
        segment_as=fixed.NETWORK,
        count_as=fixed.DONOR_COUNT,
        mean_as=fixed.MEAN_DONATIONS,
    )


def repeat_donor_cohorts(donations: DataFrame, as_of: DateLike | None = None) -> DataFrame:
    cohorts = op.repeat_cohorts(
        donations, "user_id", "donation_date", as_of, fixed.FREQUENCY_BANDS, fixed.FREQUENCY_OTHER
    )
    return cohorts.toDF(
        "first_donation_year",
        "donation_frequency_group",
        "donor_count",
        "avg_donations_per_donor",
        "avg_activity_duration_days",
        "avg_days_between_donations",
        "avg_years_since_first_donation",
    )


def plan_completion(plan: DataFrame, donations: DataFrame, dedup_right: bool = False) -> DataFrame:
    return op.plan_fulfilment(
        plan,
        donations,
        ["user_id", "donation_date"],
        "donation_type",
        dedup_right=dedup_right,
        planned_as="total_planned_donations",
        completed_as="completed_donations",
    )
