"""The ten vacancy reports, each a plan over one vacancies DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame

from tallywright import operators as op
from tallywright.functions import contains_any
from tallywright.plans import fixed_values as fixed

NUM = "num_vacancies"


def salary_summary(vacancies: DataFrame) -> DataFrame:
    return op.numeric_summary(vacancies, ["salary_from", "salary_to"])


def vacancies_by_area(vacancies: DataFrame) -> DataFrame:
    return op.category_frequency(vacancies, "area", count_as=NUM)


def vacancies_by_employer(vacancies: DataFrame) -> DataFrame:
    return op.category_frequency(vacancies, "employer", count_as=NUM)


def vacancies_by_employment(vacancies: DataFrame) -> DataFrame:
    return op.category_frequency(vacancies, "employment", count_as=NUM)


def vacancies_by_schedule(vacancies: DataFrame) -> DataFrame:
    return op.category_frequency(vacancies, "schedule", count_as=NUM)


def vacancies_by_experience(vacancies: DataFrame) -> DataFrame:
    return op.category_frequency(vacancies, "experience", count_as=NUM)


def analyst_vacancy_count(vacancies: DataFrame) -> DataFrame:
    return op.keyword_count(vacancies, "name", fixed.TITLE_PHRASES)


def analyst_grade_share(vacancies: DataFrame, denominator: int | Decimal | None = None) -> DataFrame:
    """Grades among analysts' vacancies; the total is theirs unless one is given."""
    return op.category_share(
        vacancies,
        "experience",
        contains_any("name", fixed.TITLE_PHRASES),
        denominator=denominator,
        count_as=NUM,
        percent_as="percent_vacancies",
    )


def analyst_workplaces(vacancies: DataFrame) -> DataFrame:
    profile = op.segment_profile(
        vacancies,
        ["employer", "employment", "schedule"],
        ["salary_from", "salary_to"],
        contains_any("name", fixed.TITLE_PHRASES),
        count_as=NUM,
    )
    return profile.select("employer", NUM, "avg_salary_from", "avg_salary_to", "employment", "schedule")


def skill_mentions(vacancies: DataFrame, slot: str = "key_skills_1") -> DataFrame:
    return op.category_frequency(vacancies, slot, count_as="num_mention")


def skill_mentions_all_slots(vacancies: DataFrame, slots: Sequence[str] | None = None) -> DataFrame:
    """The same for every skill column, all read in one scan."""
    if slots is None:
        slots = [name for name in vacancies.columns if name.startswith(("key_skills_", "soft_skills_"))]
    return op.slot_frequency(vacancies, slots, value_as="skill", count_as="num_mention")
