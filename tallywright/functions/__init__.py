from tallywright.functions.semantics import (
    band,
    completed_years,
    contains_any,
    date_bucket,
    day_span,
    first_match,
    largest_first,
    mean,
    percent,
    rounded_mean,
    smallest_first,
    whole_div,
    within_days,
)

__all__ = [
    "band",
    "completed_years",
    "contains_any",
    "date_bucket",
    "day_span",
    "first_match",
    "largest_first",
    "mean",
    "percent",
    "rounded_mean",
    "smallest_first",
    "whole_div",
    "within_days",
]
