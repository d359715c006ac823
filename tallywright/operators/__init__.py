from tallywright.operators.cohort import (
    ACTIVITY,
    add_events,
    cohorts,
    merged_activity,
    monthly_volume,
    repeat_cohorts,
    user_activity,
)
from tallywright.operators.compare import first_match_segment, plan_fulfilment, treatment_comparison
from tallywright.operators.frequency import (
    category_frequency,
    category_share,
    keyword_count,
    keyword_count_indexed,
    slot_frequency,
    top_groups,
    top_groups_pruned,
    with_any_phrase,
)
from tallywright.operators.reduction import key_count, reduce_to_keys
from tallywright.operators.summary import numeric_summary, segment_profile, top_rows

__all__ = [
    "ACTIVITY",
    "add_events",
    "category_frequency",
    "category_share",
    "cohorts",
    "first_match_segment",
    "key_count",
    "keyword_count",
    "keyword_count_indexed",
    "merged_activity",
    "monthly_volume",
    "numeric_summary",
    "plan_fulfilment",
    "reduce_to_keys",
    "repeat_cohorts",
    "segment_profile",
    "slot_frequency",
    "top_groups",
    "top_groups_pruned",
    "top_rows",
    "treatment_comparison",
    "user_activity",
    "with_any_phrase",
]
