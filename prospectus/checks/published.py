"""Values of the published reports that the check SQL needs, written out apart from the code it checks."""

from __future__ import annotations

# Capacity thresholds of the scorecard.
CAPACITY_STEPS = {"50k": 50_000, "100k": 100_000, "1m": 1_000_000}

# Prospect stages of the scorecard, the officer count each reads, and whether a "1+ year" share follows.
STAGE_MIX = {
    "at_qualification": ("n_q", True),
    "at_cultivation": ("n_cu", True),
    "at_active_solicitation": ("n_so", True),
    "at_stewardship": ("n_st", False),
    "at_pg_stewardship": ("n_pl", False),
    "at_permanent_stewardship": ("n_ps", False),
}

# Prospect stage codes and the officer count of each.
STAGE_COUNTS = {"Q": "n_q", "CU": "n_cu", "SO": "n_so", "ST": "n_st", "PL": "n_pl", "PS": "n_ps"}

# Count columns of the scorecard, without identity and labels.
COUNT_COLUMNS = (
    "ask_major_by_officer",
    "ask_any_by_officer",
    "ask_special_by_officer",
    "contacted_by_officer",
    "visited_by_officer",
    "visited_twice_by_officer",
    "documented_strategy",
    "dq_nn_nr_reports",
    "qualified_reports",
    "ask_major_any",
    "ask_any_any",
    "ask_special_any",
    "contacted_any",
    "visited_any",
    "rated_lt_50k",
    "rated_ge_50k",
    "rated_lt_100k",
    "rated_ge_100k",
    "rated_lt_1m",
    "rated_ge_1m",
    "gave",
    "proposals",
    "proposals_ask_made",
    "proposals_dropped_before_ask",
    "proposals_closed",
)
