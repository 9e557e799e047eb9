"""Derived report values: ratios, labels, flags and the ordered traffic-light rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectus.functions.dates import days_between, now
from prospectus.functions.predicates import in_rolling, in_window
from prospectus.params import ReportParams

# Officer type per unit name, in the order they are tried.
UNIT_OFFICER_TYPES = (
    ("Planned Giving", "Planned Giving Officer"),
    ("Principal Gifts", "Principal Gifts Officer"),
    ("Foundation & Corporate Giving", "Foundation and Corporate Officer"),
)
ANNUAL_SPECIAL_UNIT = "Annual & Special Gifts"


def first_match(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule that is true; a null test moves on to the next rule."""
    head, *rest = [(test, v if isinstance(v, Column) else F.lit(v)) for test, v in rules]
    chain = reduce(lambda acc, rule: acc.when(*rule), rest, F.when(*head))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def share(part: Column, whole: Column) -> Column:
    return part / whole


def safe_ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is null or 0; null only where the numerator is null."""
    ratio = part.cast("double") / whole.cast("double")
    return F.when(whole.isNull() | (whole == 0), F.lit(0.0)).otherwise(ratio)


def unless_zero(size: Column, value: Column) -> Column:
    """Null where size is 0, else the value."""
    return F.when(size != 0, value)


def yes_no(test: Column) -> Column:
    return F.when(test, "Yes").otherwise("No")


def quartile_label(ratio: Column) -> Column:
    """A null ratio fails every test and so lands in the top label."""
    return first_match([(ratio < 0.25, "<25%"), (ratio < 0.5, "25%-50%"), (ratio < 0.75, "50%-75%")], "75%+")


def officer_type(unit: Column, officer_id: Column, p: ReportParams) -> Column:
    rules = [(unit == name, label) for name, label in UNIT_OFFICER_TYPES]
    rules.append(((unit == ANNUAL_SPECIAL_UNIT) | officer_id.isin(*p.special_officers), "Annual Special"))
    rules.append((officer_id.isin(*p.leadership), "Leadership"))
    return first_match(rules, "Major Gift Officer")


def size_recommended(kind: Column, size: Column, p: ReportParams) -> Column:
    rules = [((kind == name) & (size >= least), "Yes") for name, least in p.size_minimum.items()]
    return first_match([*rules, (kind == "Leadership", "N/A")], "No")


def fiscal_year(column: str, p: ReportParams) -> Column:
    dated = [(in_window(column, window), label) for window, label in p.fiscal_years]
    return first_match([(F.col(column).isNull(), p.open_fiscal_year), *dated])


def ask_gap_flag(start: Column, last_ask: Column, p: ReportParams) -> Column:
    """Whether a long-held prospect still waits for an ask. "Months" here are days / 12."""
    today = now(p)
    return first_match(
        [
            (days_between(start, today) / 12 < 18, "RM < 18 Mo"),
            (days_between(last_ask, today) / 12 >= 18, "Y"),
        ],
        "N",
    )


def assessment(years_held: Column, p: ReportParams) -> Column:
    """Traffic light of a prospect sheet as struct(code, reason).

    Reads pers_org_ind, abs_high_capacity_ucdt_asks, lifetime_giving_devel, stage_full_desc, last_gift_date and the
    officer's and anyone's contact counts of the row. Rules are tried in order.
    """
    capacity, giving = F.col("abs_high_capacity_ucdt_asks"), F.col("lifetime_giving_devel")
    rm_visits, any_visits = F.col("visits_rm_12m"), F.col("visits_any_12m")
    capable = capacity >= 50000
    never_gave = giving.isNull() | (giving == 0)
    not_soliciting = F.col("stage_full_desc") != "Active Solicitation"
    gave_lately = in_rolling("last_gift_date", p)

    # Colours and their reasons.
    rules = [
        (F.col("pers_org_ind") == "O", None, None),
        (years_held < 0.5, "ORANGE", "In Portfolio < 6 months"),
        ((capacity < 50000) & (giving < 50000), "RED",
         "Highest MG Capacity < $50k and Lifetime Giving < $50k"),
        ((capacity < 100000) & never_gave & (any_visits == 0), "RED",
         "Highest MG Capacity < $100k and No Visit By Any DO in 12 Months and No Giving Ever"),
        (capable & (rm_visits.isNull() | (rm_visits == 0)) & (years_held >= 2), "YELLOW",
         "Highest MG Capacity > $50k and No F2F By RM and Years As RM > 2yrs"),
        (capable & not_soliciting & (years_held >= 1) & gave_lately, "YELLOW",
         "Highest MG Capacity > $50k and Any Gift Within Past 12 Months and Not Active Solicitation"),
        (capable & (F.col("contacts_rm_12m") >= 1), "GREEN",
         "Highest MG Capacity > $50k and Contact By RM in 12 Months"),
        (capable & (any_visits >= 1), "GREEN", "Highest MG Capacity > $50k and Any F2F in 12 Months"),
        ((years_held >= 1) & (F.col("contacts_rm") == 0), "YELLOW2",
         "Not Red, Yellow, or Green and RM > 1yr and No Contact By RM ever"),
    ]

    def verdict(code: str | None, reason: str | None) -> Column:
        return F.struct(F.lit(code).cast("string").alias("code"), F.lit(reason).cast("string").alias("reason"))

    return first_match([(test, verdict(code, reason)) for test, code, reason in rules], verdict(None, None))
