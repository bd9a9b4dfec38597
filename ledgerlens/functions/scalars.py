"""Column functions of the domain; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import constants as k

#: Format of a date, and the pattern of its prefix: text after it is ignored.
DATE_FORMATS = (
    (r"^\s*([A-Za-z]+ \d{1,2}, \d{4})", "MMMM d, yyyy"),
    (r"^\s*(\d{1,2}/\d{1,2}/\d{4})", "M/d/yyyy"),
    (r"^\s*(\d{4}-\d{1,2}-\d{1,2})", "yyyy-M-d"),
)


def parse_date(x: Column, formats=DATE_FORMATS) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(F.nullif(F.regexp_extract(x, p, 1), F.lit("")), F.lit(f)).cast("date") for p, f in formats])


def safe_ratio(n: Column, d: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(d > 0, n / d)


def member(x: Column, values) -> Column:
    """x is one of values; false, not null, where x is null."""
    return F.coalesce(x.isin(*values), F.lit(False))


def holds(x: Column) -> Column:
    """x, with false where it is null."""
    return F.coalesce(x, F.lit(False))


def total(x: Column) -> Column:
    """Sum with 0 where there is nothing to sum."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def to_number(x: Column) -> Column:
    """A number, or null for null, "null" and what isn't one."""
    return F.nullif(x, F.lit("null")).try_cast("double")


def parse_amount(x: Column) -> Column:
    """Currency text: $ , and quotes go."""
    return F.trim(F.regexp_replace(x, r'[$,"]', "")).try_cast("double")


def squish(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalise_text(x: Column) -> Column:
    return F.upper(squish(x))


#: What is replaced in organisation names, in this order.
ORG_RULES = (
    (r"\s*\([^)]*\)", ""),
    (r"-", " "),
    (r"\s+AT\s+[A-Z].*$", ""),
    (r"\s+[A-Z]+\s+CAMPUS$", ""),
    (r",?\s*(THE|INC\.?|LLC\.?|CORP\.?|LTD\.?|CO\.?)\s*$", ""),
    (r"^THE\s+", ""),
    (r"\s+(HEALTH SCIENCES|MEDICAL CAMPUS|MEDICAL CENTER|TEACHERS COLLEGE|SCHOOL OF MEDICINE)$", ""),
    (r"""[.,;:'"!]""", ""),
)


def normalise_org(x: Column) -> Column:
    return squish(reduce(lambda c, rule: F.regexp_replace(c, *rule), ORG_RULES, normalise_text(x)))


def distinctive_tokens(x: Column) -> Column:
    """The words of a name that tell it from others."""
    return F.array_except(F.split(x, r"\s+"), F.array(*[F.lit(w) for w in k.ORG_STOPWORDS]))


def share_distinctive_token(a: Column, b: Column) -> Column:
    return holds(F.arrays_overlap(distinctive_tokens(a), distinctive_tokens(b)))


def recipient_key(x: Column) -> Column:
    """White space collapses before punctuation becomes blanks, so two blanks may stay."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"[,.'\-]", " ")))


def clean_description(x: Column) -> Column:
    """Label, CDATA marks and tags go, in this order."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^DESCRIPTION:\s*", ""), r"<!\[CDATA\[|\]\]>", ""), r"<[^>]+>", "")


def internal_id(award: Column, agency: Column) -> Column:
    """The ledger's id of an award, null without a known agency or an id."""
    code = F.element_at(F.create_map(*[F.lit(x) for pair in k.AGENCY_CODES.items() for x in pair]), agency)
    return F.when(code.isNotNull() & (F.length(award) > 0), F.concat(F.lit("ASST_NON_"), award, F.lit("_"), code))


def cfda_mismatch(cfda: Column, agency: Column) -> Column:
    expected = F.element_at(F.create_map(*[F.lit(x) for pair in k.CFDA_AGENCY.items() for x in pair]), F.substring_index(cfda, ".", 1))
    return holds(expected != agency)


def emergency_codes(codes: Column) -> Column:
    """Any of the codes, parted by commas or semicolons, is an emergency code."""
    parts = F.transform(F.split(codes, "[,;]+"), lambda c: F.trim(c))
    return holds(F.arrays_overlap(parts, F.array(*[F.lit(c) for c in k.EMERGENCY_CODES])))


def period_date(period: Column) -> Column:
    """The first day of a month such as "Dec 2024"; of "Oct/Nov 2024" the first month counts."""
    return F.try_to_timestamp(F.concat(F.lit("01 "), F.regexp_replace(period, r"/[A-Za-z]+", "")), F.lit("dd MMM yyyy")).cast("date")


PERIOD_LINE = r"^(.+?):\s*\$?([0-9,.]+)$"


def parse_period_outlays(text: Column) -> Column:
    """Lines such as "- Dec 2024: $1,142" -> array of (period, amount, period_date); other lines are dropped."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(F.trim(line), r"^-\s*", ""))
    told = F.filter(lines, lambda line: line.rlike(PERIOD_LINE))

    def parts(line: Column) -> Column:
        period = F.trim(F.regexp_extract(line, PERIOD_LINE, 1))
        amount = F.regexp_replace(F.regexp_extract(line, PERIOD_LINE, 2), ",", "").try_cast("double")
        return F.struct(period.alias("period"), amount.alias("amount"), period_date(period).alias("period_date"))

    return F.transform(told, parts)


def fiscal_to_calendar(year: Column, month: Column) -> Column:
    """The first day of a fiscal month; fiscal years begin in October of the year before."""
    return F.make_date(F.when(month <= 3, year - 1).otherwise(year), F.pmod(month + 8, F.lit(12)) + 1, F.lit(1))


def fiscal_year(d: Column) -> Column:
    return F.year(F.add_months(d, 3))


def fiscal_month(d: Column) -> Column:
    return F.month(F.add_months(d, 3))


def elapsed_ratio(start: Column, end: Column, as_of: Column) -> Column:
    """The share of [start, end] that is over, from 0 to 1; null without a span."""
    share = F.date_diff(as_of, start) / F.date_diff(end, start)
    return F.when(end > start, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def activity_group(code: Column) -> Column:
    letters = ("R", "T", "F", "K", "P", "U")
    return reduce(lambda c, x: c.when(code.startswith(x), x), letters[1:], F.when(code.startswith(letters[0]), letters[0])).otherwise("Other")


def gap_confidence(days: Column) -> Column:
    return F.when(days > k.HIGH_GAP_DAYS, "high").when(days > k.MEDIUM_GAP_DAYS, "medium").otherwise("low")


def discrepancy_label(kind: Column, other: Column) -> Column:
    named = {"active_despite_terminated": "Active Despite Terminated", "possible_freeze": "Possible Freeze", "possible_freeze_no_data": "Possible Freeze (No Data)", "untracked": "Untracked"}
    return reduce(lambda c, x: c.when(kind == x[0], x[1]), list(named.items()), F.when(F.lit(False), "")).otherwise(other)
