"""Checks of notices and awards, quality flags, and a profile of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens import constants as k
from ledgerlens.functions.scalars import cfda_mismatch, holds, member
from ledgerlens.schemas import AWARDS, ensure_columns, fields, require_columns

NOTICE_COLUMNS = fields("agency_name string, notice_date date, source_url string, raw_text_snippet string")
AWARD_COLUMNS = fields("agency_name string, award_amount double, action_date date, grant_number string")


def check_notices(df: DataFrame) -> DataFrame:
    """df, or an error: at once if columns are missing or of another type, and when a row is read whose agency_name or source_url is null or empty.

    The rule is a filter of the plan that keeps every row or fails, so it costs no pass of its own, and columns that aren't asked for can't hide it.
    """
    require_columns(df, NOTICE_COLUMNS)
    rule = F.lit(True)
    for c in ("source_url", "agency_name"):
        rule = F.when(holds(F.length(c) > 0), rule).otherwise(F.raise_error(F.lit(f"empty values: {c}")).cast("boolean"))
    return df.where(rule)


def check_awards(df: DataFrame) -> DataFrame:
    require_columns(df, AWARD_COLUMNS)
    return df


def flag_notices(df: DataFrame) -> DataFrame:
    """Foreign and unknown states, and grant numbers that aren't of the agency's form; false where a column is absent."""
    state = F.col("org_state") if "org_state" in df.columns else F.lit(None).cast("string")
    number = F.col("grant_number") if "grant_number" in df.columns else F.lit(None).cast("string")
    malformed = F.when(F.col("agency_name") == "NSF", ~number.rlike("^[0-9]{7}$")).when(F.col("agency_name") == "NIH", ~number.rlike("^[A-Z0-9]")).otherwise(False)
    return df.withColumns({
        "flag_international": member(state, k.CANADIAN_PROVINCES),
        "flag_invalid_state": state.isNotNull() & ~member(state, k.US_STATES + k.CANADIAN_PROVINCES),
        "flag_bad_grant_number": number.isNotNull() & holds(malformed),
    })


def flag_awards(df: DataFrame, as_of) -> DataFrame:
    """Flags that are false where a value is null. as_of: the date that counts as today."""
    df = ensure_columns(df, StructType([f for f in AWARDS if f.name in ("total_outlays", "end_date", "cfda_number")]))
    c = F.col
    return df.withColumns({
        "flag_negative_outlay": holds(c("total_outlays") < 0),
        "flag_over_disbursed": holds((c("award_amount") > 0) & (c("total_outlays") > c("award_amount") * k.OVER_DISBURSED)),
        "flag_date_inverted": holds(c("end_date") < c("action_date")),
        "flag_zero_award": holds(c("award_amount") == 0),
        "flag_future_date": holds(c("action_date") > as_of),
        "flag_cfda_mismatch": cfda_mismatch(c("cfda_number"), c("agency_name")),
    })


def duplicate_count(df: DataFrame, column: str, count_nulls: bool) -> DataFrame:
    """n_duplicates: rows beyond the first of their value; nulls are one value or not counted."""
    once = F.count_distinct(column)
    extra = F.count(column) - once
    if count_nulls:
        extra = extra + F.greatest(F.lit(0), F.count_if(F.col(column).isNull()) - 1)
    return df.agg(extra.cast("long").alias("n_duplicates"))


def profile(df: DataFrame) -> DataFrame:
    """One row a column: column, pct_null, high_null (over 5 %), n_flagged and pct_flagged of flag_ columns; one pass over df."""
    n = F.count(F.lit(1))
    flags = [c for c in df.columns if c.startswith("flag_")]
    counts = df.agg(n.alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in df.columns], *[F.count_if(F.col(c)).alias(f"flag:{c}") for c in flags])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`null:{c}`").alias("n_null"), (F.col(f"`flag:{c}`") if c in flags else F.lit(None).cast("long")).alias("n_flagged")) for c in df.columns
    ])).alias("r")
    share = lambda c: F.round(100 * F.try_divide(F.col(c), F.col("n")), 1)
    return counts.select("n", rows).select("n", "r.*").select("column", share("n_null").alias("pct_null"), holds(share("n_null") > 5).alias("high_null"), "n_flagged", share("n_flagged").alias("pct_flagged"))


def write_with_profile(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and return its profile(), counted by the write itself: no pass of its own."""
    seen = Observation("profile")
    names = list(enumerate(df.columns))  # metrics go by place, whatever the columns are called
    flags = [(i, c) for i, c in names if c.startswith("flag_")]
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null{i}") for i, c in names], *[F.count_if(F.col(f"`{c}`")).alias(f"flag{i}") for i, c in flags]]
    df.observe(seen, *counts).write.mode("overwrite").parquet(path)
    got = seen.get
    share = lambda n: round(100 * n / got["n"] + 1e-9, 1) if got["n"] else None
    rows = [(c, share(got[f"null{i}"]), (share(got[f"null{i}"]) or 0) > 5, got.get(f"flag{i}"), None if (i, c) not in flags else share(got[f"flag{i}"])) for i, c in names]
    return df.sparkSession.createDataFrame(rows, "`column` string, pct_null double, high_null boolean, n_flagged long, pct_flagged double")


def reporting_filter(df: DataFrame, since="2020-01-01", exact_only: bool = False) -> DataFrame:
    """Rows fit for published totals: no umbrella award, a plausible outlay ratio, recent enough."""
    kept = df.where((F.col("award_amount") < k.UMBRELLA_AMOUNT) & F.col("outlay_ratio").between(0, k.OVER_DISBURSED) & (F.col("action_date") >= F.lit(since).cast("date")))
    return kept.where("match_method = 'exact'") if exact_only else kept
