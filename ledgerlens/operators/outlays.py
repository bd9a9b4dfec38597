"""Outlays by reporting period: roll-up, features, targeting windows, activity after termination, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import constants as k
from ledgerlens.functions.scalars import safe_ratio, total


def roll_up(records: DataFrame) -> DataFrame:
    """Accounts of one grant and period summed."""
    return records.groupBy("grant_number", "reporting_date", "reporting_year", "reporting_month").agg(
        total(F.col("outlay_amount")).alias("outlay_amount"), total(F.col("obligated_amount")).alias("obligated_amount"), F.count(F.lit(1)).alias("n_accounts"))


def positive(c: str = "outlay_amount") -> Column:
    return F.coalesce(F.col(c) > 0, F.lit(False))


def features(file_c: DataFrame) -> DataFrame:
    """By grant: last date with outlays, records without outlays at the end, periods, periods with outlays, sum.

    Records are in order of date, those without a date last; nulls and negative
    amounts count as no outlays.
    """
    back = Window.partitionBy("grant_number").orderBy(F.desc_nulls_first("reporting_date"), F.desc(positive()))
    ranked = file_c.withColumn("_back", F.row_number().over(back))
    return ranked.groupBy("grant_number").agg(
        F.max(F.when(positive(), F.col("reporting_date"))).alias("file_c_last_outlay_date"),
        F.coalesce(F.min(F.when(positive(), F.col("_back"))) - 1, F.count(F.lit(1))).cast("int").alias("file_c_months_zero"),
        F.count(F.lit(1)).cast("int").alias("file_c_total_periods"),
        F.count_if(positive()).cast("int").alias("file_c_periods_with_outlays"),
        total(F.col("outlay_amount")).alias("file_c_total_outlays"))


def targeting_lookup(labels: DataFrame, as_of) -> DataFrame:
    """By organisation: first start, last end (an open one ends today), grants."""
    end = F.coalesce("targeted_end_date", F.lit(as_of).cast("date"))
    return labels.where("targeted_start_date is not null and org_name is not null").groupBy("org_name").agg(
        F.min("targeted_start_date").alias("targeting_start"), F.max(end).alias("targeting_end"), F.count(F.lit(1)).cast("int").alias("n_grants"))


def first_by_grant(df: DataFrame, columns: list[str], order: list) -> DataFrame:
    """Each grant's first row in a declared order."""
    return df.groupBy("grant_number").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("grant_number", "_r.*")


def temporal_features(base: DataFrame, file_c: DataFrame, targeting: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """features() plus outlays before and during the organisation's targeting window, both ends included.

    The share paid before it is of the award's amount if discrepancies have that column, else of all outlays.
    """
    org = "recipient_name" if "recipient_name" in discrepancies.columns else "org_name"
    amount = [c for c in ("award_amount",) if c in discrepancies.columns]
    grants = first_by_grant(discrepancies, [org, *amount], [F.col(org), *[-F.col(c) for c in amount]])
    upper = targeting.select(F.upper("org_name").alias("_org"), "targeting_start", "targeting_end")
    windows = grants.join(upper, F.upper(org) == F.col("_org")).drop("_org", org)
    d, paid = F.col("reporting_date"), F.coalesce("outlay_amount", F.lit(0.0))
    during = d.between(F.col("targeting_start"), F.col("targeting_end"))
    found = file_c.join(windows, "grant_number").groupBy("grant_number", "targeting_start", "targeting_end", *amount).agg(
        total(F.when(d < F.col("targeting_start"), paid)).alias("outlays_before_targeting"),
        total(F.when(during, paid)).alias("outlays_during_targeting"),
        F.count_if(during & (paid == 0)).cast("int").alias("months_zero_during_freeze")).drop("targeting_start", "targeting_end")
    share = safe_ratio(F.col("outlays_before_targeting"), F.col(amount[0] if amount else "file_c_total_outlays"))
    return base.join(found, "grant_number", "left").withColumn("pct_outlaid_at_targeting", share).drop(*amount)


def post_termination(file_c: DataFrame, discrepancies: DataFrame, closeout_days: int = k.CLOSEOUT_DAYS, min_outlay: float = k.MIN_POST_OUTLAY) -> DataFrame:
    """Of terminated grants with period data: outlays of min_outlay or more after the closeout window.

    One aggregate over all periods gives both the grants with such outlays and, with a false flag, those without.
    The notice date is that of the grant's first row by type, falling amount and date.
    """
    ended = first_by_grant(discrepancies.where("notice_date is not null"), ["notice_date"], [F.col("discrepancy_type"), -F.coalesce("award_amount", F.lit(0.0)), F.col("notice_date")]) \
        if {"discrepancy_type", "award_amount"} <= set(discrepancies.columns) else first_by_grant(discrepancies.where("notice_date is not null"), ["notice_date"], [F.col("notice_date")])
    rows = file_c.join(ended.withColumn("_deadline", F.date_add("notice_date", closeout_days)), "grant_number")
    late = F.coalesce((F.col("reporting_date") > F.col("_deadline")) & (F.col("outlay_amount") >= min_outlay), F.lit(False))
    return rows.groupBy("grant_number").agg(
        F.max(late).alias("flag_confirmed_post_termination_outlays"), F.count_if(late).cast("int").alias("n_post_termination_periods"),
        total(F.when(late, F.col("outlay_amount"))).alias("post_termination_total_outlays"),
        F.min(F.when(late, F.col("reporting_date"))).alias("post_termination_first_date"), F.max(F.when(late, F.col("reporting_date"))).alias("post_termination_last_date"))


def freeze_evidence() -> Column:
    zero, gap = F.col("file_c_months_zero"), F.col("days_since_last_transaction")
    unknown = F.col("file_c_total_periods").isNull()
    return (
        F.when(unknown & F.col("discrepancy_type").isin(*k.FROZEN_TYPES), "possible_freeze")
        .when(unknown, F.lit(None).cast("string"))
        .when((zero >= 3) & (gap > k.HIGH_GAP_DAYS), "confirmed_freeze")
        .when((zero >= 1) & (gap > k.MEDIUM_GAP_DAYS), "likely_freeze")
        .when((zero == 0) & (F.col("file_c_periods_with_outlays") == F.col("file_c_total_periods")), "confirmed_not_frozen")
        .when(zero == 0, "likely_not_frozen")
        .otherwise("possible_freeze")
    )


def enrich(discrepancies: DataFrame, base: DataFrame, file_c: DataFrame | None = None) -> DataFrame:
    """Join the features, tell the evidence for a freeze, and flag activity after termination."""
    out = discrepancies.join(base, "grant_number", "left").withColumn("freeze_evidence", freeze_evidence())
    if file_c is None:
        return out.withColumn("flag_confirmed_post_termination_outlays", F.lit(None).cast("boolean"))
    return out.join(post_termination(file_c, discrepancies).select("grant_number", "flag_confirmed_post_termination_outlays"), "grant_number", "left")
