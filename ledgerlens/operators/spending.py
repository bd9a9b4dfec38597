"""Spending by category, month and recipient, and its compression between two windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import fiscal_month, fiscal_year, recipient_key, safe_ratio


def in_window(df: DataFrame, date_col: str, start: str, end: str) -> DataFrame:
    return df.where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def by_category(spending: DataFrame, category: str, start: str, end: str, date_col: str = "action_date", amount_col: str = "award_amount") -> DataFrame:
    """Sums of a category over a date range; the range is carried as text."""
    return in_window(spending, date_col, start, end).groupBy(category).agg(F.sum(amount_col).alias("obligation_amount")).withColumns({"start_date": F.lit(start), "end_date": F.lit(end)})


def monthly_flow(spending: DataFrame, fiscal_years: list[int], as_of, agency_col: str = "agency_name", date_col: str = "action_date", amount_col: str = "award_amount") -> DataFrame:
    """Sums by agency and fiscal month up to today."""
    d = F.col(date_col)
    rows = spending.where(d <= F.lit(as_of).cast("date")).select(F.col(agency_col).alias("agency"), fiscal_year(d).alias("fiscal_year"), fiscal_month(d).alias("fiscal_period"), F.col(amount_col).alias("_a"))
    return rows.where(F.col("fiscal_year").isin(fiscal_years)).groupBy("agency", "fiscal_year", "fiscal_period").agg(F.sum("_a").alias("monthly_grant_obligations"))


def top_by_group(df: DataFrame, group: str, amount: str, n: int, *tie: str) -> DataFrame:
    """The n rows of each group with the largest amounts; nulls come last, ties go by the given columns."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(amount), *tie)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def search_institution(awards: DataFrame, text: str, n: int) -> DataFrame:
    """Up to n awards whose recipient's name holds the text in any case, the largest first."""
    return awards.where(F.upper("recipient_name").contains(text.upper())).orderBy(F.desc_nulls_last("award_amount"), "grant_number").limit(n)


def top_recipients(spending: DataFrame, start: str, end: str, n: int, date_col: str = "action_date", amount_col: str = "award_amount") -> DataFrame:
    """recipient_id, recipient_name and amount_M of the n largest recipients of a window."""
    sums = in_window(spending, date_col, start, end).groupBy("recipient_id", "recipient_name").agg(F.sum(amount_col).alias("_a"))
    best = sums.orderBy(F.desc_nulls_last("_a"), "recipient_name").limit(n)
    return best.select("recipient_id", "recipient_name", (F.col("_a") / 1e6).alias("amount_M"))


def dedup_recipients(df: DataFrame) -> DataFrame:
    """One row for each id, the one with the largest amount; every row without an id stays."""
    w = Window.partitionBy("recipient_id").orderBy(F.desc_nulls_last("amount_M"), "recipient_name")
    known = df.where("recipient_id is not null").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return known.unionByName(df.where("recipient_id is null"))


def compression(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """How far recipients of the baseline fell: matched by id, else by name, else below the current cutoff.

    Every baseline row that matches neither way comes out once, with or without an
    id. The floor is the least current amount, or 0 if there is none. Rows with a
    current amount come first, those that fell the most before the others.
    """
    base = dedup_recipients(baseline).withColumn("name_key", recipient_key(F.col("recipient_name"))).withColumnRenamed("amount_M", "baseline_M")
    now = dedup_recipients(current).withColumn("name_key", recipient_key(F.col("recipient_name")))
    by_id = base.join(now.select("recipient_id", F.col("amount_M").alias("current_M")), "recipient_id")
    ids = by_id.select(F.col("recipient_id").alias("_id")).distinct()
    matched = lambda df: df.join(ids, F.col("recipient_id") == F.col("_id"), "left_anti")
    rest, spare = matched(base), matched(now)
    by_name = rest.join(spare.select("name_key", F.col("amount_M").alias("current_M")), "name_key")
    none = rest.join(spare.select(F.col("name_key").alias("_n")).distinct(), F.col("name_key") == F.col("_n"), "left_anti")
    rows = by_id.withColumn("join_method", F.lit("recipient_id")).unionByName(by_name.withColumn("join_method", F.lit("name"))).unionByName(
        none.withColumns({"current_M": F.lit(None).cast("double"), "join_method": F.lit("none")}))
    floor = now.agg(F.coalesce(F.min("amount_M"), F.lit(0.0)).alias("cutoff_floor_M"))
    below = F.col("current_M").isNull()
    yoy = F.when(~below & (F.col("baseline_M") != 0), F.round((F.col("current_M") - F.col("baseline_M")) / F.nullif("baseline_M", F.lit(0.0)) * 100, 1))
    rows = rows.withColumns({"below_cutoff": below, "yoy_pct": yoy, "drop_M": F.round(F.col("baseline_M") - F.col("current_M"), 2)})
    told = rows.join(F.broadcast(floor), how="cross").orderBy("below_cutoff", F.asc_nulls_last("yoy_pct"), "recipient_name", "recipient_id")
    return told.select("recipient_name", "recipient_id", "baseline_M", "current_M", "yoy_pct", "drop_M", "below_cutoff", "cutoff_floor_M", "join_method")


def obligation_rates(periods: DataFrame) -> DataFrame:
    """obligations_cumulative over budgetary_resources, null unless these are positive."""
    return periods.withColumn("obligation_rate", safe_ratio(F.col("obligations_cumulative"), F.col("budgetary_resources")))
