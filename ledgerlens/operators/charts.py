"""The tables behind the charts and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import discrepancy_label, total


def institute_bars(notices: DataFrame, n: int = 15, agency: str = "NIH") -> DataFrame:
    """The n institutes with most notices, with all that tie with the last."""
    sums = notices.where((F.col("agency_name") == agency) & F.col("institute").isNotNull()).groupBy("institute").agg(F.count(F.lit(1)).alias("n_grants"), total(F.col("award_amount")).alias("total_amount"))
    return sums.withColumn("_r", F.rank().over(Window.orderBy(F.desc("n_grants")))).where(F.col("_r") <= n).drop("_r")


def labelled_summary(summary: DataFrame) -> DataFrame:
    return summary.withColumn("discrepancy_label", discrepancy_label(F.col("discrepancy_type"), F.col("discrepancy_type")))


def scatter(discrepancies: DataFrame) -> DataFrame:
    rows = discrepancies.where("outlay_ratio is not null and award_amount > 0")
    return rows.withColumn("discrepancy_label", discrepancy_label(F.col("discrepancy_type"), F.lit("Normal")))


def state_counts(notices: DataFrame, states: DataFrame) -> DataFrame:
    """Counts and sums by two-letter state, for every state of the given table (org_state, state_name)."""
    sums = notices.where(F.length("org_state") == 2).groupBy("org_state").agg(F.count(F.lit(1)).alias("n_grants"), total(F.col("award_amount")).alias("total_amount"))
    return states.join(sums, "org_state", "left")


def freeze_severity(discrepancies: DataFrame) -> DataFrame:
    rows = discrepancies.where("discrepancy_type in ('possible_freeze', 'possible_freeze_no_data') and elapsed_ratio is not null and outlay_ratio is not null and award_amount is not null")
    severe = (F.col("elapsed_ratio") > 0.5) & (F.col("outlay_ratio") < 0.10)
    return rows.withColumn("severity", F.when(severe, "High Urgency").otherwise("Lower Urgency"))


def status_label(status):
    """Statuses of the labels by the first text that they hold; capital letters count."""
    return (
        F.when(status.contains("Frozen"), "Frozen").when(status.contains("Unfrozen"), "Unfrozen")
        .when(status.contains("Terminated"), "Terminated").when(status.contains("Reinstated"), "Reinstated").otherwise("Other")
    )


def sample_timelines(data: DataFrame, n: int = 6, seed: int = 42) -> DataFrame:
    """n awards of each label by a hash of their id, one row a period; awards without periods vanish."""
    w = Window.partitionBy("gw_frozen").orderBy(F.md5(F.concat(F.col("gw_award_id"), F.lit(f":{seed}"))), "gw_award_id")
    chosen = data.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return chosen.select("gw_award_id", "gw_frozen", F.explode("periods").alias("p")).select("gw_award_id", "gw_frozen", "p.*")


def institution_scores(breakdown: DataFrame, least: int = 10) -> DataFrame:
    """Precision and recall as rows, of institutions with enough grants; the name without THE, cut to 30 characters."""
    rows = breakdown.where(F.col("n_grants") >= least).withColumn("label", F.substring(F.regexp_replace("org_name", "^(THE )?", ""), 1, 30))
    return rows.unpivot(["org_name", "label", "n_grants"], ["precision", "recall"], "metric", "value")


def kpis(discrepancies: DataFrame) -> DataFrame:
    return discrepancies.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("discrepancy_type") != "normal").alias("n_discrepancies"), total(F.col("award_amount")).alias("total_amount"))


def record_table(discrepancies: DataFrame) -> DataFrame:
    """What the dashboard lists: rows that aren't normal, renamed, amounts as text."""
    return discrepancies.where("discrepancy_type <> 'normal'").select(
        F.col("grant_number").alias("grant"), F.col("agency_name").alias("agency"), F.col("org_name").alias("organisation"),
        F.concat(F.lit("$"), F.format_number("award_amount", 0)).alias("amount"), F.col("discrepancy_type").alias("discrepancy"), F.col("match_method").alias("match"))
