"""The monthly de-obligation and period roll-ups over streams of transactions and period records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import total


def deobligation_months(transactions: DataFrame, time_col: str = "ts", late: str = "30 days") -> DataFrame:
    """By calendar month: negative amounts, counted and summed; distinct grants are counted approximately, since a stream can't keep them."""
    rows = transactions.where("obligation_amount < 0").withWatermark(time_col, late)
    return rows.groupBy(F.date_trunc("month", F.col(time_col)).alias("month")).agg(F.count(F.lit(1)).alias("n_deobligations"), F.approx_count_distinct("grant_number").alias("n_grants_affected"), F.sum("obligation_amount").alias("total_deobligated"))


def period_outlays(records: DataFrame, time_col: str = "ts", late: str = "30 days") -> DataFrame:
    """By grant and day: outlays summed, with late records up to the watermark."""
    return records.withWatermark(time_col, late).groupBy("grant_number", F.window(time_col, "1 day").alias("w")).agg(total(F.col("outlay_amount")).alias("outlay_amount"), F.count(F.lit(1)).alias("n_accounts"))
