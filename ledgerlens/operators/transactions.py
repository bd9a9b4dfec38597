"""Transaction recency, de-obligations, terminations and reinstatements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import constants as k
from ledgerlens.functions.scalars import gap_confidence, member, total


def select_ids(transactions: DataFrame, ids: DataFrame, key: str = "grant_number") -> DataFrame:
    """Rows whose key is among the distinct, known ids: what fetching by id lists gives."""
    return transactions.join(ids.select(F.col(key).alias("_id")).where("_id is not null").distinct(), F.col(key) == F.col("_id"), "left_semi")


def summarise(transactions: DataFrame, as_of) -> DataFrame:
    """By grant: last date, count, sum, days since, and how sure a freeze is."""
    out = transactions.where("transaction_date is not null").groupBy("grant_number").agg(
        F.max("transaction_date").alias("last_transaction_date"), F.count(F.lit(1)).alias("n_transactions"), total(F.col("obligation_amount")).alias("total_obligated"))
    days = F.date_diff(F.lit(as_of).cast("date"), "last_transaction_date")
    return out.withColumn("days_since_last_transaction", days).withColumn("freeze_confidence", gap_confidence(F.col("days_since_last_transaction")))


def enrich(discrepancies: DataFrame, transactions: DataFrame, as_of) -> DataFrame:
    told = summarise(transactions, as_of).select("grant_number", "last_transaction_date", "days_since_last_transaction", "freeze_confidence")
    return discrepancies.join(told, "grant_number", "left")


def deobligations(transactions: DataFrame, min_amount: float = k.DEOBLIGATION_MIN_AMOUNT, min_events: int = k.DEOBLIGATION_MIN_EVENTS) -> DataFrame:
    """By grant with amounts below -min_amount, the largest sum first; flagged from min_events such amounts."""
    out = transactions.where(F.col("obligation_amount") < -min_amount).groupBy("grant_number").agg(
        F.count(F.lit(1)).alias("n_deobligations"), F.sum("obligation_amount").alias("total_deobligated"),
        F.min("transaction_date").alias("first_deobligation_date"), F.max("transaction_date").alias("last_deobligation_date"))
    return out.withColumn("deobligation_flag", F.col("n_deobligations") >= min_events).orderBy("total_deobligated", "grant_number")


def deobligation_months(transactions: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """By agency and month, in this order, with months of more than twice the agency's median count and three grants or more flagged as spikes."""
    agencies = discrepancies.select("grant_number", "agency_name").distinct()
    rows = transactions.where("obligation_amount < 0 and transaction_date is not null").join(agencies, "grant_number").where("agency_name is not null")
    monthly = rows.withColumn("year_month", F.date_format("transaction_date", "yyyy-MM")).groupBy("agency_name", "year_month").agg(
        F.count(F.lit(1)).alias("n_deobligations"), F.count_distinct("grant_number").alias("n_grants_affected"), F.sum("obligation_amount").alias("total_deobligated"))
    # the months of one agency are few
    monthly = monthly.withColumn("median_monthly", F.median("n_deobligations").over(Window.partitionBy("agency_name")))
    return monthly.withColumn("spike_flag", (F.col("n_deobligations") > 2 * F.col("median_monthly")) & (F.col("n_grants_affected") >= 3)).orderBy("agency_name", "year_month")


def _first(df: DataFrame, order: list, columns: dict[str, str]) -> DataFrame:
    """Of each grant the row that comes first in the order, by a grouped minimum, which needs no sort of a grant's rows."""
    told = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    return df.groupBy("grant_number").agg(F.min_by(told, F.struct(*order)).alias("_r")).select("grant_number", "_r.*")


def terminations(transactions: DataFrame) -> DataFrame:
    """The latest termination of each grant; of those of one day, the one with the least modification number and type."""
    rows = transactions.where(member(F.col("action_type"), k.TERMINATION_ACTIONS) & F.col("transaction_date").isNotNull())
    order = [-F.unix_date("transaction_date"), F.col("modification_number"), F.col("action_type")]
    return _first(rows, order, {"termination_action_date": "transaction_date", "termination_action_type": "action_type", "termination_mod_number": "modification_number"})


def reinstatements(transactions: DataFrame) -> DataFrame:
    """The earliest new activity strictly after the latest termination."""
    last = transactions.where(member(F.col("action_type"), k.TERMINATION_ACTIONS) & F.col("transaction_date").isNotNull()).groupBy("grant_number").agg(F.max("transaction_date").alias("termination_action_date"))
    rows = transactions.where(member(F.col("action_type"), k.ACTIVITY_ACTIONS)).join(last, "grant_number").where("transaction_date > termination_action_date")
    return _first(rows, [F.col("transaction_date"), F.col("action_type")], {"termination_action_date": "termination_action_date", "reinstatement_action_date": "transaction_date", "reinstatement_action_type": "action_type"})
