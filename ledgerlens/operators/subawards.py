"""Money that flows on to sub-recipients, and emergency funds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as k
from ledgerlens.functions.scalars import emergency_codes, member, total
from ledgerlens.operators.outlays import first_by_grant
from ledgerlens.operators.transactions import select_ids


def seen_at(df: DataFrame) -> Column:
    """When a row is seen: those with an id first, by date, undated ones last, then by id."""
    day = F.coalesce(F.col("subaward_date").cast("string"), F.lit("9999-12-31"))
    if "subaward_id" not in df.columns:
        return day
    return F.concat(F.col("subaward_id").isNull().cast("int").cast("string"), day, F.lit(" "), F.coalesce("subaward_id", F.lit("")))


def in_order(pairs: Column, sep: str) -> Column:
    """The values of an array of (when first seen, value) in this order."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["v"]), sep)


def flow(subawards: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """Sub-awards with the classification of their prime award, many to many."""
    told = discrepancies.select(F.col("grant_number").alias("_g"), "discrepancy_type", *[c for c in ("outlay_ratio", "freeze_confidence", "award_amount") if c in discrepancies.columns])
    return subawards.join(told, F.col("prime_award_id") == F.col("_g")).drop("_g")


def by_prime(joined: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """By prime award, with its sub-recipients in the order in which they are first seen, a null as the text NA.

    Rows are first combined by sub-recipient; a result lists all of these names, so it is as long as they are many.
    """
    rows = joined.where(member(F.col("discrepancy_type"), types)).withColumns({"v": F.coalesce("subawardee_name", F.lit("NA")), "_at": seen_at(joined)})
    once = rows.groupBy("prime_award_id", "prime_recipient", "v").agg(F.count(F.lit(1)).alias("_n"), F.sum("subaward_amount").alias("_sum"), F.max("subaward_date").alias("_latest"), F.min("_at").alias("_at"))
    return once.groupBy("prime_award_id", "prime_recipient").agg(
        F.sum("_n").alias("n_subawards"), total(F.col("_sum")).alias("total_subaward_amount"),
        in_order(F.collect_list(F.struct("_at", "v")), "; ").alias("subawardees"), F.max("_latest").alias("latest_subaward_date"))


def frozen(joined: DataFrame) -> DataFrame:
    """Frozen awards whose money still flows on, the largest sum first."""
    return by_prime(joined, k.FROZEN_TYPES).orderBy(F.desc_nulls_last("total_subaward_amount"), "prime_award_id", "prime_recipient")


def terminated(joined: DataFrame) -> DataFrame:
    """Sub-recipients of terminated awards, by award."""
    return by_prime(joined, ("active_despite_terminated",)).orderBy("prime_award_id", "prime_recipient")


def downstream(joined: DataFrame) -> DataFrame:
    """Sub-recipients of awards that aren't normal, those of the most awards first; types and institutions in the order in which they are first seen.

    Awards, types and institutions are combined by sub-recipient before they are counted and listed.
    """
    told = F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(v, F.lit("NA")).alias("v"), amount.alias("a")) for kind, v, amount in (("award", "prime_award_id", F.col("subaward_amount")), ("type", "discrepancy_type", F.lit(None).cast("double")), ("institution", "prime_recipient", F.lit(None).cast("double")))])
    rows = joined.where("discrepancy_type <> 'normal'").select("subawardee_name", seen_at(joined).alias("_at"), F.inline(told))
    once = rows.groupBy("subawardee_name", "kind", "v").agg(F.min("_at").alias("_at"), F.sum("a").alias("_sum"))
    listed = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("_at", "v")))
    out = once.groupBy("subawardee_name").agg(
        F.count_if(F.col("kind") == "award").alias("n_prime_awards"), total(F.col("_sum")).alias("total_subaward_amount"),
        in_order(listed("type"), ", ").alias("discrepancy_types"), in_order(listed("institution"), "; ").alias("prime_institutions"))
    return out.orderBy(F.desc("n_prime_awards"), "subawardee_name")


def impact(subawards: DataFrame, ids: DataFrame) -> DataFrame:
    """Count and sum of sub-awards of the given prime awards (column grant_number)."""
    chosen = select_ids(subawards.withColumnRenamed("prime_award_id", "grant_number"), ids)
    return chosen.groupBy(F.col("grant_number").alias("award_id")).agg(F.count(F.lit(1)).cast("int").alias("subaward_count"), total(F.col("subaward_amount")).alias("subaward_obligation"))


def emergency_flags(discrepancies: DataFrame, awards: DataFrame | None = None) -> DataFrame:
    """Freeze-related awards that carry emergency fund codes; the awards' codes, if given, replace those that are there."""
    out = discrepancies
    if awards is not None and "def_codes" in awards.columns:
        codes = first_by_grant(awards, ["def_codes"], [F.col("def_codes").isNull(), F.col("def_codes")])
        out = out.drop("def_codes").join(codes, "grant_number", "left")
    elif "def_codes" not in out.columns:
        return out.withColumn("flag_emergency_exempt", F.lit(None).cast("boolean"))
    return out.withColumn("flag_emergency_exempt", emergency_codes(F.col("def_codes")) & member(F.col("discrepancy_type"), k.FREEZE_RELATED_TYPES))
