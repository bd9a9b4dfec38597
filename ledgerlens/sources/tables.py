"""Readers of the raw payloads (JSON, CSV), and stored snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import clean_description, fiscal_to_calendar, holds, parse_amount, parse_date, safe_ratio, squish, to_number
from ledgerlens.schemas import FILE_C

NIH_PAGE = """struct<results: array<struct<appl_id: string, project_title: string, project_num: string, project_end_date: string, date_added: string,
    award_amount: double, is_active: boolean, organization: struct<org_name: string, org_state: string>,
    agency_ic_fundings: array<struct<abbreviation: string>>, ic_name: string>>>"""
AWARD_PAGE = """struct<results: array<struct<`Award ID`: string, `Recipient Name`: string, `Recipient UEI`: string, `Awarding Agency`: string, `Awarding Sub Agency`: string,
    `Award Amount`: double, `Total Outlays`: double, `Start Date`: string, `End Date`: string, `Last Modified Date`: string, Description: string,
    `CFDA Number`: string, def_codes: array<string>, generated_internal_id: string>>>"""
FUNDING_PAGE = """struct<results: array<struct<reporting_fiscal_year: int, reporting_fiscal_month: int, gross_outlay_amount: double,
    transaction_obligated_amount: double, federal_account: string, account_title: string>>>"""
FLOW_PAGE = "struct<results: array<struct<time_period: struct<fiscal_year: string, month: string>, Grant_Obligations: string>>>"
BUDGET_PAGE = """struct<agency_data_by_year: array<struct<fiscal_year: int, agency_total_obligated: string, agency_total_outlayed: string, agency_budgetary_resources: string,
    agency_obligation_by_period: array<struct<period: int, obligated: string>>>>>"""
IMPACT_PAGE = "struct<results: array<struct<award_id: string, subaward_count: int, subaward_obligation: double, award_generated_internal_id: string>>>"
SUBAWARD_PAGE = """struct<results: array<struct<`Sub-Award ID`: string, `Sub-Awardee Name`: string, `Sub-Award Date`: string, `Sub-Award Amount`: double,
    `Prime Award ID`: string, `Prime Recipient Name`: string, `Awarding Agency`: string, `Awarding Sub Agency`: string>>>"""
TRANSACTION_PAGE = """struct<results: array<struct<`Award ID`: string, `Action Date`: string, `Transaction Amount`: double, `Transaction Description`: string,
    `Action Type`: string, Mod: string>>>"""


def _records(pages: DataFrame, schema: str, *keep: str) -> DataFrame:
    """Column r for each element of results; pages that don't parse or are empty give none."""
    return pages.select(*keep, F.explode(F.from_json("payload", schema)["results"]).alias("r"))


def institute(r: Column) -> Column:
    """The first funding's abbreviation, unless empty, else the name."""
    return F.coalesce(F.nullif(F.get(r["agency_ic_fundings"], 0)["abbreviation"], F.lit("")), r["ic_name"])


def nih_notices(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """Notices from pages (payload: JSON text): one row a grant number, none that is still active."""
    r = F.col("r")
    rows = _records(pages, NIH_PAGE).select(
        F.lit("NIH").alias("agency_name"), institute(r).alias("institute"), parse_date(r["project_end_date"]).alias("notice_date"), parse_date(r["date_added"]).alias("date_added"),
        F.concat(F.lit("https://reporter.nih.gov/project-details/"), F.coalesce(r["appl_id"], F.lit(""))).alias("source_url"), r["project_title"].alias("raw_text_snippet"),
        r["project_num"].alias("grant_number"), r["organization"]["org_name"].alias("org_name"), r["organization"]["org_state"].alias("org_state"), r["award_amount"].alias("award_amount"), r["is_active"].alias("is_active"))
    return one_per_grant(rows, max_records)


def one_per_grant(rows: DataFrame, max_records: int | None = None) -> DataFrame:
    """Of overlapping pages one row a grant number, the latest by date; active ones go; veterans' grants get their institute."""
    order = F.struct(F.coalesce(-F.unix_date("notice_date"), F.lit(2**30)), F.col("source_url"))
    names = rows.columns
    once = rows.groupBy(F.col("grant_number").alias("_g")).agg(F.min_by(F.struct(*names), order).alias("_r")).select("_r.*")
    once = once.where(~holds(F.col("is_active"))).withColumn("institute", F.when(F.col("institute").isNull() & F.col("grant_number").startswith("VA"), "VA").otherwise(F.col("institute")))
    return once if max_records is None else once.orderBy(F.desc_nulls_last("notice_date"), "grant_number").limit(max_records)


def awards(pages: DataFrame) -> DataFrame:
    r = F.col("r")
    return _records(pages, AWARD_PAGE).select(
        r["Award ID"].alias("grant_number"), r["Recipient Name"].alias("recipient_name"), r["Recipient UEI"].alias("recipient_uei"), r["Awarding Agency"].alias("agency_name"), r["Awarding Sub Agency"].alias("sub_agency"),
        r["Award Amount"].alias("award_amount"), r["Total Outlays"].alias("total_outlays"), parse_date(r["Start Date"]).alias("action_date"), parse_date(r["End Date"]).alias("end_date"), parse_date(r["Last Modified Date"]).alias("last_modified_date"),
        clean_description(r["Description"]).alias("description"), r["CFDA Number"].alias("cfda_number"), F.nullif(F.array_join(r["def_codes"], ","), F.lit("")).alias("def_codes"), r["generated_internal_id"].alias("generated_internal_id"))


def transactions(pages: DataFrame) -> DataFrame:
    r = F.col("r")
    return _records(pages, TRANSACTION_PAGE).select(r["Award ID"].alias("grant_number"), parse_date(r["Action Date"]).alias("transaction_date"), r["Transaction Amount"].alias("obligation_amount"), r["Transaction Description"].alias("transaction_desc"), r["Action Type"].alias("action_type"), r["Mod"].alias("modification_number"))


def subawards(pages: DataFrame) -> DataFrame:
    r = F.col("r")
    return _records(pages, SUBAWARD_PAGE).select(r["Sub-Award ID"].alias("subaward_id"), r["Sub-Awardee Name"].alias("subawardee_name"), parse_date(r["Sub-Award Date"]).alias("subaward_date"), r["Sub-Award Amount"].alias("subaward_amount"), r["Prime Award ID"].alias("prime_award_id"), r["Prime Recipient Name"].alias("prime_recipient"), r["Awarding Agency"].alias("agency_name"), r["Awarding Sub Agency"].alias("sub_agency"))


def file_c(pages: DataFrame) -> DataFrame:
    """Period records of pages (grant_number, payload)."""
    r = F.col("r")
    year, month = r["reporting_fiscal_year"], r["reporting_fiscal_month"]
    return _records(pages, FUNDING_PAGE, "grant_number").select("grant_number", fiscal_to_calendar(year, month).alias("reporting_date"), year.alias("reporting_year"), month.alias("reporting_month"), r["gross_outlay_amount"].alias("outlay_amount"), r["transaction_obligated_amount"].alias("obligated_amount"), r["federal_account"].alias("federal_account"), r["account_title"].alias("account_title"))


def file_c_if_available(pages: DataFrame) -> DataFrame:
    """file_c(), or no rows with its schema if no page at all is JSON with results: the probe before a long read. A bad page voids no other."""
    answered = pages.where(F.size(F.from_json("payload", FUNDING_PAGE)["results"]) > 0)
    return pages.sparkSession.createDataFrame([], FILE_C) if answered.isEmpty() else file_c(pages)


def spending_over_time(pages: DataFrame) -> DataFrame:
    """Monthly sums of pages (agency, payload)."""
    r = F.col("r")
    return _records(pages, FLOW_PAGE, "agency").select("agency", r["time_period"]["fiscal_year"].try_cast("int").alias("fiscal_year"), r["time_period"]["month"].try_cast("int").alias("fiscal_period"), to_number(r["Grant_Obligations"]).alias("monthly_grant_obligations"))


def agency_obligations(pages: DataFrame, fiscal_years: list[int] | None = None) -> DataFrame:
    """Years and their periods of pages (agency, payload); years without periods give no row."""
    y, p = F.col("y"), F.col("p")
    rows = pages.select("agency", F.explode(F.from_json("payload", BUDGET_PAGE)["agency_data_by_year"]).alias("y")).select("agency", "y", F.explode(y["agency_obligation_by_period"]).alias("p"))
    rows = rows.select("agency", y["fiscal_year"].alias("fiscal_year"), p["period"].alias("fiscal_period"), to_number(p["obligated"]).alias("obligations_cumulative"), to_number(y["agency_budgetary_resources"]).alias("budgetary_resources"), to_number(y["agency_total_obligated"]).alias("total_obligated_yr"), to_number(y["agency_total_outlayed"]).alias("total_outlayed_yr"))
    rows = rows.withColumn("obligation_rate", safe_ratio(F.col("obligations_cumulative"), F.col("budgetary_resources")))
    return rows if fiscal_years is None else rows.where(F.col("fiscal_year").isin(fiscal_years))


def subaward_impact(pages: DataFrame) -> DataFrame:
    return _records(pages, IMPACT_PAGE).select("r.*")


NSF_COLUMNS = "award_id string, directorate string, recipient string, title string, obligated string, _phantom string, _meta string"


def nsf_rows(raw: DataFrame) -> DataFrame:
    """Notices from the file's columns as text; empty rows go. The dates of these notices are unknown."""
    raw = raw.drop("_phantom", "_meta").dropna(how="all")
    c = {n: squish(F.col(n)) if n != "obligated" else F.col(n) for n in raw.columns}
    url = F.concat(F.lit("https://www.nsf.gov/awardsearch/showAward?AWD_ID="), F.coalesce(c["award_id"], F.lit("")))
    return raw.select(F.lit("NSF").alias("agency_name"), c["directorate"].alias("directorate"), F.lit(None).cast("date").alias("notice_date"), url.alias("source_url"), c["title"].alias("raw_text_snippet"), c["award_id"].alias("grant_number"), c["recipient"].alias("org_name"), parse_amount(c["obligated"]).alias("award_amount"))


def nsf_notices(spark: SparkSession, path: str) -> DataFrame:
    """nsf_rows() of the terminated-awards CSV (Latin-1), whose header is skipped."""
    return nsf_rows(spark.read.csv(path, schema=NSF_COLUMNS, encoding="ISO-8859-1", header=True, enforceSchema=True, quote='"', escape='"', multiLine=True))


def export_date(spark: SparkSession, path: str) -> DataFrame:
    """export_date from the header line of that CSV, one row."""
    return header_date(spark.read.text(path).limit(1))


def header_date(header: DataFrame) -> DataFrame:
    return header.select(parse_date(F.regexp_extract("value", r"Date of export[:\s]+([0-9/]+)", 1)).alias("export_date"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)


def nih_labels(spark: SparkSession, path: str) -> DataFrame:
    return nih_label_rows(_csv(spark, path))


def nih_label_rows(raw: DataFrame) -> DataFrame:
    d, n = (lambda c: parse_date(F.col(c)).alias(c)), (lambda c, to: F.col(c).try_cast("double").alias(to))
    return raw.select(
        F.col("core_award_number").alias("gw_award_id"), F.col("status").alias("gw_status"), holds(F.lower("ever_frozen") == "true").alias("ever_frozen"), d("targeted_start_date"), d("targeted_end_date"), d("frozen_date"), d("unfrozen_date"),
        F.col("file_c_outlays").alias("file_c_outlays_raw"), n("total_award", "gw_total_award"), n("total_estimated_outlays", "gw_total_outlays"), n("total_estimated_remaining", "gw_remaining"), "org_name", "org_state", "activity_code", "reinstatement_indicator", d("last_payment_date"), "last_payment_month")


def nsf_labels(spark: SparkSession, path: str) -> DataFrame:
    return nsf_label_rows(_csv(spark, path))


def nsf_label_rows(raw: DataFrame) -> DataFrame:
    n = lambda c, to: F.col(c).try_cast("double").alias(to)
    return raw.select(
        F.col("award_id").alias("gw_award_id"), F.col("status").alias("gw_status"), parse_date(F.col("termination_date")).alias("termination_date"), parse_date(F.col("reinstatement_date")).alias("reinstatement_date"),
        n("usasp_outlaid", "gw_total_outlays"), n("usasp_total_obligated", "gw_total_obligated"), n("estimated_remaining", "gw_remaining"), F.col("usasp_obligation_hist").alias("obligation_hist"), "directorate", "division")


def snapshot(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path, which is first made and written if there is none: a write that failed leaves no files to read."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        write(make(), path)
        return spark.read.parquet(path)


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
