"""Queries of the payload parsers: records of the test tables are laid down as payloads, read back, and held against the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans.adapters import ctes, table
from ledgerlens.sources import tables

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def pages(records: DataFrame, r, *keep: str, per_page: int = 500) -> DataFrame:
    """(payload, *keep): JSON pages of some per_page records each, with a page that isn't JSON and an empty one."""
    page = F.pmod(F.xxhash64(*records.columns), F.lit(max(1, records.count() // per_page))).alias("_page")
    made = records.select(*keep, page, r.alias("r")).groupBy(*keep, "_page").agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("payload")).drop("_page")
    odd = made.sparkSession.createDataFrame([("no json",), ('{"results": []}',)], "payload string")
    return made.unionByName(odd, allowMissingColumns=True)


def named(**columns: str):
    """A struct of the payload's field names (blanks as underscores) from the records' columns."""
    return F.struct(*[F.col(c).alias(n.replace("_", " ")) for n, c in columns.items()])


@query("s4_p6_nih_notices", f"""{ctes('nih_records')}, r AS (SELECT 'NIH' AS agency_name, coalesce(nullif(ic, ''), ic_name) AS ins, CAST(substr(project_end_date, 1, 10) AS DATE) AS notice_date, CAST(date_added AS DATE) AS date_added,
        'https://reporter.nih.gov/project-details/' || appl_id AS source_url, project_title AS raw_text_snippet, project_num AS grant_number, org_name, org_state, award_amount, is_active FROM nih_records),
    k AS (SELECT *, row_number() OVER (PARTITION BY grant_number ORDER BY notice_date DESC NULLS LAST, source_url) AS rn FROM r)
    SELECT * EXCLUDE (ins, rn), CASE WHEN ins IS NULL AND starts_with(grant_number, 'VA') THEN 'VA' ELSE ins END AS institute FROM k WHERE rn = 1 AND NOT coalesce(is_active, false)""")
def s4(spark, d):
    ic = F.when(F.col("ic").isNotNull(), F.array(F.struct(F.col("ic").alias("abbreviation")))).otherwise(F.array().cast("array<struct<abbreviation:string>>"))
    r = F.struct("appl_id", "project_title", "project_num", "project_end_date", "date_added", "award_amount", "is_active", F.struct("org_name", "org_state").alias("organization"), ic.alias("agency_ic_fundings"), "ic_name")
    return tables.nih_notices(pages(table(spark, d, "nih_records"), r))


AWARD_COLUMNS = "grant_number, recipient_name, agency_name, sub_agency, award_amount, total_outlays, action_date, end_date, cfda_number"


@query("s8_f15_award_payloads", f"{ctes('awards')} SELECT {AWARD_COLUMNS}, squish AS description, codes AS def_codes FROM (SELECT *, org_name || ' (x)' AS squish, replace(def_codes, '; ', ',') AS codes FROM awards)")
def s8(spark, d):
    rows = table(spark, d, "awards").withColumns({
        "start": F.col("action_date").cast("string"), "stop": F.concat(F.col("end_date").cast("string"), F.lit("T00:00:00")),
        "text": F.concat(F.lit("DESCRIPTION: <![CDATA[<b>"), "org_name", F.lit("</b> (x)]]>")), "codes": F.split("def_codes", "[,;] ?"),
    })
    r = named(Award_ID="grant_number", Recipient_Name="recipient_name", Awarding_Agency="agency_name", Awarding_Sub_Agency="sub_agency", Award_Amount="award_amount", Total_Outlays="total_outlays", Start_Date="start", End_Date="stop", CFDA_Number="cfda_number", Description="text")
    r = r.withField("def_codes", F.col("codes"))
    return tables.awards(pages(rows, r)).select(*AWARD_COLUMNS.split(", "), "description", "def_codes")


@query("s12_transaction_payloads", f"{ctes('transactions')} SELECT grant_number, transaction_date, obligation_amount, 'Mod ' || modification_number AS transaction_desc, action_type, modification_number FROM transactions")
def s12(spark, d):
    rows = table(spark, d, "transactions").withColumns({"date": F.col("transaction_date").cast("string"), "text": F.concat(F.lit("Mod "), "modification_number")})
    return tables.transactions(pages(rows, named(Award_ID="grant_number", Action_Date="date", Transaction_Amount="obligation_amount", Transaction_Description="text", Action_Type="action_type", Mod="modification_number")))


@query("s14_subaward_payloads", f"{ctes('subawards')} SELECT subaward_id, subawardee_name, subaward_date, subaward_amount, prime_award_id, prime_recipient, CAST(NULL AS VARCHAR) AS agency_name, CAST(NULL AS VARCHAR) AS sub_agency FROM subawards")
def s14(spark, d):
    rows = table(spark, d, "subawards").withColumn("date", F.col("subaward_date").cast("string"))
    return tables.subawards(pages(rows, named(**{"Sub-Award_ID": "subaward_id", "Sub-Awardee_Name": "subawardee_name", "Sub-Award_Date": "date", "Sub-Award_Amount": "subaward_amount", "Prime_Award_ID": "prime_award_id", "Prime_Recipient_Name": "prime_recipient"})))


FILE_C = """SELECT grant_number, CASE WHEN m <= 3 THEN make_date(y - 1, m + 9, 1) ELSE make_date(y, m - 3, 1) END AS reporting_date, y AS reporting_year, m AS reporting_month, outlay_amount, obligated_amount
    FROM (SELECT *, CAST(reporting_year AS INT) AS y, CAST(reporting_month AS INT) AS m FROM records)"""


@query("s16_s18_file_c_payloads", f"{ctes('records')} {FILE_C}")
def s18(spark, d):
    rows = table(spark, d, "records").withColumns({c: F.col(c).cast("int") for c in ("reporting_year", "reporting_month")})
    r = F.struct(F.col("reporting_year").alias("reporting_fiscal_year"), F.col("reporting_month").alias("reporting_fiscal_month"), F.col("outlay_amount").alias("gross_outlay_amount"), F.col("obligated_amount").alias("transaction_obligated_amount"))
    one = rows.select("grant_number", r.alias("r")).groupBy("grant_number").agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("payload"))
    return tables.file_c_if_available(one).drop("federal_account", "account_title")


@query("s23_flow_payloads", """WITH m AS (SELECT o_orderpriority AS agency, year(o_orderdate) AS y, month(o_orderdate) AS p, round(sum(o_totalprice), 2) AS a FROM orders GROUP BY ALL)
    SELECT agency, CAST(y AS INT) AS fiscal_year, CAST(p AS INT) AS fiscal_period, CASE WHEN p <> 2 THEN a END AS monthly_grant_obligations FROM m""")
def s23(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("agency"), F.year("o_orderdate").cast("string").alias("fiscal_year"), F.month("o_orderdate").cast("string").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("a"))
    amount = F.when(F.col("month") == "2", "null").otherwise(F.col("a").cast("string")).alias("Grant_Obligations")
    return tables.spending_over_time(pages(m, F.struct(F.struct("fiscal_year", "month").alias("time_period"), amount), "agency"))


@query("s21_budget_payloads", """WITH m AS (SELECT o_orderpriority AS agency, CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(month(o_orderdate) AS INT) AS fiscal_period, count(*) AS n FROM orders GROUP BY ALL),
    y AS (SELECT agency, fiscal_year, sum(n) AS total FROM m GROUP BY ALL)
    SELECT agency, fiscal_year, fiscal_period, CAST(n AS DOUBLE) AS obligations_cumulative, CAST(total * 2 AS DOUBLE) AS budgetary_resources, CAST(total AS DOUBLE) AS total_obligated_yr, CAST(NULL AS DOUBLE) AS total_outlayed_yr, n / (total * 2) AS obligation_rate
    FROM m JOIN y USING (agency, fiscal_year) WHERE fiscal_year >= 1995""")
def s21(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("agency"), F.year("o_orderdate").alias("fiscal_year"), F.month("o_orderdate").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    years = m.groupBy("agency", "fiscal_year").agg(F.sum("n").alias("total"), F.collect_list(F.struct("period", F.col("n").cast("string").alias("obligated"))).alias("agency_obligation_by_period"))
    y = F.struct("fiscal_year", F.col("total").cast("string").alias("agency_total_obligated"), (F.col("total") * 2).cast("string").alias("agency_budgetary_resources"), "agency_obligation_by_period")
    payload = years.groupBy("agency").agg(F.to_json(F.struct(F.collect_list(y).alias("agency_data_by_year"))).alias("payload"))
    return tables.agency_obligations(payload, list(range(1995, 2100)))


@query("s15_impact_payloads", "SELECT CAST(l_orderkey AS STRING) AS award_id, CAST(count(*) AS INT) AS subaward_count, round(sum(l_extendedprice), 2) AS subaward_obligation, 'ASST_' || CAST(l_orderkey AS STRING) AS award_generated_internal_id FROM lineitem GROUP BY l_orderkey")
def s15(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("award_id")).agg(F.count(F.lit(1)).alias("subaward_count"), F.round(F.sum("l_extendedprice"), 2).alias("subaward_obligation"))
    rows = rows.withColumn("award_generated_internal_id", F.concat(F.lit("ASST_"), "award_id"))
    return tables.subaward_impact(pages(rows, F.struct("*")))


@query("s5_nsf_rows", "SELECT 'NSF' AS agency_name, o_orderpriority AS directorate, CAST(NULL AS DATE) AS notice_date, 'https://www.nsf.gov/awardsearch/showAward?AWD_ID=' || CAST(o_orderkey AS STRING) AS source_url, 'A title' AS raw_text_snippet, CAST(o_orderkey AS STRING) AS grant_number, CASE WHEN o_orderkey % 3 <> 0 THEN 'Org ' || CAST(o_custkey AS STRING) END AS org_name, round(o_totalprice, 2) AS award_amount FROM orders")
def s5(spark, d):
    key = F.col("o_orderkey").cast("string")
    raw = table(spark, d, "orders").select(
        F.concat(F.lit("  "), key, F.lit(" ")).alias("award_id"), F.col("o_orderpriority").alias("directorate"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Org   "), F.col("o_custkey").cast("string"))).alias("recipient"),
        F.lit(" A \t title").alias("title"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2), F.lit(" ")).alias("obligated"), F.lit("").alias("_phantom"), F.lit(None).cast("string").alias("_meta"))
    empty = spark.createDataFrame([(None,) * 7], tables.NSF_COLUMNS)
    return tables.nsf_rows(raw.unionByName(empty))


@query("s6_header_date", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS export_date FROM orders")
def s6(spark, d):
    lines = table(spark, d, "orders").select(F.concat(F.lit("Award ID,Obligated,Date of export: "), F.date_format("o_orderdate", "MM/dd/yyyy")).alias("value")).distinct()
    return tables.header_date(lines)


LABELS = """SELECT CAST(o_orderkey AS STRING) AS gw_award_id, o_orderpriority AS gw_status, o_orderkey % 4 = 0 AS ever_frozen, CAST(o_orderdate AS DATE) AS targeted_start_date, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS targeted_end_date,
    o_totalprice AS gw_total_award, CAST(NULL AS DOUBLE) AS gw_total_outlays, 'Org' AS org_name, CAST(o_orderdate AS DATE) + 7 AS last_payment_date FROM orders"""


@query("s27_nih_label_rows", LABELS)
def s27(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    us = lambda c: F.date_format(c, "MM/dd/yyyy")
    told = {
        "core_award_number": F.col("o_orderkey").cast("string"), "status": F.col("o_orderpriority"), "ever_frozen": F.when(F.col("o_orderkey") % 4 == 0, "TRUE").when(F.col("o_orderkey") % 4 == 1, "False"),
        "targeted_start_date": F.col("day").cast("string"), "targeted_end_date": F.when(F.col("o_orderkey") % 3 != 0, us(F.date_add("day", 30))), "total_award": F.col("o_totalprice").cast("string"),
        "total_estimated_outlays": F.lit("x"), "org_name": F.lit("Org"), "last_payment_date": us(F.date_add("day", 7)),
    }
    rest = ("frozen_date", "unfrozen_date", "file_c_outlays", "total_estimated_remaining", "org_state", "activity_code", "reinstatement_indicator", "last_payment_month")
    raw = o.select(*[c.alias(n) for n, c in told.items()], *[F.lit(None).cast("string").alias(n) for n in rest])
    return tables.nih_label_rows(raw).select("gw_award_id", "gw_status", "ever_frozen", "targeted_start_date", "targeted_end_date", "gw_total_award", "gw_total_outlays", "org_name", "last_payment_date")


@query("s19_nsf_label_rows", "SELECT CAST(o_orderkey AS STRING) AS gw_award_id, o_orderstatus AS gw_status, CAST(o_orderdate AS DATE) AS termination_date, CAST(NULL AS DATE) AS reinstatement_date, o_totalprice AS gw_total_outlays, CAST(NULL AS DOUBLE) AS gw_total_obligated, 1.5 AS gw_remaining, 'h' AS obligation_hist, 'BIO' AS directorate, 'DEB' AS division FROM orders")
def s19(spark, d):
    raw = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("award_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").cast("string").alias("termination_date"), F.lit("none").alias("reinstatement_date"), F.col("o_totalprice").cast("string").alias("usasp_outlaid"),
        F.lit("").alias("usasp_total_obligated"), F.lit("1.5").alias("estimated_remaining"), F.lit("h").alias("usasp_obligation_hist"), F.lit("BIO").alias("directorate"), F.lit("DEB").alias("division"))
    return tables.nsf_label_rows(raw)
