"""Queries of spending by category, month and recipient."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import spending
from ledgerlens.plans.adapters import AS_OF, ctes, table
from ledgerlens.sources import tables

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


@query("s9_top_per_agency", f"{ctes('awards')} SELECT grant_number, agency_name, award_amount FROM (SELECT *, row_number() OVER (PARTITION BY agency_name ORDER BY award_amount DESC NULLS LAST, grant_number) AS r FROM awards) WHERE r <= 50")
def s9(spark, d):
    return spending.top_by_group(table(spark, d, "awards"), "agency_name", "award_amount", 50, "grant_number").select("grant_number", "agency_name", "award_amount")


@query("s14_top_subawards", f"{ctes('subawards')} SELECT subaward_id, subawardee_name FROM (SELECT *, row_number() OVER (PARTITION BY subawardee_name ORDER BY subaward_amount DESC NULLS LAST, subaward_id) AS r FROM subawards) WHERE r <= 20")
def s14(spark, d):
    rows = table(spark, d, "subawards")
    return spending.top_by_group(rows, "subawardee_name", "subaward_amount", 20, "subaward_id").select("subaward_id", "subawardee_name")


@query("s10_institution_search", f"{ctes('awards')} SELECT grant_number, recipient_name FROM awards WHERE contains(upper(recipient_name), 'CUSTOMER#00000000') ORDER BY award_amount DESC NULLS LAST, grant_number LIMIT 25")
def s10(spark, d):
    return spending.search_institution(table(spark, d, "awards"), "customer#00000000", 25).select("grant_number", "recipient_name")


@query("s24_category_spending", f"{ctes('awards')} SELECT cfda_number, round(sum(award_amount), 2) AS obligation_amount, '1996-10-01' AS start_date, '1998-03-31' AS end_date FROM awards WHERE action_date BETWEEN DATE '1996-10-01' AND DATE '1998-03-31' GROUP BY cfda_number")
def s24(spark, d):
    return spending.by_category(table(spark, d, "awards"), "cfda_number", "1996-10-01", "1998-03-31").withColumn("obligation_amount", F.round("obligation_amount", 2))


@query("s25_state_spending", f"{ctes('notices')} SELECT org_state, round(sum(award_amount), 2) AS obligation_amount, '1996-10-01' AS start_date, '1998-03-31' AS end_date FROM notices WHERE notice_date BETWEEN DATE '1996-10-01' AND DATE '1998-03-31' GROUP BY org_state")
def s25(spark, d):
    return spending.by_category(table(spark, d, "notices"), "org_state", "1996-10-01", "1998-03-31", "notice_date").withColumn("obligation_amount", F.round("obligation_amount", 2))


@query("s23_d4_monthly_flow", f"{ctes('awards')} SELECT agency_name AS agency, CAST(year(action_date + INTERVAL 3 MONTH) AS INT) AS fiscal_year, CAST(month(action_date + INTERVAL 3 MONTH) AS INT) AS fiscal_period, round(sum(award_amount), 2) AS monthly_grant_obligations FROM awards WHERE action_date <= DATE '{AS_OF}' AND year(action_date + INTERVAL 3 MONTH) IN (1998, 1999, 2000) GROUP BY ALL")
def s23(spark, d):
    return spending.monthly_flow(table(spark, d, "awards"), [1998, 1999, 2000], AS_OF).withColumn("monthly_grant_obligations", F.round("monthly_grant_obligations", 2))


def top(start: str, end: str, n: int) -> str:
    return f"SELECT recipient_id, recipient_name, sum(award_amount) / 1e6 AS amount_M FROM awards WHERE action_date BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY ALL ORDER BY sum(award_amount) DESC, recipient_name LIMIT {n}"


WINDOWS = (("1996-01-01", "1996-12-31"), ("1997-01-01", "1997-12-31"))


@query("s26_top_recipients", f"{ctes('awards')} SELECT recipient_id, recipient_name, round(amount_M, 6) AS \"amount_M\" FROM ({top(*WINDOWS[0], 100)})")
def s26(spark, d):
    return spending.top_recipients(table(spark, d, "awards"), *WINDOWS[0], 100).withColumn("amount_M", F.round("amount_M", 6))


@query("j16_a22_compression", f"""{ctes('awards')}, b AS ({top(*WINDOWS[0], 200)}), c0 AS ({top(*WINDOWS[1], 300)}),
    c AS (SELECT CASE WHEN CAST(recipient_id AS BIGINT) % 3 <> 0 THEN recipient_id END AS recipient_id, CASE WHEN CAST(recipient_id AS BIGINT) % 2 = 0 THEN lower(recipient_name) || ', ' ELSE recipient_name END AS recipient_name, amount_M FROM c0),
    i AS (SELECT b.*, c.amount_M AS current_M, 'recipient_id' AS join_method FROM b JOIN c USING (recipient_id)),
    r AS (SELECT * FROM b WHERE recipient_id NOT IN (SELECT recipient_id FROM i)), q AS (SELECT *, upper(trim(regexp_replace(regexp_replace(recipient_name, '\\s+', ' ', 'g'), '[,.''\\-]', ' ', 'g'))) AS k FROM c WHERE recipient_id IS NULL OR recipient_id NOT IN (SELECT recipient_id FROM i)),
    n AS (SELECT r.*, q.amount_M AS current_M, 'name' AS join_method FROM r JOIN q ON upper(r.recipient_name) = q.k),
    z AS (SELECT r.*, CAST(NULL AS DOUBLE) AS current_M, 'none' AS join_method FROM r WHERE upper(recipient_name) NOT IN (SELECT k FROM q)),
    u AS (SELECT * FROM i UNION ALL SELECT * FROM n UNION ALL SELECT * FROM z)
    SELECT recipient_name, recipient_id, round(amount_M, 6) AS "baseline_M", round(current_M, 6) AS "current_M", round((current_M - amount_M) / amount_M * 100, 1) + 0.0 AS yoy_pct, round(amount_M - current_M, 2) + 0.0 AS "drop_M",
        current_M IS NULL AS below_cutoff, round((SELECT min(amount_M) FROM c), 6) AS "cutoff_floor_M", join_method FROM u""")
def j16(spark, d):
    awards = table(spark, d, "awards")
    now = spending.top_recipients(awards, *WINDOWS[1], 300)
    k = F.col("recipient_id").cast("long")
    now = now.select(F.when(k % 3 != 0, F.col("recipient_id")).alias("recipient_id"), F.when(k % 2 == 0, F.concat(F.lower("recipient_name"), F.lit(", "))).otherwise(F.col("recipient_name")).alias("recipient_name"), "amount_M")
    out = spending.compression(spending.top_recipients(awards, *WINDOWS[0], 200), now)
    return out.withColumns({c: F.round(c, 6) for c in ("baseline_M", "current_M", "cutoff_floor_M")} | {c: F.col(c) + 0.0 for c in ("yoy_pct", "drop_M")})


@query("s21_s22_agency_obligations", """
    SELECT n_name AS agency, CAST(2023 + i AS INT) AS fiscal_year, CAST(p AS INT) AS fiscal_period, CAST(n_nationkey * 100 + p AS DOUBLE) AS obligations_cumulative, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey % 3 * 1000 AS DOUBLE) ELSE 0.0 END AS budgetary_resources,
        CAST(n_nationkey AS DOUBLE) AS total_obligated_yr, CAST(NULL AS DOUBLE) AS total_outlayed_yr, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey * 100 + p AS DOUBLE) / CAST(n_nationkey % 3 * 1000 AS DOUBLE) END AS obligation_rate
    FROM nation, range(0, 3) y(i), range(1, 4) q(p) WHERE 2023 + i IN (2023, 2024)""")
def s22(spark, d):
    n = F.col("n_nationkey")
    period = lambda p: F.struct(p.alias("period"), (n * 100 + p).cast("string").alias("obligated"))
    year = lambda y: F.struct((y + 2023).cast("int").alias("fiscal_year"), n.cast("string").alias("agency_total_obligated"), F.lit("null").alias("agency_total_outlayed"), (n % 3 * 1000).cast("string").alias("agency_budgetary_resources"), F.transform(F.sequence(F.lit(1), F.lit(3)), period).alias("agency_obligation_by_period"))
    pages = table(spark, d, "nation").select(F.col("n_name").alias("agency"), F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(2)), year).alias("agency_data_by_year"))).alias("payload"))
    return tables.agency_obligations(pages, [2023, 2024])
