"""Queries of transactions, period outlays, sub-awards and emergency funds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import outlays, subawards, transactions
from ledgerlens.plans.adapters import AS_OF, TXN_AS_OF, ctes, table
from ledgerlens.plans.classification import DISC, discrepancies

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def money(*names: str) -> dict:
    return {n: F.round(n, 2) for n in names}


def disc(*more: str) -> str:
    """The oracle's classified rows, with further tables."""
    own = ctes(*more).removeprefix("WITH ") if more else ""
    return DISC + (", " + own if own else "")


TXN = f"""ts AS (SELECT grant_number, max(transaction_date) AS last_transaction_date, count(*) AS n_transactions, round(coalesce(sum(obligation_amount), 0), 2) AS total_obligated,
    CAST(date_diff('day', max(transaction_date), DATE '{TXN_AS_OF}') AS INT) AS days_since_last_transaction FROM transactions WHERE transaction_date IS NOT NULL GROUP BY grant_number),
    tc AS (SELECT *, CASE WHEN days_since_last_transaction > 180 THEN 'high' WHEN days_since_last_transaction > 90 THEN 'medium' ELSE 'low' END AS freeze_confidence FROM ts)"""


@query("a2_p18_transaction_summary", f"{ctes('transactions')}, {TXN} SELECT * FROM tc")
def a2(spark, d):
    return transactions.summarise(table(spark, d, "transactions"), TXN_AS_OF).withColumns(money("total_obligated"))


@query("j5_enrich_transactions", f"{disc('transactions')}, {TXN} SELECT disc.grant_number, discrepancy_type, last_transaction_date, days_since_last_transaction, freeze_confidence FROM disc LEFT JOIN tc USING (grant_number)")
def j5(spark, d):
    out = transactions.enrich(discrepancies(spark, d), table(spark, d, "transactions"), TXN_AS_OF)
    return out.select("grant_number", "discrepancy_type", "last_transaction_date", "days_since_last_transaction", "freeze_confidence")


@query("a3_deobligations", f"{ctes('transactions')} SELECT grant_number, count(*) AS n_deobligations, round(sum(obligation_amount), 2) AS total_deobligated, min(transaction_date) AS first_deobligation_date, max(transaction_date) AS last_deobligation_date, count(*) >= 2 AS deobligation_flag FROM transactions WHERE obligation_amount < -1000 GROUP BY grant_number")
def a3(spark, d):
    return transactions.deobligations(table(spark, d, "transactions")).withColumns(money("total_deobligated"))


@query("a5_w4_j8_deobligation_months", f"""{disc('transactions')}, ag AS (SELECT DISTINCT grant_number, agency_name FROM disc),
    m AS (SELECT agency_name, strftime(transaction_date, '%Y-%m') AS year_month, count(*) AS n_deobligations, count(DISTINCT grant_number) AS n_grants_affected, round(sum(obligation_amount), 2) AS total_deobligated
          FROM transactions JOIN ag USING (grant_number) WHERE obligation_amount < 0 AND transaction_date IS NOT NULL AND agency_name IS NOT NULL GROUP BY agency_name, year_month),
    w AS (SELECT *, median(n_deobligations) OVER (PARTITION BY agency_name) AS median_monthly FROM m)
    SELECT *, n_deobligations > 2 * median_monthly AND n_grants_affected >= 3 AS spike_flag FROM w""")
def a5(spark, d):
    return transactions.deobligation_months(table(spark, d, "transactions"), discrepancies(spark, d)).withColumns(money("total_deobligated"))


TERM = "SELECT *, row_number() OVER (PARTITION BY grant_number ORDER BY transaction_date DESC, modification_number, action_type) AS rn FROM transactions WHERE action_type IN ('E', 'F') AND transaction_date IS NOT NULL"


@query("w5_terminations", f"{ctes('transactions')} SELECT grant_number, transaction_date AS termination_action_date, action_type AS termination_action_type, modification_number AS termination_mod_number FROM ({TERM}) WHERE rn = 1")
def w5(spark, d):
    return transactions.terminations(table(spark, d, "transactions"))


@query("j13_w6_reinstatements", f"""{ctes('transactions')}, te AS (SELECT grant_number, transaction_date AS termination_action_date FROM ({TERM}) WHERE rn = 1),
    r AS (SELECT t.grant_number, termination_action_date, transaction_date AS reinstatement_action_date, action_type AS reinstatement_action_type, row_number() OVER (PARTITION BY t.grant_number ORDER BY transaction_date, action_type) AS rn
          FROM transactions t JOIN te USING (grant_number) WHERE action_type IN ('A', 'B', 'C', 'G') AND transaction_date > termination_action_date)
    SELECT * EXCLUDE (rn) FROM r WHERE rn = 1""")
def j13(spark, d):
    return transactions.reinstatements(table(spark, d, "transactions"))


@query("j18_s13_by_ids", f"{ctes('transactions', 'labels_')} SELECT modification_number, grant_number FROM transactions WHERE grant_number IN (SELECT gw_award_id FROM labels_)")
def j18(spark, d):
    ids = table(spark, d, "labels_").select(F.col("gw_award_id").alias("grant_number"))
    return transactions.select_ids(table(spark, d, "transactions"), ids).select("modification_number", "grant_number")


FILE_C = "fc AS (SELECT grant_number, reporting_date, CAST(reporting_year AS INT) AS reporting_year, CAST(reporting_month AS INT) AS reporting_month, round(coalesce(sum(outlay_amount), 0), 2) AS outlay_amount, round(coalesce(sum(obligated_amount), 0), 2) AS obligated_amount, count(*) AS n_accounts FROM records GROUP BY ALL)"


def periods(spark, d):
    return outlays.roll_up(table(spark, d, "records")).withColumns(money("outlay_amount", "obligated_amount"))


@query("a4_period_roll_up", f"{ctes('records')}, {FILE_C} SELECT * FROM fc")
def a4(spark, d):
    return periods(spark, d)


FEATURES = """b AS (SELECT *, row_number() OVER (PARTITION BY grant_number ORDER BY reporting_date DESC NULLS FIRST) AS back, coalesce(outlay_amount > 0, false) AS pos FROM fc),
    ft AS (SELECT grant_number, max(reporting_date) FILTER (pos) AS file_c_last_outlay_date, CAST(coalesce(min(back) FILTER (pos) - 1, count(*)) AS INT) AS file_c_months_zero, CAST(count(*) AS INT) AS file_c_total_periods,
        CAST(count(*) FILTER (pos) AS INT) AS file_c_periods_with_outlays, round(sum(outlay_amount), 2) AS file_c_total_outlays FROM b GROUP BY grant_number)"""


@query("a9_w3_period_features", f"{ctes('records')}, {FILE_C}, {FEATURES} SELECT * FROM ft")
def a9(spark, d):
    return outlays.features(periods(spark, d)).withColumns(money("file_c_total_outlays"))


LOOKUP = f"tl AS (SELECT org_name, min(targeted_start_date) AS targeting_start, max(coalesce(targeted_end_date, DATE '{AS_OF}')) AS targeting_end, CAST(count(*) AS INT) AS n_grants FROM labels_ WHERE targeted_start_date IS NOT NULL AND org_name IS NOT NULL GROUP BY org_name)"


@query("a8_targeting_lookup", f"{ctes('labels_')}, {LOOKUP} SELECT * FROM tl")
def a8(spark, d):
    return outlays.targeting_lookup(table(spark, d, "labels_"), AS_OF)


@query("a10_j10_j11_temporal_features", f"""{disc('records', 'labels_')}, {FILE_C}, {FEATURES}, {LOOKUP},
    gr AS (SELECT DISTINCT grant_number, recipient_name, award_amount FROM disc),
    wi AS (SELECT grant_number, award_amount, targeting_start, targeting_end FROM gr JOIN tl ON upper(recipient_name) = upper(tl.org_name)),
    te AS (SELECT grant_number, award_amount, round(coalesce(sum(outlay_amount) FILTER (reporting_date < targeting_start), 0), 2) AS outlays_before_targeting,
        round(coalesce(sum(outlay_amount) FILTER (reporting_date BETWEEN targeting_start AND targeting_end), 0), 2) AS outlays_during_targeting,
        CAST(count(*) FILTER (reporting_date BETWEEN targeting_start AND targeting_end AND outlay_amount = 0) AS INT) AS months_zero_during_freeze FROM fc JOIN wi USING (grant_number) GROUP BY ALL)
    SELECT ft.*, te.* EXCLUDE (grant_number, award_amount), CASE WHEN award_amount > 0 THEN round(outlays_before_targeting / award_amount, 6) + 0.0 END AS pct_outlaid_at_targeting FROM ft LEFT JOIN te USING (grant_number)""")
def a10(spark, d):
    fc, found = periods(spark, d), discrepancies(spark, d)
    out = outlays.temporal_features(outlays.features(fc), fc, outlays.targeting_lookup(table(spark, d, "labels_"), AS_OF), found)
    return out.withColumns(money("file_c_total_outlays", "outlays_before_targeting", "outlays_during_targeting") | {"pct_outlaid_at_targeting": F.round("pct_outlaid_at_targeting", 6) + 0.0})


POST = """td AS (SELECT grant_number, min(notice_date) + 120 AS deadline FROM disc WHERE notice_date IS NOT NULL GROUP BY grant_number),
    pt AS (SELECT grant_number, bool_or(late) AS flag_confirmed_post_termination_outlays, CAST(count(*) FILTER (late) AS INT) AS n_post_termination_periods, round(coalesce(sum(outlay_amount) FILTER (late), 0), 2) AS post_termination_total_outlays,
        min(reporting_date) FILTER (late) AS post_termination_first_date, max(reporting_date) FILTER (late) AS post_termination_last_date
        FROM (SELECT fc.*, coalesce(reporting_date > deadline AND outlay_amount >= 100, false) AS late FROM fc JOIN td USING (grant_number)) GROUP BY grant_number)"""


@query("a11_j12_post_termination", f"{disc('records')}, {FILE_C}, {POST} SELECT * FROM pt")
def a11(spark, d):
    return outlays.post_termination(periods(spark, d), discrepancies(spark, d)).withColumns(money("post_termination_total_outlays"))


@query("p19_j6_j7_freeze_evidence", f"""{disc('records', 'transactions')}, {FILE_C}, {FEATURES}, {POST}, {TXN}
    SELECT disc.grant_number, discrepancy_type, CASE WHEN file_c_total_periods IS NULL AND discrepancy_type IN ('possible_freeze', 'possible_freeze_no_data') THEN 'possible_freeze' WHEN file_c_total_periods IS NULL THEN NULL
        WHEN file_c_months_zero >= 3 AND days_since_last_transaction > 180 THEN 'confirmed_freeze' WHEN file_c_months_zero >= 1 AND days_since_last_transaction > 90 THEN 'likely_freeze'
        WHEN file_c_months_zero = 0 AND file_c_periods_with_outlays = file_c_total_periods THEN 'confirmed_not_frozen' WHEN file_c_months_zero = 0 THEN 'likely_not_frozen' ELSE 'possible_freeze' END AS freeze_evidence,
        flag_confirmed_post_termination_outlays FROM disc LEFT JOIN tc USING (grant_number) LEFT JOIN ft USING (grant_number) LEFT JOIN pt USING (grant_number)""")
def p19(spark, d):
    fc = periods(spark, d)
    rows = transactions.enrich(discrepancies(spark, d), table(spark, d, "transactions"), TXN_AS_OF)
    return outlays.enrich(rows, outlays.features(fc), fc).select("grant_number", "discrepancy_type", "freeze_evidence", "flag_confirmed_post_termination_outlays")


FLOW = "sf AS (SELECT s.*, disc.discrepancy_type FROM subawards s JOIN disc ON s.prime_award_id = disc.grant_number)"


def names(c: str, sep: str, alias: str, keys: str, where: str) -> str:
    """The distinct values of a column in the order in which they are first seen, by date and id."""
    first = "min(coalesce(CAST(subaward_date AS VARCHAR), '9999-12-31') || ' ' || subaward_id)"
    return f"(SELECT {keys}, string_agg(v, '{sep}' ORDER BY f) AS {alias} FROM (SELECT {keys}, coalesce({c}, 'NA') AS v, {first} AS f FROM sf WHERE {where} GROUP BY {keys}, v) GROUP BY {keys})"


def by_prime(types: str) -> str:
    where = f"discrepancy_type IN ({types})"
    return f"""{disc('subawards')}, {FLOW}, sums AS (SELECT prime_award_id, prime_recipient, count(*) AS n_subawards, round(sum(subaward_amount), 2) AS total_subaward_amount, max(subaward_date) AS latest_subaward_date FROM sf WHERE {where} GROUP BY prime_award_id, prime_recipient)
        SELECT sums.*, l.subawardees FROM sums JOIN {names('subawardee_name', '; ', 'subawardees', 'prime_award_id, prime_recipient', where)} l ON sums.prime_award_id = l.prime_award_id AND sums.prime_recipient IS NOT DISTINCT FROM l.prime_recipient"""


def flow(spark, d):
    return subawards.flow(table(spark, d, "subawards"), discrepancies(spark, d))


@query("a6_j9_frozen_subawards", by_prime("'possible_freeze', 'possible_freeze_no_data'"))
def a6(spark, d):
    return subawards.frozen(flow(spark, d)).withColumns(money("total_subaward_amount"))


@query("a6_terminated_subawards", by_prime("'active_despite_terminated'"))
def a6b(spark, d):
    return subawards.terminated(flow(spark, d)).withColumns(money("total_subaward_amount"))


BAD = "discrepancy_type <> 'normal'"


@query("a7_downstream", f"""{disc('subawards')}, {FLOW}, sums AS (SELECT subawardee_name, count(DISTINCT prime_award_id) AS n_prime_awards, round(sum(subaward_amount), 2) AS total_subaward_amount FROM sf WHERE {BAD} GROUP BY subawardee_name)
    SELECT sums.*, t.discrepancy_types, i.prime_institutions FROM sums JOIN {names('discrepancy_type', ', ', 'discrepancy_types', 'subawardee_name', BAD)} t USING (subawardee_name) JOIN {names('prime_recipient', '; ', 'prime_institutions', 'subawardee_name', BAD)} i USING (subawardee_name)""")
def a7(spark, d):
    return subawards.downstream(flow(spark, d)).withColumns(money("total_subaward_amount"))


@query("s15_subaward_impact", f"{ctes('subawards', 'notices')} SELECT prime_award_id AS award_id, CAST(count(*) AS INT) AS subaward_count, round(sum(subaward_amount), 2) AS subaward_obligation FROM subawards WHERE prime_award_id IN (SELECT grant_number FROM notices WHERE grant_number IS NOT NULL) GROUP BY prime_award_id")
def s15(spark, d):
    return subawards.impact(table(spark, d, "subawards"), table(spark, d, "notices").select("grant_number")).withColumns(money("subaward_obligation"))


@query("j14_f16_emergency_flags", f"{DISC} SELECT grant_number, def_codes, coalesce(list_has_any(list_transform(string_split_regex(def_codes, '[,;]+'), lambda c: trim(c)), ['Z','L','M','3','4','5','6','7','N']), false) AND discrepancy_type IN ('possible_freeze', 'possible_freeze_no_data', 'active_despite_terminated') AS flag_emergency_exempt FROM disc")
def j14(spark, d):
    return subawards.emergency_flags(discrepancies(spark, d), table(spark, d, "awards")).select("grant_number", "def_codes", "flag_emergency_exempt")
