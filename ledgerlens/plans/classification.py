"""Queries of the joins between notices and awards, and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import charts, matching, validate
from ledgerlens.plans.adapters import AS_OF, ctes, table
from ledgerlens.plans.scalars import DUCK_TOKENS, duck_org

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: The oracle's names of normalised tables and of classified rows.
NORMAL = f"""a AS (SELECT * REPLACE ({duck_org('org_name')} AS org_name) FROM awards),
    n AS (SELECT * REPLACE ({duck_org('org_name')} AS org_name), row_number() OVER () AS nid FROM notices)"""
EXACT = """x AS (SELECT a.*, n.notice_date, n.award_amount AS award_amount_notice, n.institute, n.org_state, 'exact' AS match_method FROM a JOIN n USING (grant_number))"""
FUZZY = f"""na AS (SELECT DISTINCT org_name AS l FROM n), nb AS (SELECT DISTINCT org_name AS r FROM a),
    s AS (SELECT l, r, round(1 - jaro_similarity(l, r), 9) AS dist FROM na, nb WHERE list_has_any({DUCK_TOKENS.format('l')}, {DUCK_TOKENS.format('r')}) AND round(1 - jaro_similarity(l, r), 9) <= 0.08),
    un AS (SELECT * FROM n WHERE grant_number IS NULL OR grant_number NOT IN (SELECT grant_number FROM a WHERE grant_number IS NOT NULL)),
    ua AS (SELECT * FROM a WHERE grant_number IS NULL OR grant_number NOT IN (SELECT grant_number FROM n WHERE grant_number IS NOT NULL)),
    fm AS (SELECT ua.*, un.notice_date, un.award_amount AS award_amount_notice, un.institute, un.org_state, 'fuzzy' AS match_method,
             row_number() OVER (PARTITION BY un.nid ORDER BY s.dist, ua.grant_number, ua.award_amount) AS rn
           FROM un JOIN s ON un.org_name = s.l JOIN ua ON ua.org_name = s.r WHERE abs(date_diff('day', un.notice_date, ua.action_date)) <= 90),
    f AS (SELECT * EXCLUDE (rn) FROM fm WHERE rn <= 5)"""
ALONE = """o AS (SELECT a.*, CAST(NULL AS DATE) AS notice_date, CAST(NULL AS DOUBLE) AS award_amount_notice, CAST(NULL AS VARCHAR) AS institute, CAST(NULL AS VARCHAR) AS org_state, 'unmatched_award' AS match_method FROM a
    WHERE grant_number NOT IN (SELECT grant_number FROM x) {more})"""
FLAGS = f"""g AS (SELECT *, CASE WHEN award_amount > 0 THEN total_outlays / award_amount END AS outlay_ratio,
        CASE WHEN end_date > action_date THEN greatest(0, least(1, date_diff('day', action_date, DATE '{AS_OF}') / date_diff('day', action_date, end_date))) END AS elapsed_ratio,
        coalesce(end_date > DATE '{AS_OF}', false) AS is_open FROM u),
    h AS (SELECT *, notice_date IS NOT NULL AND coalesce(total_outlays > 0, false) AND is_open AS flag_active_despite_terminated,
        is_open AND (total_outlays IS NULL OR total_outlays = 0 OR coalesce(outlay_ratio < 0.10, false)) AS flag_no_recent_activity, match_method = 'unmatched_award' AS flag_not_in_gw,
        coalesce(match_method = 'exact' AND award_amount > 0 AND abs(award_amount_notice / nullif(award_amount, 0) - 1) > 0.25, false) AS flag_amount_mismatch, coalesce(award_amount > 1e9, false) AS flag_umbrella_award FROM g),
    disc AS (SELECT *, flag_no_recent_activity AND total_outlays IS NULL AS flag_missing_outlay_data,
        CASE WHEN flag_active_despite_terminated THEN 'active_despite_terminated' WHEN coalesce(sub_agency = 'Administration for Children and Families', false) THEN 'normal'
             WHEN flag_no_recent_activity AND total_outlays IS NOT NULL THEN 'possible_freeze' WHEN flag_no_recent_activity THEN 'possible_freeze_no_data'
             WHEN flag_not_in_gw THEN 'untracked' ELSE 'normal' END AS discrepancy_type FROM h)"""
#: Without and with the match by name.
DISC = f"{ctes('awards', 'notices')}, {NORMAL}, {EXACT}, {ALONE.format(more='')}, u AS (SELECT * FROM x UNION ALL BY NAME SELECT * FROM o), {FLAGS}"
DISC_FUZZY = f"{ctes('awards', 'notices')}, {NORMAL}, {EXACT}, {FUZZY}, {ALONE.format(more='AND grant_number NOT IN (SELECT grant_number FROM f)')}, u AS (SELECT * FROM x UNION ALL BY NAME SELECT * FROM f UNION ALL BY NAME SELECT * FROM o), {FLAGS}"
COLUMNS = ["grant_number", "agency_name", "match_method", "notice_date", "award_amount", "award_amount_notice", "outlay_ratio", "elapsed_ratio", "flag_amount_mismatch", "flag_umbrella_award", "flag_active_despite_terminated", "flag_no_recent_activity", "flag_missing_outlay_data", "flag_not_in_gw", "discrepancy_type"]


def discrepancies(spark, d, fuzzy: bool = False):
    return matching.join_and_flag(table(spark, d, "notices"), table(spark, d, "awards"), AS_OF, fuzzy)


@query("j1_j4_exact_and_flags", f"{DISC} SELECT {', '.join(COLUMNS)} FROM disc")
def j1(spark, d):
    return discrepancies(spark, d).select(COLUMNS)


@query("j3_w2_fuzzy_and_flags", f"{DISC_FUZZY} SELECT {', '.join(COLUMNS)} FROM disc")
def j3(spark, d):
    return discrepancies(spark, d, True).select(COLUMNS)


#: Awards by row, not by number: copies, and rows that differ in where a null stands, are awards each.
REPEATED = f"""{ctes('repeated_awards', 'notices')}, a AS (SELECT * REPLACE ({duck_org('org_name')} AS org_name), row_number() OVER () AS aid FROM repeated_awards), {NORMAL[NORMAL.index('n AS'):]},
    x AS (SELECT a.*, n.notice_date, n.award_amount AS award_amount_notice, 'exact' AS match_method FROM a JOIN n USING (grant_number)), {FUZZY.replace('ua.award_amount) AS rn', 'ua.award_amount, ua.action_date, ua.aid) AS rn').replace('BY s.dist, ua.grant_number,', 'BY s.dist, ua.grant_number NULLS FIRST,')},
    o AS (SELECT a.*, CAST(NULL AS DATE) AS notice_date, CAST(NULL AS DOUBLE) AS award_amount_notice, 'unmatched_award' AS match_method FROM a WHERE aid NOT IN (SELECT aid FROM x) AND aid NOT IN (SELECT aid FROM f)),
    u AS (SELECT * FROM x UNION ALL BY NAME SELECT * FROM f UNION ALL BY NAME SELECT * FROM o), {FLAGS}"""
REPEATED_COLUMNS = ["grant_number", "recipient_name", "org_name", "match_method", "notice_date", "award_amount", "discrepancy_type"]


@query("j1_j3_p3_repeated_awards", f"{REPEATED} SELECT {', '.join(REPEATED_COLUMNS)} FROM disc")
def j1r(spark, d):
    return matching.join_and_flag(table(spark, d, "notices"), table(spark, d, "repeated_awards"), AS_OF).select(REPEATED_COLUMNS)


SUMMARY = "SELECT agency_name, discrepancy_type, count(*) AS n, round(coalesce(sum(award_amount), 0), 2) AS total_award_amount, round(coalesce(sum(total_outlays), 0), 2) AS total_outlays FROM disc WHERE discrepancy_type <> 'normal' GROUP BY agency_name, discrepancy_type"


@query("j1_a1_discrepancy_summary", f"{DISC_FUZZY} {SUMMARY}")
def a1(spark, d):
    out = matching.summarise_discrepancies(discrepancies(spark, d, True))
    return out.select("agency_name", "discrepancy_type", "n", F.round("total_award_amount", 2).alias("total_award_amount"), F.round("total_outlays", 2).alias("total_outlays"))


@query("f8_similar_names", f"{ctes('awards', 'notices')}, {NORMAL}, {FUZZY.split('un AS')[0].rstrip().rstrip(',')} SELECT l AS left_name, r AS right_name, dist AS org_name_dist FROM s")
def f8(spark, d):
    return matching.similar_names(matching.normalise_notices(table(spark, d, "notices")), matching.normalise_awards(table(spark, d, "awards")))


@query("p26_reporting_filter", f"{DISC} SELECT grant_number, match_method FROM disc WHERE award_amount < 1e9 AND outlay_ratio BETWEEN 0 AND 1.5 AND action_date >= DATE '1996-01-01'")
def p26(spark, d):
    return validate.reporting_filter(discrepancies(spark, d), "1996-01-01").select("grant_number", "match_method")


@query("t1_sorted_discrepancies", f"{DISC} SELECT grant_number, discrepancy_type, award_amount FROM disc ORDER BY discrepancy_type, award_amount DESC NULLS LAST, notice_date NULLS LAST, grant_number LIMIT 100")
def t1(spark, d):
    rows = matching.sort_discrepancies(discrepancies(spark, d))
    return rows.orderBy(F.asc_nulls_last("discrepancy_type"), F.desc_nulls_last("award_amount"), F.asc_nulls_last("notice_date"), "grant_number").limit(100).select("grant_number", "discrepancy_type", "award_amount")


@query("v1_institute_bars", f"{ctes('notices')}, s AS (SELECT institute, count(*) AS n_grants, round(sum(award_amount), 2) AS total_amount FROM notices WHERE agency_name = 'NIH' AND institute IS NOT NULL GROUP BY institute) SELECT * EXCLUDE (r) FROM (SELECT *, rank() OVER (ORDER BY n_grants DESC) AS r FROM s) WHERE r <= 15")
def v1(spark, d):
    return charts.institute_bars(table(spark, d, "notices")).withColumn("total_amount", F.round("total_amount", 2))


LABEL = "CASE discrepancy_type WHEN 'active_despite_terminated' THEN 'Active Despite Terminated' WHEN 'possible_freeze' THEN 'Possible Freeze' WHEN 'possible_freeze_no_data' THEN 'Possible Freeze (No Data)' WHEN 'untracked' THEN 'Untracked' ELSE {} END AS discrepancy_label"


@query("v2_labelled_summary", f"{DISC}, m AS ({SUMMARY}) SELECT discrepancy_type, n, {LABEL.format('discrepancy_type')} FROM m")
def v2(spark, d):
    return charts.labelled_summary(matching.summarise_discrepancies(discrepancies(spark, d))).select("discrepancy_type", "n", "discrepancy_label")


@query("v3_scatter", f"{DISC} SELECT grant_number, match_method, outlay_ratio, award_amount, {LABEL.format(chr(39) + 'Normal' + chr(39))} FROM disc WHERE outlay_ratio IS NOT NULL AND award_amount > 0")
def v3(spark, d):
    return charts.scatter(discrepancies(spark, d)).select("grant_number", "match_method", "outlay_ratio", "award_amount", "discrepancy_label")


STATES = [("CA", "California"), ("NY", "New York"), ("TX", "Texas"), ("PR", "Puerto Rico")]


@query("v4_j17_states", f"{ctes('notices')}, t(org_state, state_name) AS (VALUES {', '.join(str(x) for x in STATES)}), s AS (SELECT org_state, count(*) AS n_grants, round(sum(award_amount), 2) AS total_amount FROM notices WHERE length(org_state) = 2 GROUP BY org_state) SELECT t.*, s.n_grants, s.total_amount FROM t LEFT JOIN s USING (org_state)")
def v4(spark, d):
    states = spark.createDataFrame(STATES, "org_state string, state_name string")
    return charts.state_counts(table(spark, d, "notices"), states).withColumn("total_amount", F.round("total_amount", 2))


@query("v5_p20_severity", f"{DISC} SELECT grant_number, CASE WHEN elapsed_ratio > 0.5 AND outlay_ratio < 0.10 THEN 'High Urgency' ELSE 'Lower Urgency' END AS severity FROM disc WHERE discrepancy_type IN ('possible_freeze', 'possible_freeze_no_data') AND elapsed_ratio IS NOT NULL AND outlay_ratio IS NOT NULL")
def v5(spark, d):
    return charts.freeze_severity(discrepancies(spark, d)).select("grant_number", "severity")


@query("a21_k4_kpis", f"{DISC} SELECT count(*) AS n_records, count(*) FILTER (discrepancy_type <> 'normal') AS n_discrepancies, round(sum(award_amount), 2) AS total_amount FROM disc")
def a21(spark, d):
    return charts.kpis(discrepancies(spark, d)).withColumn("total_amount", F.round("total_amount", 2))


@query("v11_record_table", f"{DISC} SELECT grant_number AS \"grant\", agency_name AS agency, org_name AS organisation, discrepancy_type AS discrepancy, match_method AS \"match\" FROM disc WHERE discrepancy_type <> 'normal'")
def v11(spark, d):
    return charts.record_table(discrepancies(spark, d)).drop("amount")
