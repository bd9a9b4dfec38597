"""Queries of the column functions, validation and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as s
from ledgerlens.operators import validate
from ledgerlens.plans.adapters import AS_OF, ctes, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


DUCK_DATE = """coalesce(try_strptime(nullif(regexp_extract(x, '^\\s*([A-Za-z]+ \\d{1,2}, \\d{4})', 1), ''), '%B %d, %Y'),
    try_strptime(nullif(regexp_extract(x, '^\\s*(\\d{1,2}/\\d{1,2}/\\d{4})', 1), ''), '%m/%d/%Y'),
    try_strptime(nullif(regexp_extract(x, '^\\s*(\\d{4}-\\d{1,2}-\\d{1,2})', 1), ''), '%Y-%m-%d'))::DATE"""


@query("f1_parse_dates", f"""
    SELECT o_orderkey, {DUCK_DATE} AS d FROM (SELECT o_orderkey, CASE o_orderkey % 6
        WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00' WHEN 1 THEN CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR)
        WHEN 2 THEN strftime(o_orderdate, '%B ') || CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ', %Y') WHEN 3 THEN '' WHEN 4 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') END AS x FROM orders)""")
def f1(spark, d):
    date = F.col("o_orderdate")
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T00:00:00"))).when(k == 1, F.date_format(date, "M/d/yyyy")).when(k == 2, F.date_format(date, "MMMM d, yyyy")).when(k == 3, "").when(k == 4, F.concat(F.lit("on "), F.date_format(date, "yyyy-MM-dd")))
    return table(spark, d, "orders").select("o_orderkey", s.parse_date(text).alias("d"))


@query("f2_m2_ratios", ctes("awards") + " SELECT grant_number, CASE WHEN award_amount > 0 THEN total_outlays / award_amount END AS ratio FROM awards")
def f2(spark, d):
    return table(spark, d, "awards").select("grant_number", s.safe_ratio(F.col("total_outlays"), F.col("award_amount")).alias("ratio"))


@query("f3_f9_amounts", """
    SELECT event_id, TRY_CAST(trim(replace(replace(replace(a, '$', ''), ',', ''), '"', '')) AS DOUBLE) AS amount, TRY_CAST(nullif(b, 'null') AS DOUBLE) AS number
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '$1,' || CAST(100 + event_id % 900 AS VARCHAR) || ' ' WHEN 1 THEN '-$' || CAST(event_id % 77 AS VARCHAR) WHEN 2 THEN 'TBD' WHEN 3 THEN '"$5,000"' END AS a,
        CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN CAST(event_id AS VARCHAR) || '.5' END AS b FROM events)""")
def f3(spark, d):
    k = F.col("event_id")
    a = F.when(k % 5 == 0, F.concat(F.lit("$1,"), 100 + k % 900, F.lit(" "))).when(k % 5 == 1, F.concat(F.lit("-$"), k % 77)).when(k % 5 == 2, "TBD").when(k % 5 == 3, '"$5,000"')
    b = F.when(k % 3 == 0, "null").when(k % 3 == 1, F.concat(k, F.lit(".5")))
    return table(spark, d, "events").select("event_id", s.parse_amount(a).alias("amount"), s.to_number(b).alias("number"))


def duck_org(x: str) -> str:
    x = f"trim(regexp_replace(upper({x}), '\\s+', ' ', 'g'))"
    for pattern, new in s.ORG_RULES:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("f5_f6_normalise_org", ctes("awards", "notices") + f" SELECT raw, {duck_org('raw')} AS org, count(*) AS n FROM (SELECT org_name AS raw FROM awards UNION ALL SELECT org_name FROM notices) GROUP BY raw")
def f6(spark, d):
    both = table(spark, d, "awards").select("org_name").unionByName(table(spark, d, "notices").select("org_name"))
    return both.groupBy(F.col("org_name").alias("raw")).agg(F.count(F.lit(1)).alias("n")).select("raw", s.normalise_org(F.col("raw")).alias("org"), "n")


DUCK_TOKENS = "list_filter(string_split_regex({}, '\\s+'), lambda w: NOT list_contains(['" + "','".join(s.k.ORG_STOPWORDS) + "'], w))"


@query("f7_distinctive_tokens", "WITH p AS (SELECT DISTINCT upper(p_name) || ' UNIVERSITY OF THE STATE' AS a FROM part), q AS (SELECT a, lead(a, 7) OVER (ORDER BY a) AS b FROM p) SELECT a, b, coalesce(list_has_any(" + DUCK_TOKENS.format("a") + ", " + DUCK_TOKENS.format("b") + "), false) AS shared FROM q")
def f7(spark, d):
    from pyspark.sql import Window

    names = table(spark, d, "part").select(F.concat(F.upper("p_name"), F.lit(" UNIVERSITY OF THE STATE")).alias("a")).distinct()
    pairs = names.withColumn("b", F.lead("a", 7).over(Window.orderBy("a")))
    return pairs.withColumn("shared", s.share_distinctive_token(F.col("a"), F.col("b")))


@query("f10_clean_text", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace('DESCRIPTION: <![CDATA[' || html || ']]>', '^DESCRIPTION:\s*', ''), '<!\[CDATA\[|\]\]>', '', 'g'), '<[^>]+>', '', 'g') AS body FROM pages")
def f10(spark, d):
    return table(spark, d, "pages").select("page_id", s.clean_description(F.concat(F.lit("DESCRIPTION: <![CDATA["), "html", F.lit("]]>"))).alias("body"))


@query("f13_f14_urls_and_ids", ctes("awards") + """
    SELECT grant_number, 'https://www.nsf.gov/awardsearch/showAward?AWD_ID=' || grant_number AS url, 'ASST_NON_' || grant_number || '_' || CASE agency_name
        WHEN 'Department of Health and Human Services' THEN '075' WHEN 'National Science Foundation' THEN '049' WHEN 'Environmental Protection Agency' THEN '068' END AS internal_id FROM awards""")
def f14(spark, d):
    return table(spark, d, "awards").select("grant_number", F.concat(F.lit("https://www.nsf.gov/awardsearch/showAward?AWD_ID="), "grant_number").alias("url"), s.internal_id(F.col("grant_number"), F.col("agency_name")).alias("internal_id"))


@query("f16_emergency_codes", ctes("awards") + """
    SELECT grant_number, coalesce(list_has_any(list_transform(string_split_regex(def_codes, '[,;]+'), lambda c: trim(c)), ['Z','L','M','3','4','5','6','7','N']), false) AS emergency FROM awards""")
def f16(spark, d):
    return table(spark, d, "awards").select("grant_number", s.emergency_codes(F.col("def_codes")).alias("emergency"))


@query("f17_recipient_key", r"SELECT c_custkey, upper(trim(regexp_replace(regexp_replace(n, '\s+', ' ', 'g'), '[,.''\-]', ' ', 'g'))) AS name_key FROM (SELECT c_custkey, c_name || ',   Inc.-' || c_mktsegment || '''s ' AS n FROM customer)")
def f17(spark, d):
    return table(spark, d, "customer").select("c_custkey", s.recipient_key(F.concat("c_name", F.lit(",   Inc.-"), "c_mktsegment", F.lit("'s "))).alias("name_key"))


DUCK_PERIODS = r"""p AS (SELECT gw_award_id, unnest(list_filter(list_transform(string_split(file_c_outlays_raw, chr(10)), lambda x: regexp_replace(trim(x), '^-\s*', '')),
        lambda x: regexp_matches(x, '^(.+?):\s*\$?([0-9,.]+)$'))) AS line FROM labels_),
    q AS (SELECT gw_award_id, trim(regexp_extract(line, '^(.+?):\s*\$?([0-9,.]+)$', 1)) AS period, TRY_CAST(replace(regexp_extract(line, '^(.+?):\s*\$?([0-9,.]+)$', 2), ',', '') AS DOUBLE) AS amount FROM p),
    r AS (SELECT *, try_strptime('01 ' || regexp_replace(period, '/[A-Za-z]+', ''), '%d %b %Y')::DATE AS period_date FROM q)"""


@query("f18_d1_period_outlays", ctes("labels_") + ", " + DUCK_PERIODS + " SELECT * FROM r")
def f18(spark, d):
    rows = table(spark, d, "labels_").select("gw_award_id", F.explode(s.parse_period_outlays(F.col("file_c_outlays_raw"))).alias("p"))
    return rows.select("gw_award_id", "p.*")


@query("d2_elapsed", ctes("awards") + f" SELECT grant_number, CASE WHEN end_date > action_date THEN greatest(0, least(1, date_diff('day', action_date, DATE '{AS_OF}') / date_diff('day', action_date, end_date))) END AS elapsed FROM awards")
def d2(spark, d):
    return table(spark, d, "awards").select("grant_number", s.elapsed_ratio(F.col("action_date"), F.col("end_date"), F.lit(AS_OF).cast("date")).alias("elapsed"))


@query("d3_d4_fiscal_dates", """
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate + INTERVAL 3 MONTH) AS INT) AS fy, CAST(month(o_orderdate + INTERVAL 3 MONTH) AS INT) AS fm, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day FROM orders""")
def d3(spark, d):
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select(day.alias("d"), s.fiscal_year(day).alias("fy"), s.fiscal_month(day).alias("fm")).distinct()
    return rows.withColumn("first_day", s.fiscal_to_calendar(F.col("fy"), F.col("fm")))


NOTICE_FLAGS = """org_state IS NOT NULL AND org_state IN ('ON', 'QC') AS flag_international, org_state IS NOT NULL AND org_state = 'XX' AS flag_invalid_state,
    grant_number IS NOT NULL AND CASE agency_name WHEN 'NSF' THEN NOT regexp_matches(grant_number, '^[0-9]{7}$') WHEN 'NIH' THEN NOT regexp_matches(grant_number, '^[A-Z0-9]') ELSE false END AS flag_bad_grant_number"""


@query("p16_p17_notice_flags", ctes("notices") + f" SELECT source_url, {NOTICE_FLAGS} FROM notices")
def p16(spark, d):
    return validate.flag_notices(validate.check_notices(table(spark, d, "notices"))).select("source_url", "flag_international", "flag_invalid_state", "flag_bad_grant_number")


AWARD_FLAGS = f"""coalesce(total_outlays < 0, false) AS flag_negative_outlay, coalesce(award_amount > 0 AND total_outlays > award_amount * 1.5, false) AS flag_over_disbursed,
    coalesce(end_date < action_date, false) AS flag_date_inverted, coalesce(award_amount = 0, false) AS flag_zero_award, coalesce(action_date > DATE '{AS_OF}', false) AS flag_future_date,
    coalesce(CASE string_split(cfda_number, '.')[1] WHEN '93' THEN 'Department of Health and Human Services' WHEN '47' THEN 'National Science Foundation' WHEN '66' THEN 'Environmental Protection Agency' END <> agency_name, false) AS flag_cfda_mismatch"""
FLAGS = ["flag_negative_outlay", "flag_over_disbursed", "flag_date_inverted", "flag_zero_award", "flag_future_date", "flag_cfda_mismatch"]


def flagged(spark, d):
    return validate.flag_awards(validate.check_awards(table(spark, d, "awards")), F.lit(AS_OF).cast("date"))


@query("p14_p15_award_flags", ctes("awards") + f" SELECT grant_number, {AWARD_FLAGS} FROM awards")
def p14(spark, d):
    return flagged(spark, d).select("grant_number", *FLAGS)


@query("a14_profile", ctes("awards") + f", f AS (SELECT total_outlays, cfda_number, {AWARD_FLAGS} FROM awards) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 1) AS pct_null, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 1) > 5 AS high_null, "
    + (f"count(*) FILTER ({c}) AS n_flagged, round(100.0 * count(*) FILTER ({c}) / count(*), 1) AS pct_flagged FROM f" if c.startswith("flag_") else "CAST(NULL AS BIGINT) AS n_flagged, CAST(NULL AS DOUBLE) AS pct_flagged FROM f")
    for c in ["total_outlays", "cfda_number", *FLAGS]))
def a14(spark, d):
    return validate.profile(flagged(spark, d).select("total_outlays", "cfda_number", *FLAGS))


@query("a18_duplicates", ctes("notices") + " SELECT count(grant_number) - count(DISTINCT grant_number) + greatest(0, count(*) FILTER (grant_number IS NULL) - 1) AS n_duplicates FROM notices")
def a18(spark, d):
    return validate.duplicate_count(table(spark, d, "notices"), "grant_number", True)


@query("p7_u2_ids", "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def u2(spark, d):
    return table(spark, d, "events").select("user_id").dropna(how="all").distinct()


@query("s4_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s4(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
