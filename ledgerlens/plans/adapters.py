"""Domain tables derived from the test tables: one SQL text each, which Spark and the oracle both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2000-01-01"
TXN_AS_OF = "2025-06-01"

TEXTS = {
    "outlaid": """
        SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_outlays
        FROM {lineitem} WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY l_orderkey""",
    "projects": """
        SELECT l.l_orderkey, MIN(p.p_name) || ' ' || MAX(p.p_name) AS project FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey""",
    "awards": """
        SELECT CAST(o.o_orderkey AS STRING) AS grant_number, c.c_name AS recipient_name, CAST(c.c_custkey AS STRING) AS recipient_id,
               CASE c.c_nationkey % 4 WHEN 0 THEN 'Department of Health and Human Services' WHEN 1 THEN 'National Science Foundation'
                    WHEN 2 THEN 'Environmental Protection Agency' ELSE n.n_name END AS agency_name,
               CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Administration for Children and Families' ELSE c.c_mktsegment END AS sub_agency,
               CASE o.o_orderkey % 6 WHEN 0 THEN p.project || ' Universty' WHEN 1 THEN 'THE ' || p.project || ' UNIVERSITY, INC.'
                    WHEN 2 THEN p.project || '-University at Austin' ELSE p.project || '  University' END AS org_name,
               CASE WHEN o.o_orderkey % 97 = 0 THEN 0.0 WHEN o.o_orderkey % 101 = 0 THEN 2e9 ELSE o.o_totalprice END AS award_amount,
               CASE WHEN o.o_orderkey % 89 = 0 THEN -l.total_outlays ELSE l.total_outlays END AS total_outlays,
               CAST(o.o_orderdate AS DATE) AS action_date,
               CAST(o.o_orderdate AS DATE) + CAST(365 + o.o_orderkey % 1500 - CASE WHEN o.o_orderkey % 83 = 0 THEN 2000 ELSE 0 END AS INT) AS end_date,
               CASE o.o_orderkey % 5 WHEN 0 THEN '93.' WHEN 1 THEN '47.' WHEN 2 THEN '66.' WHEN 3 THEN '99.' END || CAST(100 + o.o_orderkey % 800 AS STRING) AS cfda_number,
               CASE o.o_orderkey % 4 WHEN 0 THEN 'Q' WHEN 1 THEN 'L,M' WHEN 2 THEN 'Q; N' END AS def_codes
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
             LEFT JOIN {projects} p ON p.l_orderkey = o.o_orderkey LEFT JOIN {outlaid} l ON l.l_orderkey = o.o_orderkey""",
    "repeated_awards": """
        SELECT * FROM {awards}
        UNION ALL SELECT a.* FROM {awards} a CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS t(i) WHERE CAST(a.grant_number AS INT) % 50 = 3
        UNION ALL SELECT CAST(NULL AS STRING) AS grant_number, CAST(NULL AS STRING) AS recipient_name, a.* EXCEPT (grant_number, recipient_name) FROM {awards} a WHERE CAST(a.grant_number AS INT) % 40 = 1
        UNION ALL SELECT CAST(NULL AS STRING) AS grant_number, a.org_name AS recipient_name, a.recipient_id, a.agency_name, a.sub_agency, CAST(NULL AS STRING) AS org_name, a.* EXCEPT (grant_number, recipient_name, recipient_id, agency_name, sub_agency, org_name)
                  FROM {awards} a WHERE CAST(a.grant_number AS INT) % 40 = 1""",
    "notices": """
        SELECT CASE WHEN o.o_orderkey % 5 = 0 THEN NULL WHEN o.o_orderkey % 3 = 1 THEN 'N' || CAST(o.o_orderkey AS STRING) ELSE CAST(o.o_orderkey AS STRING) END AS grant_number,
               CASE WHEN o.o_orderkey % 2 = 0 THEN 'NIH' ELSE 'NSF' END AS agency_name,
               CASE WHEN o.o_orderkey % 13 <> 0 THEN 'IC' || CAST(o.o_orderkey % 23 AS STRING) END AS institute,
               CASE WHEN o.o_orderkey % 11 <> 0 THEN CAST(o.o_orderdate AS DATE) + 30 END AS notice_date,
               'https://example.org/' || CAST(o.o_orderkey AS STRING) AS source_url, o.o_orderpriority AS raw_text_snippet,
               CASE WHEN o.o_orderkey % 4 = 0 THEN p.project || ' University (Campus ' || CAST(o.o_orderkey % 3 AS STRING) || ')' ELSE 'The ' || p.project || ' University' END AS org_name,
               CASE o.o_orderkey % 7 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'PR' WHEN 3 THEN 'ON' WHEN 4 THEN 'XX' WHEN 5 THEN 'QC' END AS org_state,
               o.o_totalprice * CASE WHEN o.o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS award_amount
        FROM {orders} o LEFT JOIN {projects} p ON p.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'""",
    "nih_records": """
        SELECT CAST(o.o_orderkey AS STRING) AS appl_id, 'Project ' || CAST(o.o_orderkey AS STRING) AS project_title, CASE WHEN o.o_custkey % 5 = 0 THEN 'VA' ELSE 'P' END || CAST(o.o_custkey AS STRING) AS project_num,
               CASE WHEN o.o_orderkey % 9 <> 0 THEN CAST(CAST(o.o_orderdate AS DATE) AS STRING) || 'T00:00:00' END AS project_end_date, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS date_added, o.o_totalprice AS award_amount, o.o_orderstatus = 'O' AS is_active,
               c.c_name AS org_name, c.c_mktsegment AS org_state, CASE o.o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'NCI' END AS ic, CASE WHEN o.o_orderkey % 3 <> 0 THEN 'Institute' END AS ic_name
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "transactions": """
        SELECT CAST(user_id AS STRING) AS grant_number, CASE WHEN event_id % 37 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 480 AS INT) END AS transaction_date,
               CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_type = 'error' THEN -round(value * 100, 0) ELSE round(value * 100, 0) END AS obligation_amount,
               CASE event_type WHEN 'error' THEN CASE WHEN event_id % 30 = 0 THEN 'E' ELSE 'D' END WHEN 'signup' THEN 'A' WHEN 'purchase' THEN 'B' WHEN 'click' THEN 'G' WHEN 'view' THEN 'C' END AS action_type,
               CAST(event_id AS STRING) AS modification_number
        FROM {events}""",
    "records": """
        SELECT CAST(l_orderkey AS STRING) AS grant_number, CAST(date_trunc('month', l_shipdate) AS DATE) AS reporting_date,
               year(l_shipdate) AS reporting_year, month(l_shipdate) AS reporting_month,
               CASE WHEN l_partkey % 3 = 0 THEN 0.0 WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN -l_quantity ELSE l_extendedprice END AS outlay_amount,
               l_quantity AS obligated_amount
        FROM {lineitem}""",
    "subawards": """
        SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS subaward_id, s.s_name AS subawardee_name,
               CASE WHEN l.l_partkey % 19 <> 0 THEN CAST(l.l_shipdate AS DATE) END AS subaward_date, l.l_extendedprice AS subaward_amount,
               CAST(l.l_orderkey AS STRING) AS prime_award_id, CASE WHEN l.l_orderkey % 17 <> 0 THEN 'Prime ' || CAST(l.l_orderkey % 500 AS STRING) END AS prime_recipient
        FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey WHERE l.l_returnflag = 'R'""",
    "labels_": """
        SELECT CASE WHEN o.o_orderkey % 2 = 1 THEN 'G' ELSE '' END || CAST(o.o_orderkey AS STRING) AS gw_award_id, c.c_name AS org_name,
               CASE o.o_orderkey % 5 WHEN 0 THEN '\U0001f9ca Frozen Funding' WHEN 1 THEN 'Terminated' WHEN 2 THEN '\U0001f4a7 Possibly Unfrozen Funding' WHEN 3 THEN 'Possibly Reinstated' END AS gw_status,
               o.o_orderkey % 7 = 0 AS ever_frozen,
               CASE WHEN o.o_orderkey % 6 <> 0 THEN CAST(o.o_orderdate AS DATE) + 100 END AS targeted_start_date,
               CASE WHEN o.o_orderkey % 4 <> 0 THEN CAST(o.o_orderdate AS DATE) + 400 END AS targeted_end_date,
               CASE WHEN o.o_orderkey % 9 <> 0 THEN '- Oct/Nov ' || CAST(1995 + o.o_orderkey % 6 AS STRING) || ': $' || CAST(o.o_orderkey % 900 AS STRING) || chr(10) || '- Dec 1998: $1,' || CAST(100 + o.o_orderkey % 900 AS STRING)
                    || '.50' || chr(10) || 'no amount here' || chr(10) || ' - Mar 1999: $0' END AS file_c_outlays_raw,
               o.o_totalprice AS gw_total_award, CASE o.o_orderkey % 12 WHEN 0 THEN 'R01' WHEN 2 THEN 'T32' WHEN 4 THEN 'F31' WHEN 6 THEN 'K99' WHEN 8 THEN 'X1' END AS activity_code,
               CASE WHEN o.o_orderkey % 8 <> 0 THEN CAST(o.o_orderdate AS DATE) + 200 END AS last_payment_date
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, or one that is derived from these."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TEXTS[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def ctes(*names: str) -> str:
    """WITH clauses for the oracle, each after those it reads."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in BASE or name in done:
            return
        for n in re.findall(r"\{(\w+)\}", TEXTS[name]):
            add(n)
        done[name] = re.sub(r"\{(\w+)\}", r"\1", TEXTS[name])

    for name in names:
        add(name)
    # the oracle calls Spark's EXCEPT columns EXCLUDE
    return "WITH " + ", ".join(f"{n} AS ({t.replace('* EXCEPT (', '* EXCLUDE (')})" for n, t in done.items())
