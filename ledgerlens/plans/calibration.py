"""Queries of the calibration against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.scalars import parse_period_outlays
from ledgerlens.operators import calibration, charts, transactions
from ledgerlens.plans.adapters import AS_OF, TXN_AS_OF, table
from ledgerlens.plans.classification import discrepancies
from ledgerlens.plans.enrichment import TXN, disc
from ledgerlens.plans.scalars import DUCK_PERIODS

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def joined(spark, d):
    rows = transactions.enrich(discrepancies(spark, d), table(spark, d, "transactions"), TXN_AS_OF)
    return calibration.join_labels(table(spark, d, "labels_"), rows)


def data(spark, d):
    return calibration.add_features(joined(spark, d), AS_OF)


JOINED = f"""{disc('transactions', 'labels_')}, {TXN}, e AS (SELECT disc.* EXCLUDE (org_name), days_since_last_transaction, freeze_confidence FROM disc LEFT JOIN tc USING (grant_number)),
    jl AS (SELECT l.*, e.* EXCLUDE (grant_number) FROM labels_ l JOIN e ON l.gw_award_id = e.grant_number)"""
DATA = f"""{JOINED}, cd AS (SELECT *, outlay_ratio AS our_outlay_ratio, elapsed_ratio AS our_elapsed_ratio, coalesce(outlay_ratio < 0.10, false) AS our_freeze_flag, freeze_confidence AS our_freeze_confidence,
    ever_frozen OR coalesce(gw_status IN ('\U0001f9ca Frozen Funding', '\U0001f4a7 Possibly Unfrozen Funding', '\U0001f6b0 Unfrozen Funding'), false) AS gw_frozen, gw_status AS gw_status_detail,
    CAST(date_diff('day', targeted_start_date, coalesce(targeted_end_date, DATE '{AS_OF}')) AS INT) AS days_frozen, CAST(date_diff('day', last_payment_date, DATE '{AS_OF}') AS INT) AS days_since_last_payment,
    CASE WHEN activity_code[1] IN ('R', 'T', 'F', 'K', 'P', 'U') THEN activity_code[1] ELSE 'Other' END AS activity_code_group FROM jl),
    ev AS (SELECT * FROM cd WHERE gw_frozen IS NOT NULL AND our_outlay_ratio IS NOT NULL)"""
FEATURES = ["gw_award_id", "our_outlay_ratio", "our_elapsed_ratio", "our_freeze_flag", "our_freeze_confidence", "gw_frozen", "days_frozen", "days_since_last_payment", "activity_code_group"]
CELLS = "count(*) FILTER ({p} AND gw_frozen) AS tp, count(*) FILTER ({p} AND NOT gw_frozen) AS fp, count(*) FILTER (NOT {p} AND gw_frozen) AS fn"
P, R = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END"


@query("g5_p22_features", f"{DATA} SELECT {', '.join(FEATURES)} FROM cd")
def g5(spark, d):
    return data(spark, d).select(FEATURES)


@query("a17_j15_coverage", f"{disc('labels_')}, a0 AS (SELECT DISTINCT gw_award_id AS k FROM labels_), b0 AS (SELECT DISTINCT grant_number AS k FROM disc) SELECT (SELECT count(*) FROM a0) AS n_labels, (SELECT count(*) FROM b0) AS n_ours, (SELECT count(*) FROM a0 JOIN b0 USING (k)) AS n_matched, (SELECT count(*) FROM a0 WHERE k NOT IN (SELECT k FROM b0)) AS n_labels_only, (SELECT count(*) FROM b0 WHERE k NOT IN (SELECT k FROM a0)) AS n_ours_only")
def a17(spark, d):
    return calibration.coverage(table(spark, d, "labels_"), discrepancies(spark, d))


@query("a12_confusion", f"{DATA}, c AS (SELECT {CELLS.format(p='our_freeze_flag')}, count(*) FILTER (NOT our_freeze_flag AND NOT gw_frozen) AS tn FROM ev), s AS (SELECT *, {P} AS precision, {R} AS recall FROM c) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM s")
def a12(spark, d):
    return calibration.confusion(data(spark, d))


SWEEP = f"""c AS (SELECT CAST(round(i * 0.01, 6) AS DOUBLE) AS threshold, {CELLS.format(p='(our_outlay_ratio < round(i * 0.01, 6) AND elapsed_ratio IS NOT NULL)')} FROM ev, range(1, 51) t(i) GROUP BY i),
    s AS (SELECT *, coalesce({P}, 0) AS precision, coalesce({R}, 0) AS recall FROM c), w AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s)"""


@query("a13_v6_threshold_sweep", f"{DATA}, {SWEEP} SELECT * FROM w")
def a13(spark, d):
    return calibration.sweep(data(spark, d))


@query("a13_t7_best_threshold", f"{DATA}, {SWEEP} SELECT * FROM w ORDER BY f1 DESC, threshold LIMIT 1")
def t7(spark, d):
    return calibration.best_threshold(calibration.sweep(data(spark, d)))


def breakdown_sql(key: str) -> str:
    return f"{DATA}, c AS (SELECT {key}, count(*) AS n_grants, count(*) FILTER (gw_frozen) AS n_gw_frozen, count(*) FILTER (our_freeze_flag) AS n_our_flag, {CELLS.format(p='our_freeze_flag')} FROM ev WHERE {key} IS NOT NULL GROUP BY {key})"


@query("a15_by_institution", f"{breakdown_sql('org_name')} SELECT *, {P} AS precision, {R} AS recall FROM c")
def a15(spark, d):
    return calibration.breakdown(data(spark, d), "org_name")


@query("a15_by_activity", f"{breakdown_sql('activity_code_group')} SELECT *, {P} AS precision, {R} AS recall FROM c")
def a15b(spark, d):
    return calibration.breakdown(data(spark, d), "activity_code_group")


@query("v9_x2_institution_scores", f"{breakdown_sql('org_name')}, s AS (SELECT org_name, substring(regexp_replace(org_name, '^(THE )?', ''), 1, 30) AS label, n_grants, {P} AS precision, {R} AS recall FROM c WHERE n_grants >= 2) SELECT org_name, label, n_grants, 'precision' AS metric, precision AS value FROM s UNION ALL SELECT org_name, label, n_grants, 'recall', recall FROM s")
def v9(spark, d):
    return charts.institution_scores(calibration.breakdown(data(spark, d), "org_name"), 2)


@query("g6_false_positives", f"{DATA} SELECT gw_award_id, org_name, gw_status_detail, our_outlay_ratio, our_elapsed_ratio, award_amount FROM ev WHERE our_freeze_flag AND NOT gw_frozen")
def g6(spark, d):
    return calibration.errors(data(spark, d), True)


@query("g6_false_negatives", f"{DATA} SELECT gw_award_id, org_name, gw_status_detail, our_outlay_ratio, our_elapsed_ratio, award_amount FROM ev WHERE NOT our_freeze_flag AND gw_frozen")
def g6b(spark, d):
    return calibration.errors(data(spark, d), False)


STATUS = "CASE WHEN contains(gw_status_detail, 'Frozen') THEN 'Frozen' WHEN contains(gw_status_detail, 'Unfrozen') THEN 'Unfrozen' WHEN contains(gw_status_detail, 'Terminated') THEN 'Terminated' WHEN contains(gw_status_detail, 'Reinstated') THEN 'Reinstated' ELSE 'Other' END"


@query("v7_a20_contingency", f"{DATA} SELECT discrepancy_type AS our_label, {STATUS} AS gw_label, count(*) AS n FROM cd WHERE gw_status_detail IS NOT NULL AND discrepancy_type IS NOT NULL GROUP BY ALL")
def v7(spark, d):
    rows = data(spark, d).where("gw_status_detail is not null and discrepancy_type is not null")
    return calibration.contingency(rows.select(F.col("discrepancy_type").alias("our_label"), charts.status_label(F.col("gw_status_detail")).alias("gw_label")), "our_label", "gw_label")


GAP = f"""{DATA}, {DUCK_PERIODS}, pp AS (SELECT cd.gw_award_id, any_value(cd.our_outlay_ratio) AS our_outlay_ratio, any_value(gw_total_award) AS total, any_value(cd.org_name) AS org_name,
        coalesce(sum(amount) FILTER (period_date < targeted_start_date), 0) AS outlays_before_targeting, coalesce(sum(amount) FILTER (period_date >= targeted_start_date), 0) AS outlays_during_targeting,
        CAST(count(*) FILTER (period_date >= targeted_start_date AND amount = 0) AS INT) AS months_zero_during_freeze
        FROM cd JOIN r USING (gw_award_id) WHERE targeted_start_date IS NOT NULL AND file_c_outlays_raw IS NOT NULL GROUP BY cd.gw_award_id),
    pq AS (SELECT *, CASE WHEN total > 0 THEN outlays_before_targeting / total END AS pct_outlaid_at_targeting FROM pp)"""
GAP_COLUMNS = ["gw_award_id", "outlays_before_targeting", "outlays_during_targeting", "months_zero_during_freeze", "pct_outlaid_at_targeting", "temporal_mismatch"]
MISMATCH = "coalesce(our_outlay_ratio > 0.50 AND pct_outlaid_at_targeting < 0.50, false) AS temporal_mismatch"


@query("g4_p25_temporal_gap", f"{GAP} SELECT {', '.join(GAP_COLUMNS[:-1])}, {MISMATCH} FROM pq")
def g4(spark, d):
    return calibration.temporal_gap(data(spark, d)).select(GAP_COLUMNS)


@query("g4_name_filter", f"{GAP} SELECT gw_award_id, {MISMATCH} FROM pq WHERE contains(upper(org_name), 'R#00000001')")
def g4b(spark, d):
    return calibration.name_filter(calibration.temporal_gap(data(spark, d)), "r#00000001").select("gw_award_id", "temporal_mismatch")


SCORED = "sc AS (SELECT 1 - our_outlay_ratio / (1 + our_outlay_ratio) AS prediction, CAST(gw_frozen AS INT) AS label FROM ev WHERE our_outlay_ratio >= 0)"


def scored(spark, d):
    ratio = F.col("our_outlay_ratio")
    return calibration.evaluable(data(spark, d)).where(ratio >= 0).select((1 - ratio / (1 + ratio)).alias("prediction"), F.col("gw_frozen").cast("int").alias("label"))


@query("a16_auc", f"{DATA}, {SCORED} SELECT round(avg(CASE WHEN a.prediction > b.prediction THEN 1.0 WHEN a.prediction = b.prediction THEN 0.5 ELSE 0.0 END), 9) AS auc FROM sc a, sc b WHERE a.label = 1 AND b.label = 0")
def a16(spark, d):
    return calibration.auc(scored(spark, d)).select(F.round("auc", 9).alias("auc"))


@query("v10_roc", f"{DATA}, {SCORED} SELECT round(i / 100, 2) AS threshold, count(*) FILTER (label = 1 AND greatest(0, least(99, floor(round(prediction * 100, 9)))) >= i) / count(*) FILTER (label = 1) AS tpr, count(*) FILTER (label = 0 AND greatest(0, least(99, floor(round(prediction * 100, 9)))) >= i) / count(*) FILTER (label = 0) AS fpr FROM sc, range(1, 100) t(i) GROUP BY i")
def v10(spark, d):
    return calibration.roc(scored(spark, d))


@query("v8_w9_timelines", f"""{DATA}, {DUCK_PERIODS}, ch AS (SELECT gw_award_id, gw_frozen, file_c_outlays_raw, row_number() OVER (PARTITION BY gw_frozen ORDER BY md5(gw_award_id || ':42'), gw_award_id) AS rn FROM cd)
    SELECT ch.gw_award_id, gw_frozen, period, amount, period_date FROM ch JOIN r USING (gw_award_id) WHERE rn <= 6""")
def v8(spark, d):
    rows = data(spark, d).withColumn("periods", parse_period_outlays(F.col("file_c_outlays_raw")))
    return charts.sample_timelines(rows)


#: The model's rows with their folds, dealt in the order of a hash.
MODEL = f"""{DATA}, ml AS (SELECT gw_award_id, CAST(gw_frozen AS INT) AS label, our_outlay_ratio, our_elapsed_ratio, coalesce(days_since_last_transaction, 365) AS days_since_txn,
        CAST(activity_code_group = 'R' AS INT) AS activity_R, CAST(activity_code_group = 'T' AS INT) AS activity_T, CAST(activity_code_group = 'F' AS INT) AS activity_F, CAST(activity_code_group = 'K' AS INT) AS activity_K
        FROM cd WHERE gw_frozen IS NOT NULL AND our_outlay_ratio IS NOT NULL AND our_elapsed_ratio IS NOT NULL),
    md AS (SELECT *, CAST((row_number() OVER (ORDER BY substr(md5(gw_award_id || ':42'), 1, 15), gw_award_id, label) - 1) % 5 AS INT) AS fold FROM ml)"""


@query("g7_classifier_coefficients", None)
def g7(spark, d):
    return calibration.coefficients(data(spark, d))


@query("g7_classifier_predictions", None)
def g7b(spark, d):
    return calibration.predictions(data(spark, d))


@query("g7_fold_totals", f"{MODEL} SELECT fold, count(*) AS n, sum(label) AS n_frozen FROM md GROUP BY fold")
def g7d(spark, d):
    return calibration.model_data(data(spark, d)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_frozen"))


#: A model's slope is 0 where its chances' sums are those of the frozen rows, feature by feature: this is what the fits are held against.
@query("g7_fitted_totals", f"""{MODEL}, mm AS (SELECT m AS model, md.* FROM md, (SELECT CAST(unnest(range(6)) AS INT) AS m) WHERE m <> fold),
    ms AS (SELECT model, CAST(sum(label) AS DOUBLE) AS intercept, {', '.join(f'CAST(sum(label * {f}) AS DOUBLE) AS {f}' for f in calibration.MODEL_FEATURES)} FROM mm GROUP BY model)
    SELECT model, feature, round(total, 3) AS total FROM (UNPIVOT ms ON intercept, {', '.join(calibration.MODEL_FEATURES)} INTO NAME feature VALUE total)""")
def g7e(spark, d):
    return calibration.fitted_totals(data(spark, d)).withColumn("total", F.round("total", 3))


@query("g7_classifier_thresholds", None)
def g7c(spark, d):
    return calibration.thresholds(calibration.predictions(data(spark, d)))
