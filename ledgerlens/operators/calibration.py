"""Holding the freeze flag against labels: features, confusion, threshold sweeps, breakdowns, a classifier."""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import constants as k
from ledgerlens.functions.scalars import activity_group, holds, member, parse_period_outlays, safe_ratio
from ledgerlens.operators.numbering import number_rows


def join_labels(labels: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """Labels with our rows of the same award; the labels' organisation name is kept."""
    return labels.join(discrepancies.drop("org_name"), F.col("gw_award_id") == F.col("grant_number")).drop("grant_number")


def coverage(labels: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """n_labels, n_ours, n_matched, n_labels_only, n_ours_only of distinct awards, by one full join of the ids."""
    a = labels.select(F.col("gw_award_id").alias("a")).distinct()
    b = discrepancies.select(F.col("grant_number").alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full")
    return both.agg(F.count("a").alias("n_labels"), F.count("b").alias("n_ours"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_matched"), F.count_if(F.col("b").isNull()).alias("n_labels_only"), F.count_if(F.col("a").isNull()).alias("n_ours_only"))


def add_features(joined: DataFrame, as_of) -> DataFrame:
    c, today = F.col, F.lit(as_of).cast("date")
    return joined.withColumns({
        "our_outlay_ratio": c("outlay_ratio"), "our_elapsed_ratio": c("elapsed_ratio"),
        "our_freeze_flag": holds(c("outlay_ratio") < k.FREEZE_RATIO),
        "our_freeze_confidence": c("freeze_confidence"),
        "gw_frozen": c("ever_frozen") | member(c("gw_status"), k.FROZEN_STATUSES),
        "gw_status_detail": c("gw_status"),
        "days_frozen": F.date_diff(F.coalesce("targeted_end_date", today), "targeted_start_date"),
        "days_since_last_payment": F.date_diff(today, "last_payment_date"),
        "activity_code_group": activity_group(c("activity_code")),
    })


def evaluable(data: DataFrame) -> DataFrame:
    return data.where("gw_frozen is not null and our_outlay_ratio is not null")


def _scores(df: DataFrame, fill: float | None = None) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn; where undefined null, or `fill`."""
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    if fill is not None:
        p, r = F.coalesce(p, F.lit(fill)), F.coalesce(r, F.lit(fill))
    out = df.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1 if fill is None else F.coalesce(f1, F.lit(fill)))


def _counts(pred: Column, actual: Column, tn: bool = False) -> list[Column]:
    out = [F.count_if(pred & actual).alias("tp"), F.count_if(pred & ~actual).alias("fp"), F.count_if(~pred & actual).alias("fn")]
    return [*out, F.count_if(~pred & ~actual).alias("tn")] if tn else out


def confusion(data: DataFrame) -> DataFrame:
    return _scores(evaluable(data).agg(*_counts(F.col("our_freeze_flag"), F.col("gw_frozen"), True)))


def sweep(data: DataFrame, steps: int = 50, width: float = 0.01) -> DataFrame:
    """tp, fp, fn and scores of ratio < threshold for every threshold, in one pass over data.

    A row adds to each threshold above its ratio: rows are counted by the first such
    step, and the few steps are summed up, instead of joining rows to thresholds.
    """
    rows = evaluable(data).select("gw_frozen", F.col("elapsed_ratio").isNotNull().alias("_live"), "our_outlay_ratio")
    first = F.when(F.col("_live"), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(steps + 1), lambda a, i: F.when((F.col("our_outlay_ratio") < F.round(i * F.lit(width), 6)) & (i < a), i).otherwise(a))).otherwise(steps + 1)
    counted = rows.groupBy(first.alias("_step")).agg(F.count_if("gw_frozen").alias("_t"), F.count_if(~F.col("gw_frozen")).alias("_f"))
    told = counted.agg(F.collect_list(F.struct("_step", "_t", "_f")).alias("_c"))  # at most steps + 1 entries
    lines = told.select("_c", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_s"))

    def upto(field: str, inside: bool) -> Column:
        chosen = F.filter("_c", lambda x: (x["_step"] <= F.col("_s")) if inside else (x["_step"] > F.col("_s")))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a + x[field])

    out = lines.select(F.round(F.col("_s") * width, 6).alias("threshold"), upto("_t", True).alias("tp"), upto("_f", True).alias("fp"), upto("_t", False).alias("fn"))
    return _scores(out, 0.0)


def best_threshold(swept: DataFrame) -> DataFrame:
    """The first threshold with the highest F1."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def breakdown(data: DataFrame, key: str) -> DataFrame:
    rows = evaluable(data).where(F.col(key).isNotNull())
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_grants"), F.count_if("gw_frozen").alias("n_gw_frozen"), F.count_if("our_freeze_flag").alias("n_our_flag"), *_counts(F.col("our_freeze_flag"), F.col("gw_frozen")))
    return _scores(out).drop("f1")


def errors(data: DataFrame, false_positives: bool) -> DataFrame:
    rows = evaluable(data)
    rows = rows.where("our_freeze_flag and not gw_frozen") if false_positives else rows.where("not our_freeze_flag and gw_frozen")
    return rows.select("gw_award_id", "org_name", "gw_status_detail", "our_outlay_ratio", "our_elapsed_ratio", "award_amount")


def contingency(data: DataFrame, *keys: str) -> DataFrame:
    return data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def temporal_gap(data: DataFrame) -> DataFrame:
    """Outlays of the label's own period text before its targeting and from it on (no end), and whether a grant only looks paid now."""
    rows = data.where("targeted_start_date is not null and file_c_outlays_raw is not null").withColumn("_p", parse_period_outlays(F.col("file_c_outlays_raw")))
    start = F.col("targeted_start_date")
    any_ = F.size("_p") > 0

    def add(keep) -> Column:
        return F.when(any_, F.aggregate(F.filter("_p", keep), F.lit(0.0), lambda a, x: a + F.coalesce(x["amount"], F.lit(0.0))))

    rows = rows.withColumns({
        "outlays_before_targeting": add(lambda x: x["period_date"] < start),
        "outlays_during_targeting": add(lambda x: x["period_date"] >= start),
        "months_zero_during_freeze": F.when(any_, F.size(F.filter("_p", lambda x: (x["period_date"] >= start) & (x["amount"] == 0)))),
    })
    rows = rows.withColumn("pct_outlaid_at_targeting", safe_ratio(F.col("outlays_before_targeting"), F.col("gw_total_award"))).drop("_p")
    mismatch = F.when(F.col("pct_outlaid_at_targeting").isNotNull() & F.col("our_outlay_ratio").isNotNull(), (F.col("our_outlay_ratio") > 0.50) & (F.col("pct_outlaid_at_targeting") < 0.50))
    return rows.withColumn("temporal_mismatch", holds(mismatch))


def name_filter(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(holds(F.upper("org_name").contains(text.upper())))


def auc(scored: DataFrame, score: str = "prediction", label: str = "label", parts: int = 256) -> DataFrame:
    """auc, the chance that a positive scores above a negative, ties counting half; null without both classes.

    Scores are counted by value first. The values are cut into `parts` ranges, whose
    sums are few; ranks within a range need that range only, so no task has all values.
    """
    counts = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    cuts = counts.agg(F.percentile_approx("_s", [i / parts for i in range(1, parts)], 100 * parts).alias("_cuts"))
    ranged = counts.join(F.broadcast(cuts), how="cross").withColumn("_part", F.size(F.filter("_cuts", lambda x: x <= F.col("_s"))))
    sums = ranged.groupBy("_part").agg(F.sum("_n").alias("_n_part")).withColumn("_before", F.coalesce(F.sum("_n_part").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ranged.withColumn("_within", within).join(F.broadcast(sums.select("_part", "_before")), "_part").withColumn("_w", F.col("_p") * (F.col("_before") + F.col("_within") + F.col("_n") / 2))
    return won.agg(F.try_divide(F.sum("_w"), F.sum("_p") * F.sum("_n")).alias("auc"))


def roc(scored: DataFrame, score: str = "prediction", label: str = "label") -> DataFrame:
    """threshold, tpr, fpr at 0.01 .. 0.99, counted by hundredths of the score."""
    step = F.greatest(F.lit(0), F.least(F.lit(99), F.floor(F.round(F.col(score) * 100, 9)))).cast("int")
    counts = scored.groupBy(step.alias("_step")).agg(F.count_if(F.col(label) == 1).alias("_t"), F.count_if(F.col(label) == 0).alias("_f"))
    told = counts.agg(F.collect_list(F.struct("_step", "_t", "_f")).alias("_c")).select("_c", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("_s"))

    def share(field: str) -> Column:
        add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x[field])
        return F.try_divide(add(F.filter("_c", lambda x: x["_step"] >= F.col("_s"))), add(F.col("_c")))

    return told.select(F.round(F.col("_s") / 100, 2).alias("threshold"), share("_t").alias("tpr"), share("_f").alias("fpr"))


MODEL_FEATURES = ("our_outlay_ratio", "our_elapsed_ratio", "days_since_txn", "activity_R", "activity_T", "activity_F", "activity_K")


def model_data(data: DataFrame, folds: int = 5) -> DataFrame:
    """label, the features and a fold; folds are dealt in the order of a hash of the award's id, so their sizes differ by one at most."""
    rows = data.where("gw_frozen is not null and our_outlay_ratio is not null and our_elapsed_ratio is not null")
    rows = rows.withColumn("days_since_txn", F.coalesce(F.col("days_since_last_transaction").cast("double"), F.lit(365.0)))
    rows = rows.withColumns({f"activity_{x}": (F.col("activity_code_group") == x).cast("double") for x in "RTFK"})
    # 60 bits of the hash, stretched over the range of a long
    key = F.shiftleft(F.conv(F.substring(F.md5(F.concat(F.coalesce("gw_award_id", F.lit("")), F.lit(":42"))), 1, 15), 16, 10).cast("long") - F.lit(1 << 59), 4)
    numbered = number_rows(rows.select("gw_award_id", F.col("gw_frozen").cast("int").alias("label"), *MODEL_FEATURES), "_n", key)
    return numbered.withColumn("fold", F.pmod(F.col("_n") - 1, F.lit(folds)).cast("int")).drop("_n")


def _linear(weights: Column, features: list[str]) -> Column:
    """Intercept, then the features, times their weights."""
    return weights[0] + sum((weights[i + 1] * F.coalesce(F.col(f), F.lit(0.0)) for i, f in enumerate(features)), F.lit(0.0))


def fit_logistic(rows: DataFrame, features: list[str], folds: int, steps: int = 25, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of all folds but one, for each, and of all rows, last: weights[model, 1 + features] (the intercept first) and their covariances.

    Newton's method, all models at once: a step is one pass over the rows, in which each row is
    weighed under every model that it belongs to, and the sums X'WX and X'(y - p) of each model are grouped and
    combined before the shuffle. Some fifty numbers a model reach the driver. Weights that can't be told
    apart share their effect; a separation that no finite weights fit ends after `steps`.
    """
    k = len(features) + 1
    weights, models = np.zeros((folds + 1, k)), list(range(folds + 1))
    x = [F.lit(1.0), *(F.coalesce(F.col(f), F.lit(0.0)) for f in features)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    square = np.zeros((folds + 1, k, k))
    for _ in range(steps):
        told = F.array(*[F.struct(F.lit(m).alias("m"), F.array(*[F.lit(float(v)) for v in weights[m]]).alias("w")) for m in models])
        under = rows.select("label", "fold", *features, F.explode(told).alias("_model")).where("_model.m <> fold")
        p = 1 / (1 + F.exp(-_linear(F.col("_model.w"), features)))
        # the products are columns of their own, so that a sum is of a column
        made = under.select(F.col("_model.m").alias("m"), "label", p.alias("_p"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
        made = made.withColumn("_w", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-12)))
        sums = [F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i, j in pairs] + [F.sum((F.col("label") - F.col("_p")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(k)]
        most = 0.0
        for r in made.groupBy("m").agg(*sums).collect():  # one row a model
            for i, j in pairs:
                square[r["m"], i, j] = square[r["m"], j, i] = r[f"h{i}_{j}"]
            step = np.linalg.lstsq(square[r["m"]], np.array([r[f"g{i}"] for i in range(k)]), rcond=1e-13)[0]
            weights[r["m"]] += step
            most = max(most, float(np.max(np.abs(step) / (1 + np.abs(weights[r["m"]])))))
        if most < tolerance:
            break
    return weights, np.array([np.linalg.pinv(s, rcond=1e-13) for s in square])


def _fitted(data: DataFrame, folds: int, least: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The features that vary and fit_logistic() of them; no features below `least` rows."""
    rows = model_data(data, folds).persist()
    spread = rows.agg(F.count(F.lit(1)).alias("n"), *[(F.max(f) > F.min(f)).alias(f) for f in MODEL_FEATURES]).first()
    used = [f for f in MODEL_FEATURES if spread[f]] if spread.n >= least else []
    weights, covariances = fit_logistic(rows, used, folds) if used else (np.zeros((0, 0)), np.zeros((0, 0, 0)))
    rows.unpersist()
    return used, weights, covariances


def coefficients(data: DataFrame, least: int = 50, folds: int = 5) -> DataFrame:
    """Logistic regression on all rows: feature, coefficient, std_error, z_value, p_value, by p-value.

    Features that never vary are left out; their coefficients are null, as all are below `least` rows.
    """
    used, weights, covariances = _fitted(data, folds, least)
    table: list[tuple] = [(f, None, None, None, None) for f in MODEL_FEATURES if f not in used]
    for i, f in enumerate(used, 1):
        value, error = float(weights[-1, i]), float(np.sqrt(max(0.0, covariances[-1, i, i])))
        z = value / error if error else None
        table.append((f, value, error, z, None if z is None else erfc(abs(z) / sqrt(2))))
    return data.sparkSession.createDataFrame(table, "feature string, coefficient double, std_error double, z_value double, p_value double").orderBy(F.asc_nulls_last("p_value"))


def _by_fold(weights: np.ndarray, used: list[str]) -> Column:
    """The chance that a row is frozen by the model of the other folds, a few numbers a fold."""
    told = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in weights])
    return 1 / (1 + F.exp(-_linear(F.get(told, F.col("fold")), used)))


def predictions(data: DataFrame, folds: int = 5, least: int = 50) -> DataFrame:
    """gw_award_id, label, fold, prediction of each row by the model of the other folds; no rows below `least` rows."""
    used, weights, _ = _fitted(data, folds, least)
    plain = model_data(data, folds)
    if not used:
        return plain.where("false").select("gw_award_id", "label", "fold", F.lit(0.0).alias("prediction"))
    return plain.select("gw_award_id", "label", "fold", _by_fold(weights, used).alias("prediction"))


def fitted_totals(data: DataFrame, folds: int = 5, least: int = 50) -> DataFrame:
    """(model, feature, total): the sum of chance x feature over the rows that a model was fitted to; model is the fold left out, or `folds` for none.

    Where the likelihood's slope is 0 this is the sum of the feature over the frozen rows, whatever the weights are.
    """
    used, weights, _ = _fitted(data, folds, least)
    plain = model_data(data, folds)
    if not used:
        return plain.where("false").select(F.col("fold").alias("model"), F.lit("").alias("feature"), F.lit(0.0).alias("total"))
    told = F.array(*[F.struct(F.lit(m).alias("m"), F.array(*[F.lit(float(v)) for v in w]).alias("w")) for m, w in enumerate(weights)])
    rows = plain.withColumn("_model", F.explode(told)).where("_model.m <> fold").withColumn("_p", 1 / (1 + F.exp(-_linear(F.col("_model.w"), used))))
    sums = rows.groupBy(F.col("_model.m").alias("model")).agg(F.sum("_p").alias("intercept"), *[F.sum(F.col("_p") * F.coalesce(F.col(f), F.lit(0.0))).alias(f) for f in used])
    return sums.unpivot("model", ["intercept", *used], "feature", "total")


def thresholds(predicted: DataFrame) -> DataFrame:
    """F1 of the predictions by threshold, 0.10 to 0.90."""
    steps = F.explode(F.transform(F.sequence(F.lit(2), F.lit(18)), lambda i: F.round(i * 0.05, 2))).alias("threshold")
    cells = predicted.select("label", "prediction", steps).groupBy("threshold").agg(*_counts(F.col("prediction") >= F.col("threshold"), F.col("label") == 1))
    return _scores(cells, 0.0)


def classifier(data: DataFrame, folds: int = 5, least: int = 50) -> dict[str, DataFrame] | None:
    """Logistic regression: cross-validated predictions, coefficients by p-value, F1 by threshold. None below `least` rows."""
    if model_data(data, folds).limit(least).count() < least:
        return None
    predicted = predictions(data, folds, least)
    return {"predictions": predicted, "coefficients": coefficients(data, least, folds), "thresholds": thresholds(predicted), "auc": auc(predicted)}
