"""Metrics, threshold sweeps and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.functions import metrics as M
from auditloom.functions import text as X
from auditloom.operators.fusion import window_scores
from auditloom.operators.ordering import order_rows, quantiles
from auditloom.operators.small import attach_row
from auditloom.sources.tables import require_columns

POSITIVE, NEGATIVE, EXCLUDED = ["malicious"], ["benign", "weak_benign", "unlabeled"], ["ambiguous"]
DETECTORS = {
    "LSTM only": "lstm_alert", "Isolation Forest only": "iforest_alert", "IF OR LSTM": "or_alert",
    "IF AND LSTM": "and_alert", "Weighted combined": "combined_alert",
}


def _number(name: str) -> Column:
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def window_eval_frame(df: DataFrame, positive: list[str] | None = None, negative: list[str] | None = None,
                      excluded: list[str] | None = None) -> DataFrame:
    """Labelled windows with ``y_true``; excluded and unknown labels are left out."""
    require_columns(df, ["window_label", "iforest_anomaly_score"], "scored windows")
    positive = POSITIVE if positive is None else positive
    negative = NEGATIVE if negative is None else negative
    excluded = EXCLUDED if excluded is None else excluded
    label = F.coalesce("window_label", F.lit("unlabeled"))
    kept = df.withColumn("window_label", label).where(
        ~F.col("window_label").isin(excluded) & F.col("window_label").isin(positive + negative))
    native = F.coalesce(F.col("iforest_is_anomaly").try_cast("int"), F.lit(0)) \
        if "iforest_is_anomaly" in df.columns else F.lit(0)
    return kept.withColumns({
        "y_true": F.col("window_label").isin(positive).cast("int"),
        "y_pred_default": native,
        "iforest_anomaly_score": _number("iforest_anomaly_score"),
    }).dropna(subset=["iforest_anomaly_score"])


def sequence_eval_frame(df: DataFrame, bounds: bool = False) -> DataFrame:
    """Sequences with a valid label, a numeric probability and ``y_true`` of 0 or 1."""
    needed = ["sequence_label", "y", "lstm_malicious_probability"]
    require_columns(df, needed + (["sequence_id", "start_us", "end_us"] if bounds else []), "scored sequences")
    kept = df.withColumns({
        "sequence_label": F.lower(X.stripped(F.col("sequence_label"))),
        "y_true": F.coalesce(F.col("y").try_cast("int"), F.lit(-1)),
        "lstm_malicious_probability": _number("lstm_malicious_probability"),
    }).where(F.col("sequence_label").isin("benign", "malicious") & F.col("y_true").isin(0, 1))
    return kept.dropna(subset=["lstm_malicious_probability"] + (["start_us", "end_us"] if bounds else []))


def window_score_frame(df: DataFrame, threshold: float = S.IFOREST_THRESHOLD) -> DataFrame:
    """Scored windows for joins to sequences; see :func:`fusion.window_scores`."""
    return window_scores(require_columns(df, ["window_label"], "scored windows"), threshold)


def confusion_metrics(df: DataFrame, predicted: str, truth: str = "y_true",
                      by: list[str] | None = None) -> DataFrame:
    counts = df.groupBy(*(by or [])).agg(*M.confusion(F.col(truth), F.col(predicted)))
    return counts.withColumns(M.rates())


def threshold_sweep(df: DataFrame, score: str, truth: str = "y_true", **limits: int) -> DataFrame:
    """Metrics at every distinct score, taken as ``score >= threshold``.

    Scores are counted once and the counts summed in descending order, so the
    work is one sort of the distinct scores.
    """
    y = F.col(truth)
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_n"))
    totals = counts.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("_all_p"),
                        F.coalesce(F.sum("_n"), F.lit(0)).alias("_all_n"))
    ordered = order_rows(counts, [], [F.desc("threshold")], **limits)
    ordered = ordered.running("sum", F.col("_p"), "tp").running("sum", F.col("_n"), "fp")
    swept = attach_row(ordered.result(), totals).withColumns({
        "fn": F.col("_all_p") - F.col("tp"), "tn": F.col("_all_n") - F.col("fp"),
        "predicted_positive": F.col("tp") + F.col("fp"),
    }).withColumns(M.rates())
    return swept.select("tp", "tn", "fp", "fn", *M.rates(), "threshold", "predicted_positive")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep row with the best F1, then recall, then precision, then threshold."""
    return sweep.orderBy(*[F.desc(c) for c in ("f1", "recall", "precision", "threshold")]).limit(1)


def mark_results(df: DataFrame, predicted: str, truth: str = "y_true", out: str = "eval_result") -> DataFrame:
    return df.withColumn(out, M.outcome(F.col(truth), F.col(predicted)))


def mark_all(df: DataFrame) -> DataFrame:
    """Outcome column per detector, named ``<detector>_result``."""
    for column in DETECTORS.values():
        df = mark_results(df, column, out=column.replace("_alert", "_result"))
    return df


def evaluate_at(df: DataFrame, threshold: float = S.SEQUENCE_THRESHOLD,
                score: str = "lstm_malicious_probability") -> DataFrame:
    """Prediction, outcome and error type of every row at one threshold."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    marked = df.withColumns({
        "eval_threshold": F.lit(float(threshold)),
        "eval_prediction": (F.col(score) >= threshold).cast("int"),
    })
    marked = mark_results(marked, "eval_prediction")
    return marked.withColumns({
        "eval_prediction_label": F.when(F.col("eval_prediction") == 1, "malicious").otherwise("benign"),
        "error_type": F.when(F.col("eval_result").isin("fp", "fn"), F.col("eval_result")).otherwise(""),
    })


def errors(df: DataFrame, n: int | None = None, score: str = "lstm_malicious_probability",
           tie: list[str] | None = None) -> DataFrame:
    """Wrong rows of :func:`evaluate_at`, the most confident first."""
    confidence = F.when(F.col("error_type") == "fp", F.col(score)).otherwise(1.0 - F.col(score))
    wrong = df.where("error_type <> ''").withColumn("error_confidence", confidence)
    ranked = wrong.orderBy(F.desc("error_confidence"), *(tie or ["sequence_id"]))
    return ranked if n is None else ranked.limit(n)


def compare_detectors(df: DataFrame, truth: str = "y_true") -> DataFrame:
    """Confusion metrics of all detectors, one row each."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("detector"), F.col(column).alias("_predicted"))
        for name, column in DETECTORS.items()])
    return confusion_metrics(df.select(truth, F.inline(rows)), "_predicted", truth, ["detector"])


def binary_metrics(df: DataFrame, score: str = "lstm_malicious_probability", truth: str = "y_true",
                   threshold: float = S.SEQUENCE_THRESHOLD, **limits: int) -> DataFrame:
    """Accuracy, precision, recall, F1 and exact ROC AUC (null with one class only).

    The AUC is the share of positive-negative pairs in the right order, ties
    counting half, from running counts over the distinct scores.
    """
    y = F.col(truth)
    counts = df.groupBy(F.col(score).alias("_score")).agg(
        F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_n"))
    below = order_rows(counts, [], ["_score"], **limits).running("sum", F.col("_n"), "_below", before=True).df
    hit = F.col("_score") >= threshold

    def total(value: Column, condition: Column | None = None) -> Column:
        value = value if condition is None else F.when(condition, value)
        return F.coalesce(F.sum(value), F.lit(0))

    won = F.col("_p").cast("double") * (F.col("_below") + F.col("_n") * 0.5)
    sums = below.agg(
        total(F.col("_p"), hit).alias("tp"), total(F.col("_n"), ~hit).alias("tn"),
        total(F.col("_n"), hit).alias("fp"), total(F.col("_p"), ~hit).alias("fn"), F.sum(won).alias("_won"))
    pairs = (F.col("tp") + F.col("fn")).cast("double") * (F.col("tn") + F.col("fp"))
    return sums.withColumns(M.rates()).select(
        "accuracy", "precision", "recall", "f1", F.try_divide("_won", pairs).alias("roc_auc"))


def calibrate(benign: DataFrame, rates: list[float] | None = None,
              score: str = "iforest_anomaly_score", **limits: int) -> DataFrame:
    """Threshold per target false-positive rate: the exact ``1 - rate`` quantile of benign scores."""
    rates = S.CALIBRATION_RATES if rates is None else rates
    if not rates or not all(0.0 < r < 1.0 for r in rates):
        raise ValueError("false-positive rates must be in (0, 1)")
    scored = benign.select(_number(score).alias(score)).dropna()
    target = {1.0 - r: r for r in rates}
    found = quantiles(scored, score, list(target), **limits)
    names = F.create_map(*[F.lit(float(x)) for kv in target.items() for x in kv])
    thresholds = found.select(names[F.col("probability")].alias("target_fpr"), F.col("quantile").alias("threshold"))
    counted = counts_at(scored.withColumn("_y", F.lit(0)), thresholds, score, "_y", **limits)
    return counted.select(*thresholds.columns, F.col("_all").alias("benign_windows"), F.col("fp").alias("benign_flagged")).withColumn(
        "actual_fpr", M.ratio(F.col("benign_flagged"), F.col("benign_windows")))


def counts_at(df: DataFrame, thresholds: DataFrame, score: str, truth: str = "y_true", **limits: int) -> DataFrame:
    """Threshold rows with ``tp, fp, tn, fn`` of ``score >= threshold``, for any number of thresholds.

    Scores and thresholds run down one order in which a threshold follows the
    scores equal to it, and the running counts are read off at the thresholds.
    """
    y, columns = F.col(truth), thresholds.columns
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_at")).agg(
        F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_n"))
    marks = thresholds.select(
        F.col("threshold").cast("double").alias("_at"), F.lit(0).cast("bigint").alias("_p"), F.lit(0).cast("bigint").alias("_n"),
        F.struct(*columns).alias("_given"))
    both = counts.withColumn("_given", F.lit(None).cast(marks.schema["_given"].dataType)).unionByName(marks)
    both = both.withColumn("_is_mark", F.col("_given").isNotNull().cast("int"))
    ordered = order_rows(both, [], [F.desc("_at"), "_is_mark"], **limits)
    ordered = ordered.running("sum", F.col("_p"), "tp").running("sum", F.col("_n"), "fp")
    totals = df.agg(F.count_if(y == 1).alias("_all_p"), F.count_if(y == 0).alias("_all_n"), F.count(F.lit(1)).alias("_all"))
    found = attach_row(ordered.result().where("_is_mark = 1"), totals)
    return found.withColumns({"tn": F.col("_all_n") - F.col("fp"), "fn": F.col("_all_p") - F.col("tp")}).select(
        "_given.*", "_all", "tp", "fp", "tn", "fn")


def evaluate_thresholds(thresholds: DataFrame, labelled: DataFrame,
                        score: str = "iforest_anomaly_score", **limits: int) -> DataFrame:
    """Calibrated thresholds with the metrics they reach on labelled scores."""
    found = counts_at(labelled, thresholds, score, **limits).withColumnRenamed("_all", "eval_windows").withColumns(M.rates())
    return found.withColumnRenamed("fpr", "eval_fpr").drop("tnr", "accuracy").withColumn(
        "eval_predicted_positive", F.col("tp") + F.col("fp"))


def rank_by_score(df: DataFrame, score: str, n: int | None = None, tie: list[str] | None = None) -> DataFrame:
    ranked = df.orderBy(F.desc(score), *(tie or []))
    return ranked if n is None else ranked.limit(n)
