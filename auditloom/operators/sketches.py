"""Mergeable summaries: score distributions with a stated rank error, and distinct counts that roll up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom import schema as S
from auditloom.functions import text as X

STEPS = 4096         # cells between a power of two and the next
LEAST_POWER = -30    # smaller scores share the cell of zero
HLL_BITS = 12


def score_cell(score: Column) -> Column:
    """A whole number that does not fall as the score rises; a cell spans a 4096th of a power of two."""
    size = F.abs(score)
    power = F.greatest(F.floor(F.log2(size)), F.lit(LEAST_POWER))
    step = F.floor((size / F.pow(F.lit(2.0), power) - 1) * STEPS)
    cell = (power - LEAST_POWER) * STEPS + F.least(F.greatest(step, F.lit(0)), F.lit(STEPS - 1)) + 1
    return F.when(size < 2.0 ** LEAST_POWER, F.lit(0)).otherwise(F.signum(score).cast("int") * cell).cast("bigint")


def score_sketch(df: DataFrame, score: str = "iforest_anomaly_score", by: list[str] | None = None) -> DataFrame:
    """``(by..., cell, n, low, high)``: how many scores lie in each cell, its least and its greatest.

    The cells are fixed, so a sketch depends on the scores alone, not on how they
    were partitioned, and sketches merge without loss. Its size is bounded by the
    range of the scores, not by their number: 4096 cells for each power of two.
    Scores that are no numbers do not count.
    """
    by = ["source"] if by is None else by
    value = X.number_or(F.col(score), None)
    rows = df.select(*by, value.alias("_score")).where("_score IS NOT NULL")
    return rows.groupBy(*by, score_cell(F.col("_score")).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_score").alias("low"), F.max("_score").alias("high"))


def merge_sketches(*sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One sketch of all rows behind the given ones; fewer group columns roll groups up."""
    by = ["source"] if by is None else by
    rows = sketches[0]
    for other in sketches[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def sketched_thresholds(sketch: DataFrame, rates: list[float] | None = None, by: list[str] | None = None) -> DataFrame:
    """Threshold per group and target false-positive rate, with bounds of what it flags.

    The threshold is the greatest score of the cell in which the target share is
    reached from above, so ``score >= threshold`` flags between ``flagged_least``
    and ``flagged_most`` of the ``rows`` scores. ``rank_error`` is the share that
    lies in that cell: neither the flagged share nor the threshold's rank is
    further than that from the target. It is 0 where all scores of the cell are
    equal and the cell ends at the target.
    """
    by = ["source"] if by is None else by
    rates = S.CALIBRATION_RATES if rates is None else rates
    if not rates or not all(0.0 < r < 1.0 for r in rates):
        raise ValueError("false-positive rates must be in (0, 1)")
    down = Window.partitionBy(*by).orderBy(F.desc("cell"))
    rows = sketch.withColumns({"_through": F.sum("n").over(down), "rows": F.sum("n").over(Window.partitionBy(*by))})
    targets = rows.withColumn("target_fpr", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    reached = targets.where((F.col("_through") >= F.col("target_fpr") * F.col("rows")) & (F.col("_through") - F.col("n") < F.col("target_fpr") * F.col("rows")))
    above, one = F.col("_through") - F.col("n"), F.col("low") == F.col("high")
    return reached.select(
        *by, "target_fpr", F.col("high").alias("threshold"), "rows",
        F.when(one, F.col("_through")).otherwise(above + 1).alias("flagged_least"), F.col("_through").alias("flagged_most"),
        (F.when(one, F.col("_through") - F.col("target_fpr") * F.col("rows")).otherwise(F.col("n")) / F.col("rows")).alias("rank_error"))


def distinct_sketches(events: DataFrame, by: list[str] | None = None, bits: int = HLL_BITS) -> DataFrame:
    """``(by..., window_id, field, sketch)``: one cardinality sketch of the non-blank values of every field and window."""
    by = ["source"] if by is None else by
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in S.DISTINCT_FIELDS])
    rows = events.select(*by, "window_id", F.inline(fields)).where("value <> ''")
    return rows.groupBy(*by, "window_id", "field").agg(F.hll_sketch_agg("value", F.lit(bits)).alias("sketch"))


def widen(sketches: DataFrame, factor: int, by: list[str] | None = None) -> DataFrame:
    """Sketches of windows ``factor`` times as wide, from those of the narrow ones; no event is read again."""
    if factor < 1:
        raise ValueError("the factor must be positive")
    by = ["source"] if by is None else by
    wide = F.floor(F.col("window_id") / factor).cast("bigint")
    return sketches.groupBy(*by, wide.alias("window_id"), "field").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., window_id, field, estimate)``; the relative standard error is about 1.04 / sqrt(2 ** bits)."""
    by = ["source"] if by is None else by
    return sketches.select(*by, "window_id", "field", F.hll_sketch_estimate("sketch").alias("estimate"))
