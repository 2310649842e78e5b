"""Score sketches against exact quantiles, distinct sketches against sets, counts taken on the way."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.operators import anchor as C
from auditloom.operators import sketches as K


def sketch_rows(df):
    return sorted(map(tuple, df.collect()))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.floats(-1, 1), st.sampled_from([0.0, 0.25, 2.0 ** -31, -0.25, 5e-324, 1e300, -1e300])), min_size=1, max_size=200))
def test_thresholds_keep_their_bounds(spark, scores):
    rates = [0.01, 0.3, 0.9]
    df = spark.createDataFrame([("h", s) for s in scores], "source string, iforest_anomaly_score double")
    found = K.sketched_thresholds(K.score_sketch(df), rates).collect()
    assert sorted(r["target_fpr"] for r in found) == rates
    for r in found:
        flagged = sum(s >= r["threshold"] for s in scores)
        assert r["rows"] == len(scores) and r["flagged_least"] <= flagged <= r["flagged_most"]
        assert abs(flagged / len(scores) - r["target_fpr"]) <= r["rank_error"] + 1e-12


def test_cells_rise_with_scores(spark):
    import random

    random.seed(1)
    values = sorted({random.uniform(-1, 1) * 10 ** random.randint(-12, 3) for _ in range(3000)} | {2.0 ** k for k in range(-40, 10)} | {-(2.0 ** k) for k in range(-40, 10)})
    cells = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(K.score_cell(F.col("v"))).collect()]
    assert cells == sorted(cells) and len(set(cells)) > 2000


def test_sketches_merge_and_ignore_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("source"), (F.sin("id") / 2).alias("iforest_anomaly_score"), "id")
    whole = sketch_rows(K.score_sketch(df))
    assert whole == sketch_rows(K.score_sketch(df.repartition(7)))
    parts = [K.score_sketch(df.where(F.col("id") % 4 == i)) for i in range(4)]
    assert whole == sketch_rows(K.merge_sketches(*parts))
    all_hosts = K.score_sketch(df.withColumn("source", F.lit("all")))
    assert [r[1:] for r in sketch_rows(all_hosts)] == sketch_rows(K.merge_sketches(*parts, by=[]))


def test_bad_scores_and_rates(spark):
    df = spark.createDataFrame([("h", None), ("h", float("nan"))], "source string, iforest_anomaly_score double")
    assert K.sketched_thresholds(K.score_sketch(df)).collect() == []
    with pytest.raises(ValueError, match="rates"):
        K.sketched_thresholds(K.score_sketch(df), [1.5])
    with pytest.raises(ValueError, match="factor"):
        K.widen(df, 0)


def test_large_distinct_counts_stay_within_their_error(spark):
    from auditloom import schema as S

    names = {c: F.lit("").alias(c) for c in S.DISTINCT_FIELDS}
    names["comm"] = F.concat(F.lit("c"), (F.col("id") % 60_000).cast("string")).alias("comm")
    events = spark.range(200_000).select(F.lit("h").alias("source"), (F.col("id") % 8).alias("window_id"), *names.values())
    narrow = K.distinct_sketches(events)
    for factor in (1, 4, 8):
        exact = {r[0]: r[1] for r in events.groupBy(F.floor(F.col("window_id") / factor)).agg(F.count_distinct("comm")).collect()}
        found = {r["window_id"]: r["estimate"] for r in K.distinct_estimates(K.widen(narrow, factor)).collect()}
        assert set(found) == set(exact) and all(abs(found[w] - n) <= 4 * 1.04 / 64 * n for w, n in exact.items())


def test_counts_taken_while_writing(spark, tmp_path):
    """The observation sits in the plan that writes; nothing reads the events for it again."""
    rows = [(p,) for p in ["outside", "attack_window", "pre_context", "outside", "post_context"]]
    df = spark.createDataFrame(rows, "anchor_phase string")
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = df.repartition(2).mapInArrow(passed, df.schema)
    seen = C.write_anchored(watched, str(tmp_path / "t"))
    assert seen == C.anchor_stats(df).first().asDict() and read.value == 5
    assert C.write_anchored(df.where("false"), str(tmp_path / "e"))["events"] == 0
