import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import iforest as I
from auditloom.operators import seqmodel as Q


def vectors(spark, n=600, parts=4):
    random.seed(5)
    rows = [("h", i, [random.gauss(0, 1), random.gauss(5, 2), 3.0]) for i in range(n)]
    rows += [("h", n + i, [30.0 + i, -40.0, 3.0]) for i in range(3)]
    return spark.createDataFrame(rows, "source string, window_id bigint, features array<double>").repartition(parts)


def scores(model, df):
    return {r["window_id"]: r["iforest_anomaly_score"] for r in model.transform(df).collect()}


def test_planted_outliers_rank_first(spark, tmp_path):
    df = vectors(spark)
    benign = df.where("window_id < 600")
    model = I.fit_iforest(benign, trees=60)
    found = scores(model, df)
    assert all(-0.5 < s <= 0.5 for s in found.values())
    assert set(sorted(found, key=found.get)[-3:]) == {600, 601, 602}
    assert (model.nodes.groupby("tree")["size"].max() == 256).all() and model.nodes["tree"].nunique() == 60
    again = I.fit_iforest(vectors(spark, parts=11).where("window_id < 600"), trees=60)
    other = scores(again, df)
    assert all(abs(found[k] - other[k]) < 1e-12 for k in found)
    model.save(spark, str(tmp_path / "m"))
    loaded = I.IForestModel.load(spark, str(tmp_path / "m"), with_schema=False)
    assert scores(loaded, df) == found


def test_contamination_flags_that_share(spark):
    df = vectors(spark, 400)
    model = I.fit_iforest(df, trees=30, contamination=0.1)
    assert model.transform(df).agg(F.sum("iforest_is_anomaly")).first()[0] == pytest.approx(40, abs=2)
    with pytest.raises(ValueError, match="contamination"):
        I.fit_iforest(df, contamination=0.6)


@pytest.mark.parametrize("limits", [{}, {"max_group_rows": 5, "chunk_rows": 3}])
def test_preprocessor_matches_numpy(spark, limits):
    rows = [[random.choice([0.0, 1.0, 2.5, 7.0]), random.random(), 4.0] for _ in range(51)] + [[None, float("nan"), 4.0]]
    df = spark.createDataFrame([(r,) for r in rows], "features array<double>")
    found = I.fit_preprocessor(df, **limits)
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    median = np.nanmedian(x, axis=0)
    filled = np.where(np.isnan(x), median, x)
    deviation = filled.std(axis=0)
    assert np.allclose(found.median, median) and np.allclose(found.mean, filled.mean(axis=0))
    assert np.allclose(found.scale, np.where(deviation == 0, 1, deviation))


def sequences(spark, n=120):
    random.seed(2)
    rows = []
    for i in range(n):
        y = int(i % 4 == 0)
        x_num = [[random.random() + 2 * y] + [0.0] * 11 for _ in range(4)]
        x_cat = [[2 + y] * 7 for _ in range(4)]
        rows.append((i, f"run{i % 17}", x_cat, x_num, y))
    return spark.createDataFrame(
        rows, "sequence_id bigint, segment_id string, x_cat array<array<int>>, x_num array<array<float>>, y int")


def test_group_split_keeps_groups_whole(spark):
    df = sequences(spark)
    split = Q.group_split(df, share=0.25, seed=1)
    sides = split.groupBy("segment_id").agg(F.count_distinct("is_validation").alias("n"), F.max("is_validation").alias("v")).collect()
    assert all(r["n"] == 1 for r in sides) and sum(r["v"] for r in sides) == 5
    again = Q.group_split(df.repartition(7), share=0.25, seed=1, max_group_rows=2, chunk_rows=2)
    assert split.where("is_validation").count() == again.where("is_validation").count()
    assert split.join(again, "sequence_id").where(split.is_validation != again.is_validation).count() == 0
    with pytest.raises(ValueError, match="single-class"):
        Q.group_split(df.withColumn("y", F.lit(0)))


def test_classifier_learns_and_reloads(spark, tmp_path):
    df = sequences(spark)
    model = Q.fit_sequence_classifier(df)
    scored = Q.score_sequences(df, model)
    assert scored.where("lstm_prediction = y").count() == 120
    model.save(spark, str(tmp_path / "m"))
    loaded = Q.score_sequences(df, Q.SequenceModel.load(spark, str(tmp_path / "m")), threshold=1.0)
    assert loaded.agg(F.max("lstm_prediction")).first()[0] == 0
    mean, scale = Q.fit_scaler(df)[0]
    values = np.array([s[0] for r in df.collect() for s in r["x_num"]], dtype=float)
    assert mean == pytest.approx(values.mean()) and scale == pytest.approx(values.std())
    assert Q.fit_scaler(df)[3] == (0.0, 1.0)


def test_external_model_hook(spark):
    def make():
        def predict(tokens, numbers):
            return (tokens[:, 0, 0] - 2) * 0.5 + (numbers.mean(axis=(1, 2)) > 0.1) * 0.25
        return predict

    df = sequences(spark)
    scored = Q.score_with(df, make, 4, 0.5)
    assert scored.where("lstm_prediction = y").count() == 120


def test_events_inside_alerts_are_counted_without_a_join_on_hosts_alone(spark):
    from checks.model_queries import events_inside

    spans = [("a", 0, 10, 20), ("a", 1, 15, 4_000_000), ("a", 2, 21, 24), ("b", 0, 10, 10)]
    points = [("a", t) for t in (9, 10, 15, 20, 20, 25, 4_000_000)] + [("b", 10), ("c", 10)]
    alerts = spark.createDataFrame(spans, "source string, alert_id long, start_us long, end_us long")
    events = spark.createDataFrame(points, "source string, ts_us long")
    found = events_inside(alerts, events)
    want = {(s, i): n for s, i, low, high in spans if (n := sum(p == s and low <= t <= high for p, t in points))}
    assert {(r["source"], r["alert_id"]): r["n"] for r in found.collect()} == want
    join = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
    assert join and all("_bucket" in line for line in join)
