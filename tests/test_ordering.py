"""Ordered operators against brute force, for the plain and the range-partitioned way."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.operators import intervals
from auditloom.operators.intervals import lookup_segment, overlap_pairs
from auditloom.operators.ordering import order_rows, quantiles

LIMITS = [{}, {"max_group_rows": 50, "chunk_rows": 37}]


@pytest.fixture(scope="module")
def rows():
    random.seed(1)
    # one group holds 40 % of all rows
    return [(f"h{0 if random.random() < .4 else random.randint(1, 5)}", random.randint(0, 300), i, random.random())
            for i in range(2000)]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("parts", [1, 7])
def test_running_values(spark, rows, limits, parts):
    df = spark.createDataFrame(rows, "s string, t bigint, id bigint, v double").repartition(parts)
    o = order_rows(df, ["s"], ["t", "id"], **limits)
    assert o.spans == bool(limits)
    seventh = F.when(F.col("id") % 7 == 0, F.col("id"))
    o = (o.lag(F.col("t"), "prev").running("max", F.col("v"), "high", before=True)
         .running("sum", F.col("t"), "total").running("last", seventh, "seen"))
    p = o.df.toPandas().sort_values(["s", "_pos"])
    e = pd.DataFrame(rows, columns=["s", "t", "id", "v"]).sort_values(["s", "t", "id"])
    g = e.groupby("s")
    assert p.id.tolist() == e.id.tolist() and p._pos.tolist() == g.cumcount().tolist()
    assert p.prev.fillna(-1).tolist() == g.t.shift().fillna(-1).tolist()
    assert p.total.tolist() == g.t.cumsum().tolist()
    assert p.high.fillna(-1).tolist() == g.v.cummax().groupby(e.s).shift().fillna(-1).tolist()
    assert p.seen.fillna(-1).tolist() == e.id.where(e.id % 7 == 0).groupby(e.s).ffill().fillna(-1).tolist()


@pytest.mark.parametrize("limits", LIMITS)
def test_quantiles(spark, rows, limits):
    df = spark.createDataFrame(rows, "s string, t bigint, id bigint, v double")
    e = pd.DataFrame(rows, columns=["s", "t", "id", "v"])
    wanted = [0.0, .1, .5, .999, 1.0]
    q = quantiles(df, "v", wanted, ["s"], **limits).toPandas().sort_values(["s", "probability"])
    assert q["quantile"].tolist() == pytest.approx(e.groupby("s").v.quantile(wanted).tolist())
    assert quantiles(df, "v", [.25], **limits).first()["quantile"] == pytest.approx(e.v.quantile(.25))


def test_overlap_pairs_of_mixed_lengths(spark):
    random.seed(2)

    def some():
        return [(f"h{random.randint(0, 1)}", i, s := random.randint(0, 10**9), s + random.choice([0, 10**3, 10**6, 5 * 10**7, 9 * 10**8]))
                for i in range(250)]

    a, b = some(), some()
    left = spark.createDataFrame(a, "s string, i bigint, a0 bigint, a1 bigint")
    right = spark.createDataFrame(b, "s string, j bigint, b0 bigint, b1 bigint")
    got = sorted((r["i"], r["j"]) for r in overlap_pairs(left, right, ["s"], ("a0", "a1"), ("b0", "b1")).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] <= x[3] and y[3] >= x[2])


@pytest.mark.parametrize("limits", [{}, {"limit": 10}, {"limit": 10, "max_group_rows": 50, "chunk_rows": 37}])
def test_lookup_segment(spark, limits):
    random.seed(3)
    segments = []
    for s in "xy":
        at = 0
        for i in range(150):
            low = at + random.randint(0, 50)
            segments.append((s, low, high := low + random.choice([0, 1, 5, 300]), f"{s}{i}"))
            at = high + 1
    # a third of the points share one instant
    points = [(random.choice("xyz"), 700 if i % 3 == 0 else random.randint(-5, 15000), i) for i in range(1500)]
    found = lookup_segment(
        spark.createDataFrame(points, "s string, t bigint, id bigint"),
        spark.createDataFrame(segments, "s string, lo bigint, hi bigint, name string"), ["s"], "t", "lo", "hi", **limits)
    got = {r["id"]: r["name"] for r in found.collect()}
    assert got == {p[2]: next((x[3] for x in segments if x[0] == p[0] and x[1] <= p[1] <= x[2]), None) for p in points}


def test_many_segments_meet_points_on_shelves(spark, monkeypatch):
    """A segment table too large to broadcast whole: neither a sort of all points nor a struct of their columns."""
    monkeypatch.setattr(intervals, "SHELF_ROWS", 4)
    monkeypatch.setattr(intervals, "_lookup_by_order", None)
    rng = random.Random(5)
    segments, points = [], []
    for g in ("a", "b", ""):
        at = 0
        for i in range(40):
            low = at + rng.randrange(1, 9)
            at = low + rng.randrange(0, 9)
            segments.append((g, low, at, f"{g}{i}"))
    for i in range(3000):
        points.append((rng.choice(["a", "b", "", None, "none"]), rng.choice([None, *range(-5, 500)]), i))
    found = lookup_segment(
        spark.createDataFrame(points, "g string, t long, n long"), spark.createDataFrame(segments, "g string, lo long, hi long, name string"),
        ["g"], "t", "lo", "hi", limit=60)
    def owner(g, t):
        return next((s[3] for s in segments if t is not None and s[0] == (g or "") and s[1] <= t <= s[2]), None)
    assert sorted((r["n"], r["name"]) for r in found.collect()) == [(n, owner(g, t)) for g, t, n in points]
    used = found.select("n", "name")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in used
