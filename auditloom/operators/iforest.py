"""Isolation forest over window vectors (Liu, Ting and Zhou, 2008).

Fitting samples a bounded number of rows per tree and grows every tree in its
own group; scoring reads the node table as flat arrays inside Arrow batches.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom import schema as S
from auditloom.operators.ordering import quantiles
from auditloom.operators.windows import FeatureSchema
from auditloom.shipping import ship
from auditloom.sources.tables import load_schema, save_schema

NODES = "tree int, node int, feature int, cut double, left int, right int, depth int, size int"
EULER = 0.5772156649015329


# --- preprocessing -----------------------------------------------------------

@dataclass(frozen=True)
class Preprocessor:
    """Median imputation followed by standard scaling, one entry per feature."""

    median: list[float]
    mean: list[float]
    scale: list[float]

    def vector(self, features: Column) -> Column:
        """Scaled vector as a Catalyst expression."""
        parts = F.arrays_zip(
            features.alias("x"), F.lit(self.median).cast("array<double>").alias("median"),
            F.lit(self.mean).cast("array<double>").alias("mean"),
            F.lit(self.scale).cast("array<double>").alias("scale"))
        return F.transform(parts, lambda p: (
            F.coalesce(F.when(~F.isnan(p["x"]), p["x"]), p["median"]) - p["mean"]) / p["scale"])


def fit_preprocessor(df: DataFrame, features: str = "features", **limits: int) -> Preprocessor:
    """Exact medians, means and population deviations from one value histogram.

    Counting equal values first collapses the many zeros of count features on
    the map side; medians come from running counts, so no column is collected.
    """
    values = df.select(F.posexplode(features).alias("feature", "value"))
    clean = F.when(~F.isnan("value"), F.col("value"))
    counts = values.groupBy("feature", clean.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    medians = quantiles(counts, "value", [0.5], ["feature"], weight="n", **limits)
    filled = counts.join(F.broadcast(medians.select("feature", "quantile")), "feature", "left").select(
        "feature", "n", F.coalesce("value", "quantile", F.lit(0.0)).alias("value"),
        F.coalesce("quantile", F.lit(0.0)).alias("median"))
    # shifted sums: exact for constant columns, stable for the others
    shift = F.col("value") - F.col("median")
    moments = filled.groupBy("feature").agg(
        F.first("median").alias("median"), F.sum("n").alias("n"),
        F.sum(F.col("n") * shift).alias("s1"), F.sum(F.col("n") * shift * shift).alias("s2"))
    # one row per feature
    rows = moments.orderBy("feature").collect()
    if not rows:
        raise ValueError("no rows to fit")
    mean, scale = [], []
    for r in rows:
        offset = r["s1"] / r["n"]
        variance = max(r["s2"] / r["n"] - offset * offset, 0.0)
        deviation = math.sqrt(variance)
        mean.append(r["median"] + offset)
        scale.append(deviation if deviation > 1e-12 else 1.0)
    return Preprocessor([r["median"] for r in rows], mean, scale)


# --- trees -------------------------------------------------------------------

def expected_path(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def sample_rows(df: DataFrame, keys: list[str], trees: int, rows: int, total: int, seed: int) -> DataFrame:
    """About ``2 * rows`` candidates per tree leave the scan; the best ``rows`` are kept.

    Tickets are whole 64-bit hashes, so any number of rows is drawn from evenly.
    The choice depends only on row keys, tree and seed, so partitioning does not
    change it.
    """
    if total > 2 * rows * trees:
        # one hash a row: those under the rate are drawn, and a second hash deals them to the trees
        ticket = F.xxhash64(F.lit(seed), F.lit("draw"), *[F.col(k) for k in keys])
        below = min(int((2.0 * rows * trees / total) * 2.0**64) - 2**63, 2**63 - 1)
        tree = F.pmod(F.xxhash64(F.lit(seed), F.lit("tree"), *[F.col(k) for k in keys]), F.lit(trees)).cast("int")
        rows_per_tree = df.where(ticket < F.lit(below)).select(*keys, "vector", tree.alias("tree"), ticket.alias("ticket"))
    else:
        draw = [F.xxhash64(F.lit(seed), F.lit(t), *[F.col(k) for k in keys]) for t in ("a", "b")]
        tickets = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
            t.alias("tree"), F.xxhash64(draw[0], draw[1], t).alias("ticket")))
        below = min(int(min(1.0, 2.0 * rows / max(total, 1)) * 2.0**64) - 2**63, 2**63 - 1)
        chosen = F.filter(tickets, lambda x: x["ticket"] <= F.lit(below))
        rows_per_tree = df.select(*keys, "vector", F.explode(chosen).alias("_draw")).select(
            *keys, "vector", "_draw.tree", "_draw.ticket")
    order = Window.partitionBy("tree").orderBy("ticket", *keys)
    return rows_per_tree.withColumn("_rank", F.row_number().over(order)).where(
        F.col("_rank") <= rows).select("tree", "_rank", "vector")


def _grow(sample: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree over at most a few hundred rows."""
    nodes: list[list] = []
    todo = [(np.arange(len(sample)), 0, None, 0)]
    while todo:
        index, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, depth, len(index)])
        if parent is not None:
            nodes[parent][side] = me
        part = sample[index]
        usable = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(index) > 1 else []
        if depth >= limit or len(usable) == 0:
            continue
        feature = int(rng.choice(usable))
        column = part[:, feature]
        cut = float(rng.uniform(column.min(), column.max()))
        goes_left = column <= cut
        if goes_left.all():
            cut = float(np.max(column[column < column.max()]))
            goes_left = column <= cut
        nodes[me][1:3] = feature, cut
        todo.append((index[~goes_left], depth + 1, me, 4))
        todo.append((index[goes_left], depth + 1, me, 3))
    return nodes


@dataclass(frozen=True)
class IForestModel:
    nodes: pd.DataFrame
    preprocessor: Preprocessor
    sample_size: int
    offset: float
    schema: FeatureSchema | None = None

    def score(self, features: Column, spark: SparkSession) -> Column:
        """Normality (higher is more normal): minus the anomaly measure minus the offset."""
        trees = []
        for _, tree in self.nodes.sort_values("node").groupby("tree"):
            tail = [expected_path(n) if f < 0 else 0.0 for n, f in zip(tree["size"], tree["feature"], strict=True)]
            trees.append((tree["feature"].to_numpy(), tree["cut"].to_numpy(), tree["left"].to_numpy(),
                          tree["right"].to_numpy(), tree["depth"].to_numpy() + np.array(tail)))
        ship(spark)
        shared = spark.sparkContext.broadcast(trees)
        normal, offset = expected_path(self.sample_size), self.offset

        @F.pandas_udf("double")
        def normality(vectors: pd.Series) -> pd.Series:
            if len(vectors) == 0:
                return pd.Series([], dtype=float)
            x = np.stack(vectors.to_numpy())
            rows, total = np.arange(len(x)), np.zeros(len(x))
            for feature, cut, left, right, length in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    goes_left = x[rows, np.maximum(feature[at], 0)] <= cut[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                total += length[at]
            mean = total / len(shared.value)
            return pd.Series(-np.power(2.0, -mean / normal) - offset)

        return normality(self.preprocessor.vector(features))

    def transform(self, df: DataFrame, threshold: float = S.IFOREST_THRESHOLD,
                  features: str = "features") -> DataFrame:
        """Scored windows: normality, anomaly, native flag and threshold flag."""
        if threshold < 0:
            raise ValueError("threshold must not be negative")
        scored = df.withColumn("iforest_normality_score", self.score(F.col(features), df.sparkSession))
        return scored.withColumns({
            "iforest_anomaly_score": -F.col("iforest_normality_score"),
            "iforest_is_anomaly": (F.col("iforest_normality_score") < 0).cast("int"),
            "iforest_threshold": F.lit(float(threshold)),
            "iforest_threshold_alert": (-F.col("iforest_normality_score") >= threshold).cast("int"),
        })

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODES).write.parquet(f"{path}/nodes")
        p = self.preprocessor
        spark.createDataFrame(
            [(i, *row) for i, row in enumerate(zip(p.median, p.mean, p.scale, strict=True))],
            "feature int, median double, mean double, scale double").write.parquet(f"{path}/preprocessor")
        parameters = json.dumps({"sample_size": self.sample_size, "offset": self.offset})
        spark.createDataFrame([(parameters,)], "value string").coalesce(1).write.text(f"{path}/parameters")
        if self.schema:
            save_schema(spark, self.schema, f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str, with_schema: bool = True) -> IForestModel:
        nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").toPandas()
        rows = spark.read.parquet(f"{path}/preprocessor").orderBy("feature").collect()
        preprocessor = Preprocessor(*[[r[c] for r in rows] for c in ("median", "mean", "scale")])
        parameters = json.loads(spark.read.text(f"{path}/parameters").first()[0])
        schema = load_schema(spark, f"{path}/features") if with_schema else None
        return IForestModel(nodes, preprocessor, parameters["sample_size"], parameters["offset"], schema)


def fit_iforest(df: DataFrame, keys: list[str] | None = None, features: str = "features", trees: int = 300,
                max_samples: int = 256, contamination: str | float = "auto", seed: int = 42,
                schema: FeatureSchema | None = None, **limits: int) -> IForestModel:
    """Fit on benign windows. ``contamination`` is ``auto`` or a share in (0, 0.5]."""
    if contamination != "auto" and not 0.0 < contamination <= 0.5:
        raise ValueError("contamination must be 'auto' or in (0, 0.5]")
    if trees <= 0:
        raise ValueError("the number of trees must be positive")
    keys = ["source", "window_id"] if keys is None else keys
    preprocessor = fit_preprocessor(df, features, **limits)
    total = df.count()
    size = min(max_samples, total)
    vectors = df.select(*keys, preprocessor.vector(F.col(features)).alias("vector"))
    sample = sample_rows(vectors, keys, trees, size, total, seed)
    depth = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        rows = np.stack(group.sort_values("_rank")["vector"].to_numpy())
        nodes = _grow(rows, np.random.default_rng([seed, tree]), depth)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "depth", "size"])
        out.insert(0, "tree", tree)
        return out

    ship(df.sparkSession)
    # at most trees * (2 * max_samples - 1) nodes
    nodes = sample.groupBy("tree").applyInPandas(grow, NODES).toPandas()
    model = IForestModel(nodes, preprocessor, size, -0.5, schema)
    if contamination == "auto":
        return model
    raw = df.select((model.score(F.col(features), df.sparkSession) - 0.5).alias("raw"))
    offset = quantiles(raw, "raw", [float(contamination)], **limits).first()["quantile"]
    return IForestModel(nodes, preprocessor, size, offset, schema)


def anomaly_rate(df: DataFrame, by: str = "window_label") -> DataFrame:
    flag = F.col("iforest_is_anomaly")
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("windows"), F.sum(flag).alias("anomalies"), F.avg(flag).alias("rate"))
