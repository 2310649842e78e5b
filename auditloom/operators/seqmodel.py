"""Supervised scoring of event sequences with MLlib."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from auditloom import schema as S
from auditloom.operators.ordering import number_rows
from auditloom.operators.small import attach, attach_row
from auditloom.session import materialise
from auditloom.shipping import ship

# a weight for every token is kept in the driver while the model is fitted
MAX_TOKENS = 1 << 18


def group_split(df: DataFrame, group: str = "segment_id", share: float = 0.25, seed: int = 42,
                label: str | None = "y", **limits: int) -> DataFrame:
    """Mark whole groups as validation rows in ``is_validation``.

    ``ceil(share * groups)`` groups are drawn by a seeded hash, so a group is
    never on both sides. With ``label``, a side holding one class only is an error.
    """
    if not 0.0 < share < 1.0:
        raise ValueError("the validation share must be between 0 and 1")
    groups = materialise(df.select(group).distinct(), "groups")  # three passes read them
    drawn = number_rows(groups.withColumn("_draw", F.xxhash64(F.lit(seed), F.col(group).cast("string"))),
                        [], ["_draw", group], "_place", **limits)
    wanted = groups.agg(F.ceil(F.count(F.lit(1)) * F.lit(share)).alias("_wanted"))
    marks = attach_row(drawn, wanted).select(group, (F.col("_place") < F.col("_wanted")).alias("is_validation"))
    split = attach(df, marks, [group])
    if label:
        classes = {r["is_validation"]: r["n"] for r in split.groupBy("is_validation").agg(
            F.count_distinct(label).alias("n")).collect()}
        if classes.get(True, 0) < 2 or classes.get(False, 0) < 2:
            raise ValueError("group split produced a single-class train or validation set")
    return split


def fit_scaler(df: DataFrame, features: str = "x_num") -> list[tuple[float, float]]:
    """Population mean and deviation per numeric feature over all steps; tiny deviations become 1."""
    steps = df.select(F.explode(features).alias("step"))
    names = range(len(S.NUMERIC_COLUMNS))
    # one row: fixed-size sums only
    row = steps.agg(*[F.avg(F.col("step")[i].cast("double")).alias(f"m{i}") for i in names],
                    *[F.stddev_pop(F.col("step")[i].cast("double")).alias(f"s{i}") for i in names]).first()
    return [(row[f"m{i}"], row[f"s{i}"] if row[f"s{i}"] >= 1e-6 else 1.0) for i in names]


def apply_scaler(features: Column, scaler: list[tuple[float, float]]) -> Column:
    mean = F.lit([m for m, _ in scaler]).cast("array<double>")
    scale = F.lit([s for _, s in scaler]).cast("array<double>")
    return F.transform(features, lambda step: F.zip_with(
        F.zip_with(step, mean, lambda x, m: x - m), scale, lambda x, s: x / s))


def pooled(df: DataFrame, scaler: list[tuple[float, float]]) -> DataFrame:
    """Fixed-size view of a sequence: mean, maximum and last step, and its token bag."""
    size = len(S.NUMERIC_COLUMNS)
    steps = df.withColumn("_steps", apply_scaler(F.col("x_num"), scaler))
    zero = F.array(*[F.lit(0.0)] * size)
    total = F.aggregate("_steps", zero, lambda a, s: F.zip_with(a, s, lambda x, y: x + y))
    highest = F.aggregate("_steps", F.array(*[F.lit(-1e300)] * size),
                          lambda a, s: F.zip_with(a, s, lambda x, y: F.greatest(x, y)))
    count = F.greatest(F.size("_steps"), F.lit(1))
    numeric = F.concat(F.transform(total, lambda x: x / count), highest, F.element_at("_steps", -1))
    tokens = F.flatten(F.transform("x_cat", lambda s: F.transform(
        s, lambda t, i: F.concat(i.cast("string"), F.lit(":"), t.cast("string")))))
    return steps.withColumns({"_numeric": array_to_vector(numeric), "_tokens": tokens}).drop("_steps")


@dataclass(frozen=True)
class SequenceModel:
    pipeline: PipelineModel
    scaler: list[tuple[float, float]]
    threshold: float = S.SEQUENCE_THRESHOLD

    def probability(self, df: DataFrame) -> DataFrame:
        """Rows with the probability of being malicious."""
        scored = self.pipeline.transform(pooled(df, self.scaler))
        return scored.withColumn(
            "lstm_malicious_probability", vector_to_array("probability")[1]).select(
            *df.columns, "lstm_malicious_probability")

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().save(f"{path}/pipeline")
        parameters = json.dumps({"scaler": self.scaler, "threshold": self.threshold})
        spark.createDataFrame([(parameters,)], "value string").coalesce(1).write.text(f"{path}/parameters")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SequenceModel:
        parameters = json.loads(spark.read.text(f"{path}/parameters").first()[0])
        return SequenceModel(PipelineModel.load(f"{path}/pipeline"),
                             [tuple(p) for p in parameters["scaler"]], parameters["threshold"])


def fit_sequence_classifier(train: DataFrame, threshold: float = S.SEQUENCE_THRESHOLD,
                            max_iter: int = 50, reg: float = 1e-3, max_tokens: int = MAX_TOKENS) -> SequenceModel:
    """Logistic regression over pooled sequences, positives weighted by negatives / positives.

    Every token that training has met gets a weight of its own. More than
    ``max_tokens`` of them are an error; none is left out.
    """
    counts = train.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    scaler = fit_scaler(train)
    weight = F.when(F.col("y") == 1, F.lit(counts["n"] / max(counts["p"], 1))).otherwise(1.0)
    rows = pooled(train, scaler).select(
        F.col("y").cast("double").alias("y"), weight.alias("_weight"), "_numeric", "_tokens")
    tokens = max(1, rows.select(F.explode("_tokens").alias("token")).agg(F.count_distinct("token")).first()[0])
    if tokens > max_tokens:
        raise ValueError(f"{tokens} different tokens, more than {max_tokens}: learn a smaller vocabulary or allow more")
    pipeline = Pipeline(stages=[
        # a declared size spares the assembler a look at the first row
        VectorSizeHint(inputCol="_numeric", size=3 * len(S.NUMERIC_COLUMNS)),
        CountVectorizer(inputCol="_tokens", outputCol="_bag", minDF=1.0, vocabSize=tokens),
        VectorAssembler(inputCols=["_numeric", "_bag"], outputCol="_input"),
        LogisticRegression(featuresCol="_input", labelCol="y", weightCol="_weight",
                           maxIter=max_iter, regParam=reg),
    ])
    return SequenceModel(pipeline.fit(rows), scaler, threshold)


def with_predictions(df: DataFrame, threshold: float) -> DataFrame:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    hit = F.col("lstm_malicious_probability") >= threshold
    return df.withColumns({
        "lstm_prediction": hit.cast("int"),
        "lstm_prediction_label": F.when(hit, "malicious").otherwise("benign"),
        "lstm_threshold": F.lit(float(threshold)),
    })


def score_sequences(df: DataFrame, model: SequenceModel, threshold: float | None = None) -> DataFrame:
    """Probability, prediction and label per sequence; the model's threshold unless given."""
    return with_predictions(model.probability(df), model.threshold if threshold is None else threshold)


def score_with(df: DataFrame, make_predict: Callable[[], Callable], length: int, threshold: float,
               batch_size: int = 256) -> DataFrame:
    """Score with any model: ``make_predict`` loads it once per Python worker.

    The function it returns takes ``(tokens [n, length, 7], numbers [n, length, 12])``
    and returns one probability per row.
    """
    if batch_size <= 0:
        raise ValueError("the batch size must be positive")
    ship(df.sparkSession)
    predict = predict_batch_udf(
        make_predict, return_type=DoubleType(), batch_size=batch_size,
        input_tensor_shapes=[[length, len(S.TOKEN_COLUMNS)], [length, len(S.NUMERIC_COLUMNS)]])
    tokens = F.flatten("x_cat").cast("array<double>")
    numbers = F.flatten("x_num").cast("array<double>")
    return with_predictions(df.withColumn("lstm_malicious_probability", predict(tokens, numbers)), threshold)
