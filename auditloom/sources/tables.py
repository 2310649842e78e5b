"""Delimited and Parquet tables with a column contract, and the artefacts built from them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.windows import FeatureSchema, schema_frame, with_defaults


def require_columns(df: DataFrame, required: list[str], what: str = "table") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def read_table(spark: SparkSession, path: str | list[str], required: list[str] | None = None,
               optional: list[str] | None = None, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """Read a table; CSV columns are text and blanks stand for missing values.

    Values may hold line breaks, which makes each CSV file the work of one task.
    ``multi_line=False`` splits large files whose values hold none.
    """
    if fmt == "csv":
        df = spark.read.option("multiLine", multi_line).csv(path, header=True, escape='"', inferSchema=False)
        df = df.na.fill("")
    else:
        df = spark.read.format(fmt).load(path)
    df = require_columns(df, required or [], str(path))
    return with_defaults(df, optional or [])


def flat(df: DataFrame) -> DataFrame:
    """Lists as ``|``-joined text and records as JSON, for delimited files."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "array" and field.dataType.elementType.typeName() not in ("struct", "array", "map"):
            columns.append(F.array_join(F.col(field.name).cast("array<string>"), "|").alias(field.name))
        elif kind in ("array", "struct", "map"):
            columns.append(F.to_json(field.name).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: list[str] | None = None) -> None:
    writer = (flat(df) if fmt == "csv" else df).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_sequences(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sequence arrays and their manifest side by side in one Parquet table."""
    require_columns(df, ["sequence_id", "x_cat", "x_num"], "sequences")
    write_table(df, path, mode=mode)


def save_schema(spark: SparkSession, schema: FeatureSchema, path: str) -> None:
    schema_frame(spark, schema).coalesce(1).write.json(path)


def load_schema(spark: SparkSession, path: str) -> FeatureSchema:
    rows = spark.read.schema("family string, value string, rank int").json(path)
    values: dict[str, list[str]] = {}
    for row in rows.orderBy("family", "rank").collect():
        values.setdefault(row["family"], []).append(row["value"])
    return FeatureSchema(values)


def save_vocab(vocab: DataFrame, path: str, **parameters) -> None:
    """Vocabulary rows plus the build parameters they belong to."""
    vocab.withColumn("parameters", F.lit(json.dumps(parameters, sort_keys=True))).coalesce(1).write.json(path)


def load_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    rows = spark.read.schema("column string, token string, id int, parameters string").json(path)
    first = rows.select("parameters").first()
    return rows.drop("parameters"), json.loads(first[0]) if first else {}
