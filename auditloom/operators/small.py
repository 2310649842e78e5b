"""Broadcasts whose size is checked before they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.session import materialise

MAX_SMALL_ROWS = 100_000
MAX_SMALL_BYTES = 64 << 20


def checked(df: DataFrame, limit: int = MAX_SMALL_ROWS) -> tuple[DataFrame, bool]:
    """``(table, True)`` with a local copy when ``df`` is small in rows and bytes.

    A table of fixed-width columns is bounded by its rows: at most ``limit + 1``
    are fetched. One with texts is written once, its rows and bytes are measured
    there, and only a table within both limits is fetched. A larger one
    comes back with ``False`` and must be joined by a shuffle.
    """
    wide = {"string", "binary", "array", "map", "struct", "variant"}
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    if not wide & set(kinds.values()):
        head = df.limit(limit + 1).toArrow()
        if head.num_rows > limit or head.nbytes > MAX_SMALL_BYTES:
            return df, False
        return df.sparkSession.createDataFrame(head, schema=df.schema), True
    size = F.lit(0).cast("bigint")
    for name, kind in kinds.items():
        text = F.col(f"`{name}`") if kind in ("string", "binary") else F.to_json(F.struct(f"`{name}`")) if kind in wide else None
        size = size + (F.lit(8) if text is None else F.coalesce(F.octet_length(text), F.lit(0)))
    kept = materialise(df, "small")
    seen = kept.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    if seen["rows"] > limit or seen["bytes"] > MAX_SMALL_BYTES:
        return kept, False
    return df.sparkSession.createDataFrame(kept.toArrow(), schema=df.schema), True


def solid_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Group columns without nulls, so that plain equality joins keep every row.

    Null text counts as blank; any other null key fails the job.
    """
    def solid(name: str) -> Column:
        if df.schema[name].dataType.typeName() == "string":
            return F.coalesce(name, F.lit(""))
        return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"null in group column {name}"))).otherwise(F.col(name))

    return df.withColumns({k: solid(k) for k in keys if df.schema[k].nullable}) if keys else df


def join_keys(df: DataFrame, table: DataFrame, keys: list[str], broadcast: bool = False) -> DataFrame:
    """Left equi-join on equally named keys, keeping those of the left side.

    Plain equality lets both sides reuse a partitioning by the same keys.
    """
    renamed = table.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"__{key}"))
    joined = df.join(F.broadcast(renamed) if broadcast else renamed, condition, "left")
    return joined.drop(*[f"__{k}" for k in keys])


def attach(df: DataFrame, table: DataFrame, keys: list[str], limit: int = MAX_SMALL_ROWS) -> DataFrame:
    """Left join of a table holding one row per key, broadcast only when checked small."""
    if not keys:
        return attach_row(df, table)
    table, is_small = checked(table, limit)
    return join_keys(df, table, keys, broadcast=is_small)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate by a join with that row.

    A scalar subquery would do too, but an expression that runs outside generated
    code takes the subquery's whole plan along into every task.
    """
    return df.drop(*row.columns).crossJoin(F.broadcast(row))
