"""Exact ordered computations over groups of any size.

``Window.partitionBy(group)`` sorts a whole group in one task, which fails when
one source, score range or run holds a large share of all rows. The functions
here number the rows of every group with a range-partitioned sort, cut the
numbering into chunks, and carry one summary value per chunk to the next. No
task ever holds more than one partition or one chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from auditloom.operators.small import attach, join_keys, solid_keys
from auditloom.session import materialise

MAX_GROUP_ROWS = 1_000_000
CHUNK_ROWS = 200_000
POS, CHUNK = "_pos", "_chunk"


@dataclass(frozen=True)
class Ordered:
    """Rows with their 0-based position ``_pos`` in the group and a chunk number."""

    df: DataFrame
    by: list[str]
    spans: bool  # a group may span several chunks

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*[F.col(c) for c in self.by], F.col(CHUNK)).orderBy(POS)

    def lag(self, value: Column, out: str) -> Ordered:
        """Value of the previous row of the group."""
        inside = F.lag(value).over(self.window)
        if not self.spans:
            return replace(self, df=self.df.withColumn(out, inside))
        ends = self.df.groupBy(*self.by, CHUNK).agg(F.max_by(value, POS).alias("_carry"))
        ends = ends.withColumn(CHUNK, F.col(CHUNK) + 1)
        carried = join_keys(self.df, ends, [*self.by, CHUNK])
        first = F.row_number().over(self.window) == 1
        return replace(self, df=carried.withColumn(
            out, F.when(first, F.col("_carry")).otherwise(inside)).drop("_carry"))

    def running(self, how: str, value: Column, out: str, before: bool = False) -> Ordered:
        """Running ``max``, ``sum`` or ``last`` (non-null) up to this row.

        ``before`` leaves the row itself out.
        """
        frame = self.window.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        inside = _AGGREGATES[how](value).over(frame)
        if not self.spans:
            if how == "sum":
                inside = F.coalesce(inside, F.lit(0))
            return replace(self, df=self.df.withColumn(out, inside))
        per_chunk = _PER_CHUNK[how](value).alias("_part")
        chunks = self.df.groupBy(*self.by, CHUNK).agg(per_chunk)
        # one row per chunk: small enough to order within one task per group
        earlier = (
            Window.partitionBy(*self.by).orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = chunks.withColumn("_carry", _AGGREGATES[how](F.col("_part")).over(earlier)).drop("_part")
        joined = join_keys(self.df, carry, [*self.by, CHUNK])
        if how == "max":
            total = F.greatest(inside, F.col("_carry"))
        elif how == "sum":
            total = F.coalesce(inside, F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
        else:
            total = F.coalesce(inside, F.col("_carry"))
        return replace(self, df=joined.withColumn(out, total).drop("_carry"))

    def result(self) -> DataFrame:
        return self.df.drop(POS, CHUNK)


_AGGREGATES = {
    "max": F.max,
    "sum": F.sum,
    "last": lambda value: F.last(value, ignorenulls=True),
}
_PER_CHUNK = {
    "max": F.max,
    "sum": F.sum,
    "last": lambda value: F.max_by(value, F.when(value.isNotNull(), F.col(POS))),
}


def order_rows(df: DataFrame, by: list[str], order: list[Column | str],
               max_group_rows: int = MAX_GROUP_ROWS, chunk_rows: int = CHUNK_ROWS,
               largest: int | None = None) -> Ordered:
    """Number the rows of every group of ``by`` in ``order``.

    The largest group is measured first, unless the caller already knows its
    size. While it fits one task, a plain window numbers the rows; beyond that the rows are range-partitioned by
    ``by + order``, written once, and each partition adds the number of rows of
    its group that lie in earlier partitions.
    """
    df = solid_keys(df, by)
    if largest is None:
        sizes = df.groupBy(*by).count() if by else df.agg(F.count(F.lit(1)).alias("count"))
        largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest <= max_group_rows:
        window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
        numbered = df.withColumns({
            POS: (F.row_number().over(window) - 1).cast("bigint"),
            CHUNK: F.lit(0).cast("bigint"),
        })
        return Ordered(numbered, by, False)

    keys = [*[F.col(c) for c in by], *[F.col(c) if isinstance(c, str) else c for c in order]]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialise(placed.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    # the id holds the partition in its high bits and the row index in its low 33
    placed = placed.withColumns({
        "_part": F.shiftright("_row", 33),
        "_index": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)),
    }).drop("_row")
    runs = placed.groupBy(*by, "_part").agg(
        F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = runs.select(
        *by, "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = attach(placed, shift, [*by, "_part"])
    numbered = numbered.withColumn(POS, F.col("_index") + F.col("_shift"))
    numbered = numbered.withColumn(CHUNK, F.floor(F.col(POS) / chunk_rows).cast("bigint"))
    return Ordered(numbered.drop("_part", "_index", "_shift"), by, True)


def number_rows(df: DataFrame, by: list[str], order: list[Column | str], out: str = "pos",
                **limits: int) -> DataFrame:
    """0-based position of every row in its group."""
    return order_rows(df, by, order, **limits).df.drop(CHUNK).withColumnRenamed(POS, out)


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] | None = None,
              weight: str | None = None, **limits: int) -> DataFrame:
    """Exact linear-interpolated quantiles: rows of ``(by..., probability, quantile)``.

    Equal values are counted first, so copies collapse before the shuffle; the
    wanted ranks are then found from running counts instead of a value list
    gathered in one task.
    """
    by = by or []
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n"))
    totals = solid_keys(counts, by).groupBy(*by).agg(F.sum("_n").alias("_total"))
    ordered = order_rows(counts, by, [value], **limits).running("sum", F.col("_n"), "_upto")
    ranked = attach(ordered.result(), totals, by)
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    ranks = F.transform(wanted, lambda p: F.struct(
        p.alias("probability"),
        F.floor(p * (F.col("_total") - 1)).cast("bigint").alias("low"),
        (p * (F.col("_total") - 1) - F.floor(p * (F.col("_total") - 1))).alias("fraction"),
    ))
    first = F.col("_upto") - F.col("_n")
    hits = ranked.withColumn("_rank", F.explode(F.filter(
        ranks, lambda r: (r["low"] < F.col("_upto")) & (r["low"] + 1 >= first))))
    low = F.col("_rank.low")
    at_low = F.when((low >= first) & (low < F.col("_upto")), F.col(value))
    at_next = F.when((low + 1 >= first) & (low + 1 < F.col("_upto")), F.col(value))
    picked = hits.groupBy(*by, F.col("_rank.probability").alias("probability")).agg(
        F.max("_rank.fraction").alias("_fraction"),
        F.max(at_low).alias("_low"), F.max(at_next).alias("_next"))
    step = F.coalesce(F.col("_next") - F.col("_low"), F.lit(0.0))
    return picked.select(*by, "probability",
                         (F.col("_low") + step * F.col("_fraction")).alias("quantile"))
