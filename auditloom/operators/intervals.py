"""Joins on time ranges without nested loops or cross joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.ordering import POS, order_rows
from auditloom.operators.small import MAX_SMALL_ROWS, checked, solid_keys
from auditloom.session import materialise

MAX_CANDIDATES = 64
SHELF_ROWS = 64
LEVEL_BASE_US = 1_000_000
LEVEL_STEP = 8


def lookup_segment(points: DataFrame, segments: DataFrame, by: list[str], at: str,
                   low: str, high: str, limit: int = MAX_SMALL_ROWS, **limits: int) -> DataFrame:
    """Add to each point the columns of the closed segment that holds it.

    The segments of one ``by`` group must not overlap, so a point has at most one
    match and keeps exactly one row. A segment table of checked size is cut into
    time buckets of its mean length and broadcast: the points are not shuffled.
    A larger one is cut into shelves of neighbouring segments; the table of
    shelves is broadcast, and points meet the segments of their shelf in one
    shuffle of the columns that are used. Segments or shelves that crowd a bucket
    are merged with the points in time order and the latest segment start is
    carried forward, again without pairs.
    """
    extra = [c for c in segments.columns if c not in (*by, low, high)]
    points, segments = solid_keys(points, by), solid_keys(segments, by)
    table, is_small = checked(segments, limit)
    if is_small:
        found = _lookup_by_bucket(points, table, by, at, low, high, extra)
        if found is not None:
            return found
    else:
        # the order is taken once, of what ``checked`` has written
        shelved = order_rows(table, by, [low], **limits).df.withColumn("_shelf", F.floor(F.col(POS) / SHELF_ROWS).cast("bigint"))
        shelved = materialise(shelved.select(*by, low, high, *extra, "_shelf"), "shelved")
        shelves, is_small = checked(shelved.groupBy(*by, "_shelf").agg(F.min(low).alias(low), F.max(high).alias(high)), limit)
        dealt = _lookup_by_bucket(points, shelves, by, at, low, high, ["_shelf"]) if is_small else None
        if dealt is not None:
            return _lookup_on_shelf(dealt, shelved, by, at, low, high, extra)
    return _lookup_by_order(points, segments, by, at, low, high, extra, limits)


def _div(value: Column, width: int) -> Column:
    """Floor division that stays exact for microsecond epochs."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("bigint")


def _lookup_by_bucket(points, table, by, at, low, high, extra):
    """Points with ``extra`` of the segment that holds them, or ``None`` when the segments crowd a bucket."""
    width = table.agg(
        F.coalesce(F.ceil(F.avg(F.col(high) - F.col(low) + 1)), F.lit(1))).first()[0]
    width = max(1, int(width))
    cut = table.withColumn("_bucket", F.explode(
        F.sequence(_div(F.col(low), width), _div(F.col(high), width))))
    crowd = cut.groupBy(*by, "_bucket").count().agg(F.max("count")).first()[0] or 0
    if crowd > MAX_CANDIDATES:
        return None
    cut = cut.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(low).alias("_low"),
                     F.col(high).alias("_high"), *extra, "_bucket")
    condition = _div(F.col(at), width) == F.col("_bucket")
    for key in by:
        condition = condition & (F.col(key) == F.col(f"__{key}"))
    condition = condition & F.col(at).between(F.col("_low"), F.col("_high"))
    joined = points.join(F.broadcast(cut), condition, "left")
    return joined.drop("_low", "_high", "_bucket", *[f"__{c}" for c in by])


def _lookup_on_shelf(points, segments, by, at, low, high, extra):
    # points beside all shelves have a number of their own kind, so that they do not meet in one task
    points = points.withColumn("_shelf", F.coalesce("_shelf", -1 - F.pmod(F.xxhash64(at), F.lit(1 << 20))))
    held = segments.select(*[F.col(c).alias(f"__{c}") for c in (*by, "_shelf")], F.col(low).alias("_low"),
                           F.col(high).alias("_high"), *extra)
    condition = F.col(at).between(F.col("_low"), F.col("_high"))
    for key in (*by, "_shelf"):
        condition = condition & (F.col(key) == F.col(f"__{key}"))
    return points.join(held, condition, "left").drop("_low", "_high", "_shelf", *[f"__{c}" for c in (*by, "_shelf")])


def _lookup_by_order(points, segments, by, at, low, high, extra, limits):
    payload = F.struct(F.col(high).alias("_high"), *[F.col(c) for c in extra])
    marks = segments.select(*by, F.col(low).alias("_at"), F.lit(0).alias("_kind"),
                            payload.alias("_segment"))
    rows = points.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_kind"),
                         F.struct(*points.columns).alias("_point"))
    merged = rows.unionByName(marks, allowMissingColumns=True)
    # the tie-break lets points of one instant spread over several partitions
    merged = merged.withColumn("_tie", F.monotonically_increasing_id())
    ordered = order_rows(merged, by, ["_at", "_kind", "_tie"], **limits)
    filled = ordered.running("last", F.col("_segment"), "_latest").df
    inside = F.col("_at") <= F.col("_latest._high")
    return filled.where("_kind = 1").select(
        "_point.*", *[F.when(inside, F.col("_latest")[c]).alias(c) for c in extra])


def _level(length: Column) -> Column:
    """Smallest level whose bucket is at least as long as the interval."""
    steps = F.log(F.greatest(length, F.lit(1)) / F.lit(float(LEVEL_BASE_US))) / math.log(LEVEL_STEP)
    return F.greatest(F.ceil(steps), F.lit(0)).cast("int")


def _levels(df: DataFrame, start: str, end: str) -> list[int]:
    level = _level(F.col(end) - F.col(start) + 1)
    return sorted(df.agg(F.collect_set(level)).first()[0])


def _spread(df: DataFrame, start: str, end: str, own: list[int], other: list[int],
            coarser_role: str, finer_role: str, keep_equal: bool) -> DataFrame:
    """One row per (role, level, bucket) under which an interval can meet a partner."""
    level = _level(F.col(end) - F.col(start) + 1)
    # a partner shorter than this interval is met at this interval's own level,
    # a longer one at the partner's level
    wider = [F.when(F.lit(k) >= level if keep_equal else F.lit(k) > level, F.lit(k)) for k in other]
    slots = F.concat(
        F.array(F.struct(F.lit(coarser_role).alias("role"), level.alias("level"))),
        F.transform(
            F.array_compact(F.array(*wider)) if wider else F.array().cast("array<int>"),
            lambda k: F.struct(F.lit(finer_role).alias("role"), k.alias("level"))),
    )
    slotted = df.withColumn("_slot", F.explode(slots)).select("*", "_slot.role", "_slot.level").drop("_slot")
    width = (F.lit(LEVEL_BASE_US) * F.pow(F.lit(float(LEVEL_STEP)), F.col("level"))).cast("bigint")
    slotted = slotted.withColumn("_width", width)
    first = (F.col(start) - F.pmod(F.col(start), F.col("_width"))) / F.col("_width")
    last = (F.col(end) - F.pmod(F.col(end), F.col("_width"))) / F.col("_width")
    slotted = slotted.withColumn("_first", first.cast("bigint"))
    return slotted.withColumn("_bucket", F.explode(F.sequence(F.col("_first"), last.cast("bigint")))).drop("_width")


def overlap_pairs(left: DataFrame, right: DataFrame, by: list[str],
                  left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of closed intervals that overlap, each pair once.

    Intervals are filed under buckets of their own length class, so one interval
    takes at most two buckets per class and a pair meets in the class of its
    longer member. That stays bounded when a few intervals are very long. Column
    names of both sides must differ, except ``by``. A crowded bucket is split by
    adaptive skew-join handling: the join has no ordering or grouping to keep.
    """
    left, right = solid_keys(left, by), solid_keys(right, by)
    right = right.withColumnsRenamed({c: f"__{c}" for c in by})
    left_levels = _levels(left, *left_range)
    right_levels = _levels(right, *right_range)
    a = _spread(left, *left_range, left_levels, right_levels, "left", "right", False)
    b = _spread(right, *right_range, right_levels, left_levels, "right", "left", True)
    b = b.withColumnsRenamed({"role": "_r_role", "level": "_r_level", "_bucket": "_r_bucket", "_first": "_r_first"})
    condition = (
        (F.col("role") == F.col("_r_role")) & (F.col("level") == F.col("_r_level"))
        & (F.col("_bucket") == F.col("_r_bucket"))
    )
    for key in by:
        condition = condition & (F.col(key) == F.col(f"__{key}"))
    condition = (
        condition
        & (F.col(right_range[0]) <= F.col(left_range[1]))
        & (F.col(right_range[1]) >= F.col(left_range[0]))
        & (F.col("_bucket") == F.greatest("_first", "_r_first"))
    )
    return a.join(b, condition, "inner").drop(
        "role", "level", "_bucket", "_first", "_r_role", "_r_level", "_r_bucket", "_r_first",
        *[f"__{c}" for c in by])
