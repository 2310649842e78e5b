"""Tumbling-window features of audit events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom import schema as S
from auditloom.functions import text as X
from auditloom.operators.small import attach, join_keys, solid_keys
from auditloom.session import materialise

TEXT_COLUMNS = [
    "syscall", "primary_type", "key", "comm", "exe", "command", "success", "uid", "euid",
    "auid", "pid", "ppid", "path", "saddr", "manual_label",
]


# Event field behind each category family.
FAMILY_FIELDS = {c: "exe" if c == "exe_basename" else c for c in S.CATEGORY_PREFIXES}


@dataclass(frozen=True)
class FeatureSchema:
    """Feature names in model order and the category values they were learnt from."""

    values: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return S.BASE_FEATURES + [
            f"{prefix}_{value}_count"
            for column, prefix in S.CATEGORY_PREFIXES.items()
            for value in self.values.get(column, [])
        ]

    def rows(self) -> list[tuple[str, str, int]]:
        return [(c, v, i) for c, vs in self.values.items() for i, v in enumerate(vs)]


def with_defaults(df: DataFrame, columns: list[str]) -> DataFrame:
    """Create absent optional columns as blanks."""
    return df.withColumns({c: F.lit("") for c in columns if c not in df.columns})


def prepare_events(df: DataFrame) -> DataFrame:
    """Typed view of parsed events; rows without a numeric time are dropped."""
    if "timestamp" not in df.columns and "ts_us" not in df.columns:
        raise ValueError("events need a timestamp column")
    df = with_defaults(df, TEXT_COLUMNS)
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit(""))
    if "ts_us" not in df.columns:
        df = df.withColumn("ts_us", X.epoch_us(F.col("timestamp")))
    for name in ("record_count", "path_count"):
        value = X.number_or(F.col(name)) if name in df.columns else F.lit(0.0)
        df = df.withColumn(f"{name}_num", value)
    paths = F.lit("")
    if "paths" in df.columns:
        is_list = df.schema["paths"].dataType.typeName() == "array"
        paths = X.joined(F.col("paths")) if is_list else F.coalesce("paths", F.lit(""))
    return df.where(F.col("ts_us").isNotNull()).withColumns({
        **{c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TEXT_COLUMNS},
        "exe_basename": X.basename(F.col("exe")),
        "all_paths": F.lower(F.concat(paths, F.lit("|"), F.coalesce("path", F.lit("")))),
    })


def window_origin(df: DataFrame, by: list[str]) -> DataFrame:
    """First event time per source, the start of its window 0."""
    return df.groupBy(*by).agg(F.min("ts_us").alias("origin_us"))


def assign_windows(df: DataFrame, size_us: int, by: list[str] | None = None,
                   origin: DataFrame | None = None) -> DataFrame:
    """Half-open windows of ``size_us`` counted from the first event of each source."""
    if size_us <= 0:
        raise ValueError("window size must be positive")
    by = ["source"] if by is None else by
    df = solid_keys(df, by)
    df = attach(df, window_origin(df, by) if origin is None else origin, by)
    offset = F.col("ts_us") - F.col("origin_us")
    window_id = ((offset - F.pmod(offset, F.lit(size_us))) / size_us).cast("bigint")
    start = F.col("origin_us") + F.col("window_id") * size_us
    return (
        df.withColumn("window_id", window_id)
        .withColumns({"window_start_us": start, "window_end_us": start + size_us})
        .drop("origin_us")
    )


def _labels() -> Column:
    return F.lower(X.stripped(F.col("manual_label")))


def window_label(benign: Column, malicious: Column, ambiguous: Column, blank: Column) -> Column:
    return (
        F.when(malicious > 0, "malicious")
        .when(ambiguous > 0, "ambiguous")
        .when((benign > 0) & (blank == 0), "benign")
        .when(benign > 0, "weak_benign")
        .otherwise("unlabeled")
    )


def event_conditions() -> dict[str, Column]:
    """What the counts of a window ask of each of its events, by feature."""
    is_exec = F.col("syscall") == "execve"
    label = _labels()
    return {
        "execve_count": is_exec,
        "command_count": F.col("command") != "",
        "success_yes_count": F.col("success") == "yes",
        "success_no_count": F.col("success") == "no",
        "root_uid_count": F.col("uid") == S.ROOT_ID,
        "root_euid_count": F.col("euid") == S.ROOT_ID,
        "unset_auid_count": F.col("auid") == S.UNSET_AUID,
        **{
            name: X.contains_any(F.col("all_paths"), needles)
            for name, needles in S.PATH_FAMILIES.items()
        },
        "failed_execve_count": is_exec & (F.col("success") == "no"),
        "label_benign_count": label == "benign",
        "label_malicious_count": label == "malicious",
        "label_ambiguous_count": label == "ambiguous",
        "label_unlabeled_count": label == "",
    }


def network_marks() -> Column:
    """How many signs of network use an event bears."""
    return (
        F.col("syscall").isin(S.NETWORK_SYSCALLS).cast("int")
        + (F.col("saddr") != "").cast("int")
        + F.col("key").contains("network").cast("int")
    )


def base_aggregates(approx_distinct: bool = False) -> list[Column]:
    """Window aggregates that combine on the map side; distinct counts only in approximate form."""
    times = {name: F.count_if(condition) for name, condition in event_conditions().items()}
    first = ["execve_count", "command_count", "success_yes_count", "success_no_count"]
    roots = ["root_uid_count", "root_euid_count", "unset_auid_count"]
    found = {
        "event_count": F.count(F.lit(1)),
        "record_count_sum": F.sum("record_count_num").cast("bigint"),
        "record_count_mean": F.avg("record_count_num"),
        "path_count_sum": F.sum("path_count_num").cast("bigint"),
        "path_count_mean": F.avg("path_count_num"),
        **{name: times[name] for name in first},
        **{
            f"unique_{c}_count": F.approx_count_distinct(X.blank_to_null(F.col(c)))
            for c in S.DISTINCT_FIELDS if approx_distinct
        },
        **{name: times[name] for name in roots},
        "network_event_count": F.sum(network_marks()).cast("bigint"),
        **{name: n for name, n in times.items() if name not in first + roots},
    }
    return [column.alias(name) for name, column in found.items()]


def value_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Events per window, field and value: ``(by..., window_id, field, value, n)``.

    Everything that needs the values of a window (distinct counts, category
    counts, the category schema) starts from this table, so an event's fields
    are spread out once, copies collapse on the map side, and names are
    normalised per distinct value instead of per event.
    """
    fields = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
        for c in dict.fromkeys([*S.DISTINCT_FIELDS, *FAMILY_FIELDS.values()])])
    rows = df.select(*by, "window_id", F.inline(fields))
    return rows.groupBy(*by, "window_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(values: DataFrame, by: list[str]) -> DataFrame:
    present = F.col("value") != ""
    return values.groupBy(*by, "window_id").agg(*[
        F.count_if((F.col("field") == c) & present).alias(f"unique_{c}_count") for c in S.DISTINCT_FIELDS])


def window_features(df: DataFrame, by: list[str] | None = None, distinct: str = "exact",
                    values: DataFrame | None = None) -> DataFrame:
    """Base features and labels of every non-empty window of assigned events."""
    by = ["source"] if by is None else by
    if distinct not in ("exact", "approx"):
        raise ValueError("distinct must be 'exact' or 'approx'")
    keys = [*by, "window_id"]
    bounds = [F.min(c).alias(c) for c in ("window_start_us", "window_end_us")]
    grouped = df.groupBy(*keys).agg(*bounds, *base_aggregates(distinct == "approx"))
    if distinct == "exact":
        values = value_counts(df, by) if values is None else values
        grouped = join_keys(grouped, distinct_counts(values, by), keys)
    labels = [F.col(f"label_{c}_count") for c in ("benign", "malicious", "ambiguous", "unlabeled")]
    return grouped.select(*keys, "window_start_us", "window_end_us", *S.BASE_FEATURES, *S.LABEL_FEATURES[:-1],
                          window_label(*labels).alias("window_label"))


def category_values(values: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per category family and normalised value, from :func:`value_counts`."""
    family = F.create_map(*[F.lit(x) for k, v in FAMILY_FIELDS.items() for x in (v, k)])[F.col("field")]
    raw = F.when(F.col("field") == "exe", X.basename(F.col("value"))).otherwise(F.col("value"))
    named = values.where(F.col("field").isin(list(FAMILY_FIELDS.values()))).select(
        *keys, family.alias("family"), X.safe_name(raw).alias("value"), "n")
    return named.groupBy(*keys, "family", "value").agg(F.sum("n").alias("n"))


def top_categories(values: DataFrame, size: int = 50) -> DataFrame:
    """Most frequent values per family: rows of ``(family, value, n, rank)``, rank from 1."""
    best_first = Window.partitionBy("family").orderBy(F.desc("n"), "value")
    return category_values(values, []).withColumn("rank", F.row_number().over(best_first)).where(
        F.col("rank") <= size)


def learn_schema(values: DataFrame, size: int = 50) -> FeatureSchema:
    """Feature schema from the value counts of a training split.

    At most ``5 * size`` rows reach the driver.
    """
    found: dict[str, list[str]] = {c: [] for c in S.CATEGORY_PREFIXES}
    for row in top_categories(values, size).orderBy("family", "rank").collect():
        found[row["family"]].append(row["value"])
    return FeatureSchema(found)


def schema_frame(spark, schema: FeatureSchema) -> DataFrame:
    return spark.createDataFrame(schema.rows(), "family string, value string, rank int")


def category_counts(values: DataFrame, schema: FeatureSchema, by: list[str] | None = None) -> DataFrame:
    """Long counts ``(by..., window_id, family, value, n)`` of the schema's values."""
    by = ["source"] if by is None else by
    allowed = schema_frame(values.sparkSession, schema).select("family", "value")
    return category_values(values, [*by, "window_id"]).join(
        F.broadcast(allowed), ["family", "value"], "left_semi").select(*by, "window_id", "family", "value", "n")


def category_maps(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One map of feature name to count per window; its size is that of the schema."""
    by = ["source"] if by is None else by
    prefix = F.create_map(*[F.lit(x) for kv in S.CATEGORY_PREFIXES.items() for x in kv])
    name = F.concat(prefix[F.col("family")], F.lit("_"), F.col("value"), F.lit("_count"))
    return counts.groupBy(*by, "window_id").agg(
        F.map_from_entries(F.collect_list(F.struct(name.alias("name"), "n"))).alias("cat_counts"))


def align_features(df: DataFrame, schema: FeatureSchema, out: str = "features") -> DataFrame:
    """Feature vector in schema order: missing values 0, unknown ones dropped."""
    base = [F.col(c).cast("double") if c in df.columns else F.lit(0.0) for c in S.BASE_FEATURES]
    names = F.array(*[F.lit(n) for n in schema.names[len(S.BASE_FEATURES):]]).cast("array<string>")
    counts = F.transform(
        names, lambda n: F.coalesce(F.col("cat_counts")[n].cast("double"), F.lit(0.0)))
    return df.withColumn(out, F.concat(F.array(*base), counts))


def wide_features(df: DataFrame, schema: FeatureSchema) -> DataFrame:
    """Feature table with one named column per category, for export."""
    extra = schema.names[len(S.BASE_FEATURES):]
    return df.withColumns({
        n: F.coalesce(F.col("cat_counts")[F.lit(n)], F.lit(0).cast("bigint")) for n in extra
    }).drop("cat_counts", "features")


def build_window_features(df: DataFrame, size_us: int = 10 * X.MICROS,
                          schema: FeatureSchema | None = None, top: int = 50,
                          by: list[str] | None = None,
                          distinct: str = "exact") -> tuple[DataFrame, FeatureSchema]:
    """Window features with a learnt or given schema, and the schema used."""
    by = ["source"] if by is None else by
    events = assign_windows(prepare_events(df), size_us, by)
    values = value_counts(events, by)
    if schema is None:
        # learning reads the counts as well: write them once instead of scanning twice
        values = materialise(values, "window-values")
        schema = learn_schema(values, top)
    base = window_features(events, by, distinct, values)
    maps = category_maps(category_counts(values, schema, by), by)
    joined = join_keys(base, maps, [*by, "window_id"])
    joined = joined.withColumn(
        "cat_counts", F.coalesce("cat_counts", F.create_map().cast("map<string,bigint>")))
    return align_features(joined, schema), schema
