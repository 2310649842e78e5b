"""Audit records to one row per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.functions import text as X
from auditloom.operators.small import checked
from auditloom.sources.audit_log import read_raw
from auditloom.sources.tables import read_table

# Fixed patterns of the log format.
HEADER = r"^type=([A-Za-z0-9_]+)\s+msg=audit\((\d+(?:\.\d+)?):(\d+)\):\s*"
FIELD = r'(?U)(\w+)=("[^"\\]*+(?:\\.[^"\\]*+)*+"|\S+)'
ASCII_FIELD = FIELD.removeprefix("(?U)")
SUFFIX = r"(?s)(\x1d|\^\]).*$"

# Record kinds whose text is kept; PATH records are reduced to their name.
KEPT_KINDS = ["SYSCALL", "EXECVE", "PROCTITLE", "CWD", "SOCKADDR"]


def extract_records(raw: DataFrame) -> DataFrame:
    """Lines with an audit header as ``(source, pos, record_type, timestamp, event_id, body)``."""
    value = F.col("value")
    # most lines have no suffix; only those that do are searched for its start
    line = F.when(value.contains("\x1d") | value.contains("^]"), F.regexp_replace("value", SUFFIX, "")).otherwise(value)
    # one search: the parts come apart at a character that the line no longer holds
    parts = F.split(F.regexp_replace(line, HEADER, "$1\x1d$2\x1d$3\x1d"), "\x1d", 4)
    found = X.once(parts, lambda p: F.when(F.size(p) == 4, F.struct(
        *[F.get(p, F.lit(i)).alias(name) for i, name in enumerate(("record_type", "timestamp", "event_id", "body"))])))
    # an outer generator: a filter on the record would run the search a second time
    return raw.select("source", "pos", F.inline_outer(F.array(found))).where("record_type IS NOT NULL")


def field_list(body: Column) -> Column:
    """Keys and raw values of a record in line order, from one search of its text."""
    # both patterns mean the same in ASCII, where the one without Unicode classes is faster
    found = X.once(body, lambda text: F.when(F.octet_length(text) == F.length(text), F.regexp_extract_all(text, F.lit(ASCII_FIELD), F.lit(0)))
                   .otherwise(F.regexp_extract_all(text, F.lit(FIELD), F.lit(0))))
    return X.once(found, lambda fields: F.struct(
        F.transform(fields, lambda f: F.substring_index(f, "=", 1)).alias("keys"),
        F.transform(fields, lambda f: F.substr(f, F.locate("=", f) + 1)).alias("values")))


def field_arrays(body: Column) -> Column:
    """Keys and raw values of a record, last field first so that the last one wins."""
    return X.once(field_list(body), lambda f: F.struct(F.reverse(f["keys"]).alias("keys"), F.reverse(f["values"]).alias("values")))


def unquoted(value: Column) -> Column:
    def plain(text: Column) -> Column:
        inner = F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
        inner = F.when(text.contains("\\"), F.regexp_replace(inner, r'\\(["\\])', "$1")).otherwise(inner)
        return F.when(text.startswith('"') & text.endswith('"'), inner).otherwise(text)

    return X.once(value, plain)


def raw_field(fields: Column, name: str) -> Column:
    index = F.array_position(fields["keys"], name) - 1
    return F.coalesce(F.get(fields["values"], index.cast("int")), F.lit(""))


def field(fields: Column, name: str) -> Column:
    """Unquoted value of a field, blank when absent."""
    return unquoted(raw_field(fields, name))


def tokenise(records: DataFrame) -> DataFrame:
    """Records with a ``fields`` list of ``(key, value)`` in line order, one per key."""
    def last_of_each(f: Column) -> Column:
        pairs = F.arrays_zip(f["keys"].alias("key"), f["values"].alias("value"))
        last = F.filter(pairs, lambda p, i: F.array_position(F.slice(f["keys"], i + 2, F.size(f["keys"])), p["key"]) == 0)
        kept = F.when(F.size(F.array_distinct(f["keys"])) == F.size(f["keys"]), pairs).otherwise(last)
        return F.transform(kept, lambda p: F.struct(p["key"].alias("key"), unquoted(p["value"]).alias("value")))

    return records.withColumn("fields", X.once(field_list(F.col("body")), last_of_each))


def field_rows(records: DataFrame, *keys: str) -> DataFrame:
    """One row per field of every record: ``keys..., key, value``."""
    # an outer generator: else a filter on the list is put below it, which builds every list twice
    return tokenise(records).select(*keys, F.inline_outer("fields")).where("key IS NOT NULL")


def decoded(raw: Column, strict: bool) -> Column:
    """Hex-decoded field; ``strict`` leaves quoted values, which are plain text, alone."""
    if strict:
        return F.when(raw.startswith('"'), unquoted(raw)).otherwise(X.printable_hex(raw))
    return X.printable_hex(unquoted(raw))


def sorted_arguments(fields: Column) -> Column:
    """Numbered arguments of an EXECVE record by number; of duplicates the last one first."""
    pairs = F.arrays_zip(fields["keys"].alias("key"), fields["values"].alias("value"))
    numbered = F.transform(pairs, lambda p, i: F.struct(
        F.substring(p["key"], 2, 20).try_cast("bigint").alias("number"),
        p["key"].alias("key"), i.alias("index"), p["value"].alias("value")))
    return F.array_sort(F.filter(numbered, lambda p: p["key"].rlike("^a[0-9]+$")))


def command_line(arguments: str, argc: Column, strict: bool = False) -> Column:
    """Command rebuilt from a column made by :func:`sorted_arguments`.

    With a valid ``argc`` the non-blank arguments below it count, otherwise all.
    """
    count = argc.try_cast("bigint")
    count = F.when(count >= 0, count)
    unique = F.filter(arguments, lambda p, i: (i == 0) | (F.get(F.col(arguments), i - 1)["key"] != p["key"]))
    plain = F.filter(unique, lambda p: count.isNull() | (
        (p["number"] < count) & p["key"].rlike("^a(0|[1-9][0-9]*)$") & (unquoted(p["value"]) != "")))
    words = F.transform(plain, lambda p: decoded(p["value"], strict))
    return X.one_line(F.array_join(words, " "))


def syscall_dimension(spark: SparkSession) -> DataFrame:
    """Built-in ``(num, name)`` table; pass your own to :func:`resolve_syscalls` to replace it."""
    return spark.createDataFrame(list(S.SYSCALL_NAMES.items()), "num string, name string")


def resolve_syscalls(events: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Turn ``syscall_raw`` into ``syscall`` (name) and ``syscall_num``.

    A syscall table has a few hundred rows; the given one is broadcast if its size allows.
    """
    given, is_small = dimension is not None, True
    dimension = dimension if given else syscall_dimension(events.sparkSession)
    raw = F.coalesce("syscall_raw", F.lit(""))
    is_name = (raw != "") & ~raw.rlike("^[0-9]+$")
    table = dimension.select(F.col("num").alias("_num"), F.col("name").alias("_name"))
    if given:
        table, is_small = checked(table)
    joined = events.join(F.broadcast(table) if is_small else table, F.col("syscall_raw") == F.col("_num"), "left")
    return joined.withColumns({
        "syscall": F.coalesce("_name", raw),
        "syscall_num": F.when(is_name, "").otherwise(raw),
    }).drop("_num", "_name", "syscall_raw")


def merge_records(records: DataFrame, key: list[str]) -> DataFrame:
    """Records of an event merged into one row of raw texts and ordered lists.

    Copies collapse first, per record kind and path name, with aggregates that
    combine on the map side. What reaches an event's own task is then one row
    per distinct kind or path, however many records share the event id.
    """
    kind = F.col("record_type")
    name = F.when(kind == "PATH", field(field_arrays(F.col("body")), "name")).otherwise("")
    rows = records.select(
        *key, *[c for c in ("timestamp",) if c not in key], "record_type", "pos",
        name.alias("name"), F.when(kind.isin(KEPT_KINDS), F.col("body")).alias("body"))
    kinds = rows.groupBy(*key, "record_type", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.max_by("body", "pos").alias("body"), F.min_by("timestamp", "pos").alias("_timestamp"))

    def last_of(wanted: str) -> Column:
        at = F.when(kind == wanted, F.col("last"))
        return F.max_by("body", at).alias(wanted)

    merged = kinds.groupBy(*key).agg(
        F.sum("n").alias("record_count"),
        F.min("first").alias("first_pos"),
        F.min_by("_timestamp", "first").alias("_timestamp"),
        F.max(kind == "SYSCALL").alias("_has_syscall"),
        F.min_by("record_type", "first").alias("_first_type"),
        F.collect_list(F.struct("first", "record_type", "name")).alias("_kinds"),
        *[last_of(k) for k in KEPT_KINDS])
    ordered = F.array_sort("_kinds")
    paths = F.transform(F.filter(ordered, lambda r: (r["record_type"] == "PATH") & (r["name"] != "")),
                        lambda r: r["name"])
    return merged.select(
        *key, *[F.col("_timestamp").alias("timestamp") for _ in [0] if "timestamp" not in key],
        "record_count", "first_pos", *KEPT_KINDS,
        F.when(F.col("_has_syscall"), "SYSCALL").otherwise(F.col("_first_type")).alias("primary_type"),
        F.array_distinct(F.transform(ordered, lambda r: r["record_type"])).alias("record_types"),
        F.array_distinct(paths).alias("paths"))


def build_events(records: DataFrame, key: list[str] | None = None, strict_hex: bool = False,
                 syscalls: DataFrame | None = None) -> DataFrame:
    """One row per event in the 30-column event layout, plus time and order keys.

    The default key is ``(source, event_id)``; add ``timestamp`` to keep apart
    events of one host whose ids restarted.
    """
    merged = merge_records(records, key or ["source", "event_id"])
    parsed = merged.withColumns({f"_{k}": field_arrays(F.coalesce(k, F.lit(""))) for k in KEPT_KINDS})
    parsed = parsed.withColumns({
        "_arguments": X.once(F.col("_EXECVE"), sorted_arguments),
        "_argc": field(F.col("_EXECVE"), "argc"),
    })
    call = F.col("_SYSCALL")
    events = parsed.withColumns({
        **{c: field(call, c) for c in S.SYSCALL_FIELDS},
        "syscall_raw": field(call, "syscall"),
        "argc": F.col("_argc"),
        "command": command_line("_arguments", F.col("_argc"), strict_hex),
        "proctitle": X.one_line(decoded(raw_field(F.col("_PROCTITLE"), "proctitle"), strict_hex)),
        "cwd": field(F.col("_CWD"), "cwd"),
        "saddr": field(F.col("_SOCKADDR"), "saddr"),
        "path": F.coalesce(F.get("paths", F.lit(0)), F.lit("")),
        "path_count": F.size("paths").cast("bigint"),
        "ts_us": X.epoch_us(F.col("timestamp")),
    })
    return resolve_syscalls(events, syscalls).select("source", *S.EVENT_COLUMNS, "ts_us", "first_pos")


def load_events(spark: SparkSession, raw: str | list[str] | None = None,
                parsed: str | list[str] | None = None, source: str = "", fmt: str = "csv",
                **options) -> DataFrame:
    """Events from a raw log or from an already parsed table."""
    if (raw is None) == (parsed is None):
        raise ValueError("give either a raw log or parsed events")
    if raw is not None:
        return build_events(extract_records(read_raw(spark, raw, source)), **options)
    events = read_table(spark, parsed, ["timestamp", "event_id"], fmt=fmt)
    if "source" not in events.columns:
        events = events.withColumn("source", F.lit(source))
    return events if "ts_us" in events.columns else events.withColumn("ts_us", X.epoch_us(F.col("timestamp")))
