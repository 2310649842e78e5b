"""Log reading and event assembly (groups A and B): events are rendered as log lines and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.operators import events as B
from auditloom.operators import sequences as Q
from auditloom.operators import windows as W
from auditloom.operators.ordering import number_rows
from auditloom.sources import tables as T
from auditloom.sources.audit_log import read_raw
from checks.audit_view import AUDIT_SQL, audit_events
from checks.scratch import fresh
from checks.sequence_queries import LENGTH, NUMERIC_SQL, SEQUENCES_SQL, STRIDE, VOCAB, EVENTS_SQL, VOCAB_SQL, build, events
from checks.window_queries import CATEGORY_SQL, TOP, windowed

NUMBERS = {"execve": "59", "openat": "257", "connect": "42", "setuid": "105", "unlink": "87"}


def line_rows(e):
    """Log lines of audit events with the keys that order them."""
    head = F.concat(F.lit(" msg=audit("), F.col("timestamp"), F.lit(":"), F.col("event_id"), F.lit("): "))
    number = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])[F.col("syscall")]

    def line(kind, *parts):
        return F.concat(F.lit(f"type={kind}"), head, *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def named(*columns):
        return [x for c in columns for x in (f" {c}=", F.col(c))]

    key = F.when(F.col("key") == "(null)", F.col("key")).otherwise(F.concat(F.lit('"'), F.col("key"), F.lit('"')))
    call = line("SYSCALL", "arch=c000003e syscall=", number, " exit=0 gid=0 egid=0 tty=pts0 ses=1",
                *named("success", "ppid", "pid", "auid", "uid", "euid"),
                ' comm="', F.col("comm"), '" exe="', F.col("exe"), '" key=', key)
    words = F.split("command", " ")
    title = F.hex(F.replace(F.col("command"), F.lit(" "), F.lit("\0")))
    lines = F.array_compact(F.concat(
        F.array(
            F.when(F.col("primary_type") == "SYSCALL", call).otherwise(
                line("USER_CMD", "pid=1 uid=0 msg='cwd=\"/\" res=success'\x1dUID=\"root\"")),
            F.when(F.col("command") != "", line(
                "EXECVE", 'argc=4 a0="run" a1="--k" a2=', F.hex(F.get(words, F.lit(2))), " a3=6E6F77")),
            F.when(F.col("cwd") != "", line("CWD", 'cwd="', F.col("cwd"), '"'))),
        F.transform("paths", lambda p: F.concat(line("PATH", 'item=0 name="'), p, F.lit('"'))),
        F.array(
            F.when(F.col("command") != "", line("PROCTITLE", "proctitle=", title)),
            F.when(F.col("saddr") != "", line("SOCKADDR", "saddr=", F.col("saddr"))),
            F.lit("not an audit line"))))
    keys = ["source", "ts_us", "event_no"]
    return e.select(*keys, F.posexplode(lines).alias("at", "value"))


def rendered(spark, sf_dir):
    """Log lines of the audit view below one folder per source."""
    keys, path = ["source", "ts_us", "event_no"], fresh(spark, "log")
    # events are dealt before they become lines: neither the sampling of the ranges nor the shuffle holds a line
    rows = line_rows(audit_events(spark, sf_dir).repartitionByRange(*keys))
    rows.sortWithinPartitions(*keys, "at").select("source", "value").write.partitionBy("source").text(path)
    return read_raw(spark, f"{path}/*/*.txt", source_pattern=r"source=([^/]+)/")


def date_files(spark, folders):
    """Modification times, a second apart, in the order of the folders and of the parts in them, as a log cut by its size leaves them."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(folders[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(i, f.getPath().getName(), f.getPath()) for i, folder in enumerate(folders)
             for f in fs.listStatus(path_of(folder)) if f.getPath().getName().startswith("part-")]
    for i, (_, _, path) in enumerate(sorted(files, key=lambda f: f[:2])):
        fs.setTimes(path, 1_000_000_000_000 + 1000 * i, -1)


def rotated(spark, sf_dir):
    """Two generations of one log in files cut by size, the older one compressed: every event at its place in the joint order."""
    e = audit_events(spark, sf_dir)
    middle = e.agg(F.percentile_approx("ts_us", 0.5)).first()[0]
    path, keys = fresh(spark, "rotated"), ["ts_us", "event_no"]
    generations = (("audit.log.1", F.col("ts_us") <= middle, "gzip"), ("audit.log", F.col("ts_us") > middle, None))
    for name, part, codec in generations:
        rows = line_rows(e.where(part).repartitionByRange(*keys)).sortWithinPartitions(*keys, "at").select("value")
        rows.write.text(f"{path}/{name}", compression=codec)
    date_files(spark, [f"{path}/{name}" for name, _, _ in generations])
    found = B.build_events(B.extract_records(read_raw(spark, f"{path}/*/*.txt*", source="joint")))
    placed = number_rows(found.select("event_id", "command", "record_count", "first_pos"), [], ["first_pos"], "place")
    return placed.select("event_id", "command", "record_count", F.col("place").cast("bigint").alias("place"))


RECORDS_SQL = f"""{AUDIT_SQL},
records AS (
  SELECT source, event_id, timestamp, unnest(['SYSCALL', 'USER_CMD', 'EXECVE', 'CWD', 'PATH', 'PROCTITLE', 'SOCKADDR']) AS record_type,
    unnest([(primary_type = 'SYSCALL')::BIGINT, (primary_type = 'USER_CMD')::BIGINT, (command <> '')::BIGINT, (cwd <> '')::BIGINT,
            path_count::BIGINT, (command <> '')::BIGINT, (saddr <> '')::BIGINT]) AS n
  FROM audit
)"""

FROM_CALL = ["success", "comm", "exe", "uid", "euid", "auid", "pid", "ppid", "key"]
TEXTS = ["timestamp", "primary_type", "syscall", "syscall_num", *FROM_CALL, "command", "argc", "proctitle", "cwd", "path", "saddr"]

EVENTS_ORACLE = f"""WITH {AUDIT_SQL} SELECT source, event_id, timestamp, ts_us, primary_type,
  {", ".join(f"CASE WHEN primary_type = 'SYSCALL' THEN {c} ELSE '' END AS {c}" for c in [*FROM_CALL, "syscall"])},
  CASE WHEN primary_type <> 'SYSCALL' THEN '' ELSE CASE syscall {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NUMBERS.items())} END END AS syscall_num,
  command, argc, command AS proctitle, cwd, path, saddr, paths, CAST(path_count AS BIGINT) AS path_count,
  CAST(1 + 2 * (command <> '')::INT + (cwd <> '')::INT + (saddr <> '')::INT + path_count AS BIGINT) AS record_count,
  primary_type || CASE WHEN command <> '' THEN '|EXECVE' ELSE '' END || CASE WHEN cwd <> '' THEN '|CWD' ELSE '' END || '|PATH'
    || CASE WHEN command <> '' THEN '|PROCTITLE' ELSE '' END || CASE WHEN saddr <> '' THEN '|SOCKADDR' ELSE '' END AS record_types
  FROM audit_paths"""


def records(spark, sf_dir):
    return B.extract_records(rendered(spark, sf_dir)).groupBy(
        "source", "event_id", "timestamp", "record_type").agg(F.count(F.lit(1)).alias("n"))


def tokens(spark, sf_dir):
    calls = B.extract_records(rendered(spark, sf_dir)).where("record_type = 'SYSCALL'")
    return B.field_rows(calls, "event_id").where(F.col("key").isin("uid", "comm", "key", "exe", "auid"))


def all_fields(spark, sf_dir):
    """Every field of every record, with the number of records that hold it."""
    rows = B.field_rows(B.extract_records(rendered(spark, sf_dir)), "event_id", "record_type")
    return rows.groupBy("event_id", "record_type", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def assembled(spark, sf_dir):
    found = B.build_events(B.extract_records(rendered(spark, sf_dir)))
    return found.select(
        "source", "event_id", "ts_us", *TEXTS, "path_count", "record_count",
        F.array_join("paths", "|").alias("paths"), F.array_join("record_types", "|").alias("record_types"))


def parsed_table(spark, sf_dir):
    path = fresh(spark, "events")
    T.write_table(audit_events(spark, sf_dir), path, "csv")
    found = B.load_events(spark, parsed=path)
    return found.select("source", "event_id", "timestamp", F.col("ts_us").cast("bigint").alias("ts_us"),
                        "key", "command", "paths", "record_types")


def saved_schema(spark, sf_dir):
    path = fresh(spark, "schema")
    values = W.value_counts(windowed(spark, sf_dir), ["source"])
    T.save_schema(spark, W.learn_schema(values, TOP), path)
    return W.schema_frame(spark, T.load_schema(spark, path))


def saved_vocabulary(spark, sf_dir):
    path = fresh(spark, "vocab")
    T.save_vocab(Q.learn_vocab(events(spark, sf_dir), VOCAB), path, length=LENGTH, stride=STRIDE)
    vocab, parameters = T.load_vocab(spark, path)
    return vocab.withColumn("length", F.lit(parameters["length"]))


def saved_sequences(spark, sf_dir):
    path = fresh(spark, "sequences")
    T.write_sequences(build(spark, sf_dir), path)
    return spark.read.parquet(path).select(
        "sequence_id", "segment_id", F.col("y").cast("bigint").alias("y"), F.size("x_cat").cast("bigint").alias("steps"))


def sequence_values(spark, sf_dir):
    """All token ids and numbers of the saved arrays, a row for each step."""
    path = fresh(spark, "sequences")
    T.write_sequences(build(spark, sf_dir), path)
    steps = F.arrays_zip(F.col("x_cat").alias("cat"), F.col("x_num").alias("num"))
    rows = spark.read.parquet(path).select("sequence_id", F.posexplode(steps).alias("step", "s"))
    return rows.select("sequence_id", F.col("step").cast("bigint").alias("step"), F.array_join(F.col("s.cat").cast("array<string>"), ",").alias("ids"),
                       *[F.round(F.col("s.num")[i].cast("double"), 4).alias(c) for i, c in enumerate(S.NUMERIC_COLUMNS)])


CALL_KEYS = ["success", "ppid", "pid", "auid", "uid", "euid", "comm", "exe", "key"]
FIXED = {"arch": "c000003e", "exit": "0", "gid": "0", "egid": "0", "tty": "pts0", "ses": "1"}


def literal(text):
    return "'" + text.replace("'", "''") + "'"


def record_sql(kind, names, values, where="true"):
    return f"""SELECT event_id, '{kind}' AS record_type, unnest([{", ".join(map(literal, names))}]) AS "key", unnest([{", ".join(values)}]) AS value
        FROM audit_paths WHERE {where}"""


ALL_FIELDS_SQL = " UNION ALL ".join([
    record_sql("SYSCALL", [*FIXED, "syscall", *CALL_KEYS], [
        *map(literal, FIXED.values()), "CASE syscall " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NUMBERS.items()) + " END", *CALL_KEYS],
        "primary_type = 'SYSCALL'"),
    record_sql("USER_CMD", ["pid", "uid", "msg", "res"], ["'1'", "'0'", literal("'cwd=\"/\""), literal("success'")], "primary_type = 'USER_CMD'"),
    record_sql("EXECVE", ["argc", "a0", "a1", "a2", "a3"], ["'4'", "'run'", "'--k'", "hex(split_part(command, chr(32), 3))", "'6E6F77'"], "command <> ''"),
    record_sql("CWD", ["cwd"], ["cwd"], "cwd <> ''"),
    record_sql("PROCTITLE", ["proctitle"], ["hex(replace(command, ' ', chr(0)))"], "command <> ''"),
    record_sql("SOCKADDR", ["saddr"], ["saddr"], "saddr <> ''"),
    "SELECT event_id, 'PATH', 'item', '0' FROM (SELECT event_id, unnest(string_split(paths, '|')) FROM audit_paths)",
    "SELECT event_id, 'PATH', 'name', unnest(string_split(paths, '|')) FROM audit_paths"])


QUERIES = {
    "audit_records": records,
    "audit_record_all_fields": all_fields,
    "rotated_log_events": rotated,
    "saved_sequence_values": sequence_values,
    "audit_record_fields": tokens,
    "audit_events_from_log": assembled,
    "parsed_event_table": parsed_table,
    "saved_feature_schema": saved_schema,
    "saved_vocabulary": saved_vocabulary,
    "saved_sequences": saved_sequences,
}

ORACLES = {
    "audit_record_all_fields": f"""WITH {AUDIT_SQL}, fields AS ({ALL_FIELDS_SQL}) SELECT *, count(*) AS n FROM fields GROUP BY ALL""",
    "rotated_log_events": f"""WITH {AUDIT_SQL} SELECT event_id, command,
        CAST(1 + 2 * (command <> '')::INT + (cwd <> '')::INT + (saddr <> '')::INT + path_count AS BIGINT) AS record_count,
        row_number() OVER (ORDER BY ts_us, event_no) - 1 AS place FROM audit""",
    "saved_sequence_values": f"""WITH {SEQUENCES_SQL} SELECT n.sequence_id, pos - k * {STRIDE} AS step, ids,
        {", ".join(f"round(CAST({sql} AS DOUBLE), 4) AS {name}" for sql, name in zip(NUMERIC_SQL, S.NUMERIC_COLUMNS, strict=True))}
        FROM placed JOIN (SELECT attack_run_id, k, sequence_id FROM numbered) n USING (attack_run_id, k)""",
    "audit_records": f"WITH {RECORDS_SQL} SELECT * FROM records WHERE n > 0",
    "audit_record_fields": f"""WITH {AUDIT_SQL} SELECT event_id, unnest(['uid', 'comm', 'key', 'exe', 'auid']) AS "key",
        unnest([uid, comm, key, exe, auid]) AS value FROM audit WHERE primary_type = 'SYSCALL'""",
    "audit_events_from_log": EVENTS_ORACLE,
    "parsed_event_table": f"WITH {AUDIT_SQL} SELECT source, event_id, timestamp, ts_us, key, command, paths, record_types FROM audit_paths",
    "saved_feature_schema": f"WITH {CATEGORY_SQL} SELECT family, value, CAST(rank - 1 AS INTEGER) AS rank FROM learnt",
    "saved_vocabulary": f'WITH {EVENTS_SQL}, {VOCAB_SQL} SELECT "column", token, id, {LENGTH} AS length FROM vocab',
    "saved_sequences": f"WITH {SEQUENCES_SQL} SELECT sequence_id, attack_run_id AS segment_id, CAST(y AS BIGINT) AS y, event_count AS steps FROM numbered",
}
