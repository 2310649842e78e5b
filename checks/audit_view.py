"""The driver's ``events`` table read as audit events, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
WINDOW_US = 6 * HOUR


def micros(ts):
    """Microseconds since the epoch, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    i, user = F.col("event_id"), F.col("user_id")
    names = {"click": "execve", "view": "openat", "purchase": "connect", "signup": "setuid", "error": "unlink"}
    syscall = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    dirs = F.array(*[F.lit(d) for d in (
        "/tmp", "/home/u", "/etc", "/var/log", "/root/.ssh", "/dev/shm", "/proc", "/opt")])
    ts_us = micros(F.col("ts"))
    text = "string"
    is_exec = F.col("event_type") == "click"
    path = F.concat(dirs[k % 8], F.lit("/F"), (k % 10).cast(text))
    primary = F.when(i % 10 == 9, "USER_CMD").otherwise("SYSCALL")
    label = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 20), "malicious")
        .when(i % 50 == 0, "ambiguous").when(i % 7 == 0, "").otherwise("benign"))
    return e.select(
        F.concat(F.lit("host"), (user % 3).cast(text)).alias("source"),
        F.concat(F.floor(ts_us / 1000000).cast(text), F.lit("."),
                 F.lpad((ts_us % 1000000).cast(text), 6, "0")).alias("timestamp"),
        ts_us.alias("ts_us"),
        i.cast(text).alias("event_id"),
        i.alias("event_no"),
        F.when(is_exec, F.array(primary, F.lit("EXECVE"), F.lit("PATH")))
        .otherwise(F.array(primary, F.lit("PATH"))).alias("record_types"),
        primary.alias("primary_type"),
        syscall.alias("syscall"),
        F.when(F.col("value") < 80, "yes").otherwise("no").alias("success"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("comm"), (k % 7).cast(text))).alias("comm"),
        F.concat(F.lit("/usr/bin/tool"), (k % 5).cast(text)).alias("exe"),
        F.when(is_exec, F.concat(F.lit("run --k "), k.cast(text), F.lit(" now"))).otherwise("").alias("command"),
        F.when(is_exec, "4").otherwise("").alias("argc"),
        F.array(*[F.lit(v) for v in (
            "network_connect", "(null)", "null", "Exec Cmd", "", "Network-x")])[(i % 6).cast("int")].alias("key"),
        user.cast(text).alias("uid"),
        F.when(user % 5 == 0, "0").otherwise(user.cast(text)).alias("euid"),
        F.when(i % 4 == 0, "4294967295").otherwise(user.cast(text)).alias("auid"),
        (i % 97).cast(text).alias("pid"),
        (i % 13).cast(text).alias("ppid"),
        path.alias("path"),
        F.when(i % 3 == 0, F.array(path, F.lit("/lib64/ld.so"))).otherwise(F.array(path)).alias("paths"),
        F.when(i % 3 == 0, 2).otherwise(1).cast("bigint").alias("path_count"),
        F.when(i % 5 == 0, "/home/w").otherwise("").alias("cwd"),
        F.when((F.col("event_type") == "purchase") & (i % 2 == 0), "0200").otherwise("").alias("saddr"),
        (1 + i % 3).alias("record_count"),
        label.alias("manual_label"),
        user.cast(text).alias("attack_run_id"),
        F.col("value"),
    )


AUDIT_SQL = """
audit_raw AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, epoch_us(ts) AS us FROM events
),
audit AS (
  SELECT 'host' || (user_id % 3) AS source,
    (us // 1000000) || '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') AS timestamp,
    us AS ts_us, CAST(event_id AS VARCHAR) AS event_id, event_id AS event_no,
    CASE WHEN event_id % 10 = 9 THEN 'USER_CMD' ELSE 'SYSCALL' END
      || CASE WHEN event_type = 'click' THEN '|EXECVE|PATH' ELSE '|PATH' END AS record_types,
    CASE WHEN event_id % 10 = 9 THEN 'USER_CMD' ELSE 'SYSCALL' END AS primary_type,
    CASE event_type WHEN 'click' THEN 'execve' WHEN 'view' THEN 'openat'
      WHEN 'purchase' THEN 'connect' WHEN 'signup' THEN 'setuid' ELSE 'unlink' END AS syscall,
    CASE WHEN value < 80 THEN 'yes' ELSE 'no' END AS success,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE 'comm' || (k % 7) END AS comm,
    '/usr/bin/tool' || (k % 5) AS exe, 'tool' || (k % 5) AS exe_basename,
    CASE WHEN event_type = 'click' THEN 'run --k ' || k || ' now' ELSE '' END AS command,
    CASE WHEN event_type = 'click' THEN '4' ELSE '' END AS argc,
    CASE event_id % 6 WHEN 0 THEN 'network_connect' WHEN 1 THEN '(null)' WHEN 2 THEN 'null'
      WHEN 3 THEN 'Exec Cmd' WHEN 4 THEN '' ELSE 'Network-x' END AS key,
    CAST(user_id AS VARCHAR) AS uid,
    CASE WHEN user_id % 5 = 0 THEN '0' ELSE CAST(user_id AS VARCHAR) END AS euid,
    CASE WHEN event_id % 4 = 0 THEN '4294967295' ELSE CAST(user_id AS VARCHAR) END AS auid,
    CAST(event_id % 97 AS VARCHAR) AS pid, CAST(event_id % 13 AS VARCHAR) AS ppid,
    CASE k % 8 WHEN 0 THEN '/tmp' WHEN 1 THEN '/home/u' WHEN 2 THEN '/etc' WHEN 3 THEN '/var/log'
      WHEN 4 THEN '/root/.ssh' WHEN 5 THEN '/dev/shm' WHEN 6 THEN '/proc' ELSE '/opt' END
      || '/F' || (k % 10) AS path,
    CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS path_count,
    CASE WHEN event_id % 5 = 0 THEN '/home/w' ELSE '' END AS cwd,
    CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN '0200' ELSE '' END AS saddr,
    1 + event_id % 3 AS record_count,
    CASE WHEN event_type = 'error' AND value > 20 THEN 'malicious' WHEN event_id % 50 = 0 THEN 'ambiguous'
      WHEN event_id % 7 = 0 THEN '' ELSE 'benign' END AS manual_label,
    CAST(user_id AS VARCHAR) AS attack_run_id, value
  FROM audit_raw
),
audit_paths AS (
  SELECT *, CASE WHEN event_no % 3 = 0 THEN path || '|/lib64/ld.so' ELSE path END AS paths FROM audit
)"""
