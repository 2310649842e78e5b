"""Log lines to events, on hand-computed cases."""

import gzip
import os

import pytest

from auditloom.operators.events import build_events, extract_records, field_rows, load_events, tokenise
from auditloom.sources.audit_log import read_raw

LINES = """\
type=SYSCALL msg=audit(1000.100:7): arch=c000003e syscall=59 success=yes exit=0 ppid=10 pid=11 auid=1000 uid=1000 gid=1000 euid=0 egid=0 tty=pts0 ses=3 comm="ls" exe="/usr/bin/ls" key="exec"
type=EXECVE msg=audit(1000.100:7): argc=3 a0="ls" a1="41" a2=2F746D70
type=CWD msg=audit(1000.100:7): cwd="/home/a"
type=PATH msg=audit(1000.100:7): item=0 name="/usr/bin/ls"
type=PATH msg=audit(1000.100:7): item=1 name="/lib64/ld.so"
type=PATH msg=audit(1000.100:7): item=2 name="/usr/bin/ls"
type=PROCTITLE msg=audit(1000.100:7): proctitle=6C73002D6C
type=USER_CMD msg=audit(1002.000:8): pid=1 uid=0 msg='cwd="/root" cmd=6964 res=success'
node=h type=SYSCALL msg=audit(1003.000:9): syscall=59
type=SYSCALL msg=audit(1004.5:10): syscall=999 success=no uid=0\x1dUID="root"
"""


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def events_of(spark, tmp_path, text, **options):
    path = write(tmp_path, "audit.log", text)
    return {r["event_id"]: r for r in load_events(spark, raw=path, source="h", **options).collect()}


def test_fixture(spark, tmp_path):
    found = events_of(spark, tmp_path, LINES)
    assert sorted(found) == ["10", "7", "8"]
    e = found["7"]
    assert e["record_types"] == ["SYSCALL", "EXECVE", "CWD", "PATH", "PROCTITLE"]
    assert (e["primary_type"], e["syscall"], e["syscall_num"]) == ("SYSCALL", "execve", "59")
    assert (e["command"], e["proctitle"]) == ("ls A /tmp", "ls -l")
    assert e["paths"] == ["/usr/bin/ls", "/lib64/ld.so"]
    assert (e["path"], e["path_count"], e["uid"], e["record_count"]) == ("/usr/bin/ls", 2, "1000", 7)
    assert (e["cwd"], e["comm"], e["key"], e["argc"], e["ts_us"]) == ("/home/a", "ls", "exec", "3", 1000100000)
    e = found["8"]
    assert (e["record_types"], e["primary_type"], e["syscall"], e["uid"], e["path_count"]) == (
        ["USER_CMD"], "USER_CMD", "", "", 0)
    e = found["10"]
    assert (e["syscall"], e["syscall_num"], e["command"], e["uid"], e["record_count"]) == ("999", "999", "", "0", 1)


def test_strict_hex_leaves_quoted_values(spark, tmp_path):
    assert events_of(spark, tmp_path, LINES, strict_hex=True)["7"]["command"] == "ls 41 /tmp"


def test_last_record_wins_and_odd_values(spark, tmp_path):
    found = events_of(spark, tmp_path, "\n".join([
        'type=SYSCALL msg=audit(1.0:1): syscall=2 comm="a" key="k"',
        'type=SYSCALL msg=audit(2.0:1): syscall=open comm="b \\"q\\""',
        'type=EXECVE msg=audit(1.0:1): argc=1 a0="first"',
        'type=EXECVE msg=audit(1.0:1): argc=4 a0="second" a1[0]=41 a1="" a2_len=3 a2="x  y" a3="20" a0="again"',
        'type=EXECVE msg=audit(1.0:2): a10="ten" a2="two" a0="3000"',
        'type=SYSCALL msg=audit(1.0:3): syscall=59 key=(null)',
        f'type=EXECVE msg=audit(1.0:4): argc=1 a0="{"w" * 600}"',
        f'type=PROCTITLE msg=audit(1.0:5): proctitle="{"p" * 50000}"',
        "type=PROCTITLE msg=audit(1.0:6): proctitle=0102030405",
        'type=EXECVE msg=audit(1.0:7): argc=2000000000 a0="only"',
        'type=SYSCALL msg=audit(1.0:8): syscall=1 uid=0^]UID="root" key="cut"',
    ]))
    one = found["1"]
    assert (one["comm"], one["key"], one["syscall"], one["syscall_num"], one["timestamp"]) == (
        'b "q"', "", "open", "", "1.0")
    assert one["command"] == "again x y"
    assert found["2"]["command"] == "0 two ten"
    assert found["3"]["key"] == "(null)"
    assert found["4"]["command"] == "w" * 500 + "..."
    assert found["5"]["proctitle"] == "p" * 500 + "..."
    assert found["6"]["proctitle"] == "0102030405"
    assert found["7"]["command"] == "only"
    assert (found["8"]["uid"], found["8"]["key"]) == ("0", "")


def test_rotated_files_are_read_oldest_first(spark, tmp_path):
    new = write(tmp_path, "audit.log", 'type=PATH msg=audit(2.0:1): name="/new"\n')
    old = tmp_path / "audit.log.2.gz"
    old.write_bytes(gzip.compress(b'type=PATH msg=audit(1.0:1): name="/old\xff"\n'))
    os.utime(old, (1000, 1000))
    os.utime(new, (2000, 2000))
    raw = read_raw(spark, str(tmp_path / "audit.log*"), source_pattern=r"/(audit)\.log")
    row = build_events(extract_records(raw)).first()
    assert (row["source"], row["timestamp"], row["paths"]) == ("audit", "1.0", ["/old\ufffd", "/new"])


def test_line_order_holds_across_splits(spark, tmp_path):
    lines = "".join(f'type=PATH msg=audit(1.0:1): name="/{i:05d}"\n' for i in range(3000))
    path = write(tmp_path, "audit.log", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = read_raw(spark, path, "h")
        assert raw.rdd.getNumPartitions() > 4
        row = build_events(extract_records(raw)).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert row["paths"] == [f"/{i:05d}" for i in range(3000)]


def test_tokenise_keeps_last_duplicate(spark):
    df = spark.createDataFrame([('a=1 b="x y" a=2',)], "body string")
    assert [tuple(f) for f in tokenise(df).first()["fields"]] == [("b", "x y"), ("a", "2")]


def test_key_with_timestamp_keeps_restarted_ids_apart(spark, tmp_path):
    text = 'type=CWD msg=audit(1.0:1): cwd="/a"\ntype=CWD msg=audit(9.0:1): cwd="/b"\n'
    path = write(tmp_path, "audit.log", text)
    rows = load_events(spark, raw=path, key=["source", "timestamp", "event_id"]).collect()
    assert sorted((r["timestamp"], r["cwd"]) for r in rows) == [("1.0", "/a"), ("9.0", "/b")]


def test_parsed_events_need_their_columns(spark, tmp_path):
    path = write(tmp_path, "events.csv", "timestamp,comm\n1.5,x\n")
    with pytest.raises(ValueError, match="event_id"):
        load_events(spark, parsed=path)
    path = write(tmp_path, "events2.csv", 'timestamp,event_id,command\n1.5,3,"say ""hi"",\nok"\n')
    row = load_events(spark, parsed=path, source="s").first()
    assert (row["ts_us"], row["command"], row["source"]) == (1500000, 'say "hi",\nok', "s")


def test_a_record_is_searched_once_for_all_its_fields(spark):
    from pyspark.sql import functions as F

    lines = LINES.splitlines() + ['type=SYSCALL msg=audit(5.0:11): comm="\u00e9 \\"x\\"" n\u00e9=1 a=1 a=2', "type=CWD msg=audit(6.0:12):", "type=CWD", None]
    raw = spark.createDataFrame([("h", i, v) for i, v in enumerate(lines)], "source string, pos long, value string")
    records = extract_records(raw)
    assert {r["event_id"] for r in records.collect()} == {"7", "8", "10", "11", "12"}
    got = [tuple(r) for r in field_rows(records, "event_id").where("event_id IN ('10', '11')").collect()]
    assert got == [("10", "syscall", "999"), ("10", "success", "no"), ("10", "uid", "0"), ("11", "comm", '\u00e9 "x"'), ("11", "n\u00e9", "1"), ("11", "a", "2")]
    counted = field_rows(records, "event_id").groupBy("key", "value").agg(F.count("*"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    # two variants of one search, for ASCII and other texts
    assert plan.count("regexp_extract_all") == 2 and plan.count("msg=audit") == 1
