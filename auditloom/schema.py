"""Column contracts and fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: these names are part of the file formats -----------------

EVENT_COLUMNS = [
    "timestamp", "event_id", "record_types", "primary_type", "syscall", "syscall_num",
    "success", "exit", "arch", "comm", "exe", "command", "argc", "proctitle", "cwd",
    "paths", "path", "path_count", "uid", "euid", "auid", "gid", "egid", "pid", "ppid",
    "tty", "ses", "key", "saddr", "record_count",
]

# Fields copied from the SYSCALL record.
SYSCALL_FIELDS = [
    "success", "exit", "arch", "comm", "exe", "uid", "euid", "auid", "gid", "egid",
    "pid", "ppid", "tty", "ses", "key",
]

# Built-in x86-64 syscall numbers.
SYSCALL_NAMES = {
    "0": "read", "1": "write", "2": "open", "3": "close", "41": "socket", "42": "connect",
    "43": "accept", "44": "sendto", "49": "bind", "50": "listen", "56": "clone",
    "57": "fork", "58": "vfork", "59": "execve", "60": "exit", "61": "wait4",
    "82": "rename", "83": "mkdir", "84": "rmdir", "87": "unlink", "90": "chmod",
    "92": "chown", "105": "setuid", "106": "setgid", "117": "setresuid",
    "119": "setresgid", "231": "exit_group", "257": "openat", "258": "mkdirat",
    "263": "unlinkat", "264": "renameat", "268": "fchmodat", "288": "accept4",
    "322": "execveat",
}

INTERVAL_COLUMNS = [
    "run_id", "chain_id", "target", "delivery", "payload", "category", "privilege",
    "target_start_epoch", "target_end_epoch", "target_start_iso", "target_end_iso",
    "success", "metadata_path",
]

ANCHOR_COLUMNS = [
    "anchor_label", "anchor_phase", "attack_run_id", "attack_chain_id", "attack_payload",
    "attack_category", "attack_delivery", "attack_privilege", "attack_window_start",
    "attack_window_end", "attack_window_start_iso", "attack_window_end_iso",
    "seconds_from_attack_start", "manual_label", "manual_note",
]

REVIEW_COLUMNS = [
    "seconds_from_attack_start", "attack_payload", "attack_delivery", "syscall", "key",
    "comm", "command", "proctitle", "cwd", "manual_label", "manual_note", "timestamp",
    "event_id", "anchor_phase", "attack_run_id", "attack_chain_id", "attack_category",
    "success", "exit", "exe", "path", "paths", "uid", "euid", "auid", "pid", "ppid",
    "tty", "ses",
]

REVIEW_PHASES = ["pre_context", "attack_window", "post_context"]

NETWORK_SYSCALLS = ["socket", "connect", "accept", "accept4", "bind", "listen", "sendto"]

ROOT_ID = "0"
UNSET_AUID = "4294967295"

# Substrings that place an event in a path family (any one is enough).
PATH_FAMILIES = {
    "tmp_path_event_count": ["/tmp", "/var/tmp"],
    "home_path_event_count": ["/home"],
    "etc_path_event_count": ["/etc"],
    "ssh_path_event_count": [".ssh", "authorized_keys"],
    "root_ssh_path_event_count": ["/root/.ssh"],
    "var_log_path_event_count": ["/var/log"],
    "dev_shm_path_event_count": ["/dev/shm"],
}

# First matching rule names the path category of an event.
PATH_CATEGORIES = [
    ("root_ssh", ["/root/.ssh"]),
    ("ssh", [".ssh", "authorized_keys"]),
    ("sudoers", ["/etc/sudoers"]),
    ("identity", ["/etc/passwd", "/etc/shadow", "/etc/group"]),
    ("systemd", ["/etc/systemd", "/lib/systemd"]),
    ("cron", ["/etc/cron", "/var/spool/cron"]),
    ("etc", ["/etc"]),
    ("dev_shm", ["/dev/shm"]),
    ("tmp", ["/tmp", "/var/tmp"]),
    ("home", ["/home"]),
    ("var_log", ["/var/log"]),
    ("proc", ["/proc"]),
]

DISTINCT_FIELDS = [
    "syscall", "primary_type", "exe", "comm", "uid", "euid", "auid", "pid", "ppid",
]

BASE_FEATURES = [
    "event_count", "record_count_sum", "record_count_mean", "path_count_sum",
    "path_count_mean", "execve_count", "command_count", "success_yes_count",
    "success_no_count", "unique_syscall_count", "unique_primary_type_count",
    "unique_exe_count", "unique_comm_count", "unique_uid_count", "unique_euid_count",
    "unique_auid_count", "unique_pid_count", "unique_ppid_count", "root_uid_count",
    "root_euid_count", "unset_auid_count", "network_event_count",
    "tmp_path_event_count", "home_path_event_count", "etc_path_event_count",
    "ssh_path_event_count", "root_ssh_path_event_count", "var_log_path_event_count",
    "dev_shm_path_event_count", "failed_execve_count",
]

LABEL_FEATURES = [
    "label_benign_count", "label_malicious_count", "label_ambiguous_count",
    "label_unlabeled_count", "window_label",
]

# Category families of a window: event column -> feature prefix.
CATEGORY_PREFIXES = {
    "syscall": "syscall",
    "primary_type": "type",
    "key": "key",
    "comm": "comm",
    "exe_basename": "exe",
}

TOKEN_COLUMNS = [
    "record_types", "primary_type", "syscall", "comm", "exe_basename", "key",
    "path_category",
]

NUMERIC_COLUMNS = [
    "delta_time_log1p", "record_count_log1p", "path_count_log1p", "argc_log1p",
    "success_yes", "success_no", "has_command", "has_saddr", "uid_is_root",
    "euid_is_root", "auid_is_unset", "uid_differs_euid",
]

PAD_TOKEN, UNKNOWN_TOKEN = "<PAD>", "<UNK>"
PAD_ID, UNKNOWN_ID = 0, 1

IFOREST_THRESHOLD = 0.153295
COMBINED_THRESHOLD = 0.310117
SEQUENCE_THRESHOLD = 0.5
SEQUENCE_WEIGHT = 0.7
CALIBRATION_RATES = [0.001, 0.0025, 0.005, 0.01, 0.02, 0.05]

# --- row types ---------------------------------------------------------------

POSITION = T.StructType([
    T.StructField("modified", T.TimestampType()),
    T.StructField("file_hash", T.LongType()),
    T.StructField("block_start", T.LongType()),
    T.StructField("line_no", T.LongType()),
])

RAW = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("pos", POSITION),
    T.StructField("value", T.StringType()),
])

EVENT = T.StructType(
    [T.StructField("source", T.StringType())]
    + [
        T.StructField(
            name,
            T.ArrayType(T.StringType()) if name in ("record_types", "paths")
            else T.LongType() if name in ("path_count", "record_count")
            else T.StringType(),
        )
        for name in EVENT_COLUMNS
    ]
    + [T.StructField("ts_us", T.LongType()), T.StructField("first_pos", POSITION)]
)
