"""Sliding fixed-length event sequences: tokens, numeric features and labels."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom import schema as S
from auditloom.functions import text as X
from auditloom.operators.ordering import CHUNK, POS, Ordered, order_rows
from auditloom.operators.small import attach, checked, solid_keys
from auditloom.operators.windows import with_defaults

OPTIONAL_COLUMNS = [
    "record_types", "primary_type", "syscall", "comm", "exe", "key", "paths", "path", "cwd",
    "record_count", "path_count", "argc", "success", "command", "saddr", "uid", "euid",
    "auid", "attack_run_id",
]
ORDER = ["ts_us", "event_no", "tie"]
CHUNK_BLOCKS = 20_000
LOOKUP_ROWS = 4_000


def path_category(text: Column, key: Column, saddr: Column) -> Column:
    """First path rule that matches the lower-case ``text``, then network evidence, then ``none``."""
    rules = F
    for name, needles in S.PATH_CATEGORIES:
        rules = rules.when(X.contains_any(text, needles), name)
    network = (X.stripped(saddr) != "") | F.lower(key).contains("network")
    return rules.when(network, "network").otherwise("none")


def prepare_sequence_events(df: DataFrame, labels: list[str] | None = None,
                            tie: str | None = None) -> DataFrame:
    """Typed events with the keys that order them: time, numeric id, input order.

    ``labels`` keeps only events with one of these labels; without it events may
    be unlabelled. ``tie`` names a column holding the input order.
    """
    needed = ["timestamp", "event_id"] + (["manual_label"] if labels else [])
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"events are missing required columns: {', '.join(missing)}")
    df = with_defaults(df, OPTIONAL_COLUMNS + ["manual_label"])
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit(""))
    if labels:
        df = df.withColumn("manual_label", F.lower(X.stripped(F.col("manual_label"))))
        df = df.where(F.col("manual_label").isin(labels))
    if "ts_us" not in df.columns:
        df = df.withColumn("ts_us", X.epoch_us(F.col("timestamp")))

    def as_text(name: str) -> Column:
        if df.schema[name].dataType.typeName() == "array":
            return X.joined(F.col(name))
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    texts = ["record_types", "primary_type", "syscall", "comm", "exe", "key", "paths", "path",
             "cwd", "success", "command", "saddr", "uid", "euid", "auid", "argc", "attack_run_id",
             "manual_label"]
    df = df.where(F.col("ts_us").isNotNull()).withColumns({c: as_text(c) for c in texts})
    # columns of their own, so that the rules do not each build the texts again
    df = df.withColumns({"_where": F.lower(F.concat_ws("|", "paths", "path", "cwd")), "_exe": X.stripped(F.col("exe"))})
    return df.withColumns({
        "event_no": F.coalesce(F.col("event_id").try_cast("bigint"), F.lit(-1)),
        "tie": F.col(tie) if tie else F.lit(0),
        "exe_basename": X.basename(F.col("_exe")),
        "path_category": path_category(F.col("_where"), F.col("key"), F.col("saddr")),
    }).drop("_where", "_exe")


def segment_name(value: Column) -> Column:
    return F.coalesce(X.blank_to_null(X.stripped(value)), F.lit("unsegmented"))


def event_numbers(df: DataFrame) -> dict[str, Column]:
    """The numeric features that depend on one event alone, by name."""
    def number(name: str, default: float | None = 0.0) -> Column:
        is_text = df.schema[name].dataType.typeName() == "string"
        return X.number_or(X.numeric_text(F.col(name)) if is_text else F.col(name), default)

    def log_count(name: str) -> Column:
        return F.log1p(F.greatest(number(name), F.lit(0.0)))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    uid, euid, auid = (number(c, None) for c in ("uid", "euid", "auid"))
    return {
        "record_count_log1p": log_count("record_count"),
        "path_count_log1p": log_count("path_count"),
        "argc_log1p": log_count("argc"),
        "success_yes": flag(F.lower("success") == "yes"),
        "success_no": flag(F.lower("success") == "no"),
        "has_command": flag(X.stripped(F.col("command")) != ""),
        "has_saddr": flag(X.stripped(F.col("saddr")) != ""),
        "uid_is_root": flag(uid == 0),
        "euid_is_root": flag(euid == 0),
        "auid_is_unset": flag(auid == int(S.UNSET_AUID)),
        "uid_differs_euid": flag(uid != euid),
    }


def order_events(df: DataFrame, by: list[str], **limits: int) -> Ordered:
    """Events of each segment in order, reduced to what sequences are made of.

    Texts become numbers and token ids first: only a narrow row is sorted.
    """
    numbers = event_numbers(df)
    # a lambda keeps this projection out of whole-stage code, where it becomes one method
    # that the JIT never compiles; outside, its parts are compiled one by one
    flags = F.transform(F.array(*[numbers[c] for c in S.NUMERIC_COLUMNS[1:]]), lambda x: x.cast("float"))
    kept = [*by, *ORDER, "event_id", "manual_label", *[c for c in ("tokens",) if c in df.columns]]
    narrow = df.select(*dict.fromkeys(kept), flags.alias("_flags"))
    return order_rows(narrow, by, ORDER, **limits)


def with_numeric_features(ordered: Ordered) -> Ordered:
    """All numeric features as one array column ``numeric``; the time gap is per segment."""
    ordered = ordered.lag(F.col("ts_us"), "_previous")
    gap = (F.col("ts_us") - F.coalesce("_previous", "ts_us")) / F.lit(X.MICROS)
    gap = F.log1p(F.least(F.greatest(gap, F.lit(0.0)), F.lit(60.0)))
    numeric = F.concat(F.array(gap.cast("float")), "_flags")
    found = ordered.df.withColumn("numeric", numeric).drop("_previous", "_flags")
    return Ordered(found, ordered.by, ordered.spans)


def token(value: Column) -> Column:
    return F.coalesce(X.blank_to_null(X.stripped(value)), F.lit(S.UNKNOWN_TOKEN))


def learn_vocab(df: DataFrame, size: int = 256) -> DataFrame:
    """Rows of ``(column, token, id)``, at most ``size - 2`` tokens per column, ids from 2."""
    tokens = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), token(F.col(c)).alias("token")) for c in S.TOKEN_COLUMNS])))
    counts = tokens.where(~F.col("token").isin(S.PAD_TOKEN, S.UNKNOWN_TOKEN)).groupBy(
        "column", "token").agg(F.count(F.lit(1)).alias("n"))
    best_first = Window.partitionBy("column").orderBy(F.desc("n"), "token")
    ranked = counts.withColumn("_rank", F.row_number().over(best_first))
    return ranked.where(F.col("_rank") <= max(0, size - 2)).select(
        "column", "token", (F.col("_rank") + 1).alias("id"))


def encode(df: DataFrame, vocab: DataFrame, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Token ids of every event as one array column ``tokens``; unseen values are 1.

    A vocabulary of normal size becomes one constant map per column, frequent
    tokens first, so encoding is a projection. A larger one is joined.
    """
    vocab, is_small = checked(vocab, lookup_rows)
    if is_small:
        held: dict[str, dict[str, int]] = {c: {} for c in S.TOKEN_COLUMNS}
        # at most ``lookup_rows`` rows, which are local already
        for row in vocab.orderBy("id", "token").collect():
            if row["column"] in held:
                held[row["column"]][row["token"]] = row["id"]
        maps = {c: F.from_json(F.lit(json.dumps(ids)), "map<string,int>") for c, ids in held.items()}
        rows = df.withColumn("tokens", F.array(*[
            F.coalesce(maps[c][token(F.col(c))], F.lit(S.UNKNOWN_ID)) for c in S.TOKEN_COLUMNS]))
        return rows
    rows = df.withColumns({f"_t_{c}": token(F.col(c)) for c in S.TOKEN_COLUMNS})
    for column in S.TOKEN_COLUMNS:
        ids = vocab.where(F.col("column") == column).select(
            F.col("token").alias(f"_t_{column}"), F.col("id").alias(f"_i_{column}"))
        rows = attach(rows, ids, [f"_t_{column}"])
    tokens = F.array(*[F.coalesce(f"_i_{c}", F.lit(S.UNKNOWN_ID)) for c in S.TOKEN_COLUMNS])
    return rows.withColumn("tokens", tokens).drop(
        *[f"_{k}_{c}" for c in S.TOKEN_COLUMNS for k in "ti"])


def sliding_sequences(ordered: Ordered, length: int = 50, stride: int = 10,
                      min_malicious: int | None = 5,
                      chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """Sequences of ``length`` consecutive events every ``stride`` events.

    Events are folded into blocks of ``stride``; a sequence is a few neighbouring
    blocks. Each event is therefore shuffled once (plus a small overlap between
    chunks of a long segment) rather than once per sequence that contains it.
    Partial tails make no sequence. ``k`` is the number of the sequence within
    its segment. ``min_malicious=None`` leaves the label columns out.
    """
    if length <= 0 or stride <= 0:
        raise ValueError("sequence length and stride must be positive")
    if min_malicious is not None and min_malicious <= 0:
        raise ValueError("the number of malicious events must be positive")
    by, span = ordered.by, -(-length // stride)
    step = F.struct(
        F.col(POS).alias("pos"), "ts_us", "event_id",
        *[F.col(c) for c in ("manual_label", "tokens", "numeric") if c in ordered.df.columns])
    rows = ordered.df.select(*by, CHUNK, POS, step.alias("_step"))
    block = F.floor(F.col(POS) / stride).cast("bigint")
    rows = rows.withColumn("_block", block)
    if stride > length:
        rows = rows.where(F.pmod(F.col(POS), F.lit(stride)) < length)
    if ordered.spans:
        # the first blocks of a chunk also complete sequences of the one before
        home = F.floor(F.col("_block") / chunk_blocks).cast("bigint")
        lead_in = (F.pmod("_block", F.lit(chunk_blocks)) < span - 1) & (home > 0)
        rows = rows.withColumn(CHUNK, F.explode(
            F.when(lead_in, F.array(home, home - 1)).otherwise(F.array(home))))
        rows = rows.repartition(*by, CHUNK)
    blocks = rows.groupBy(*by, CHUNK, "_block").agg(
        F.array_sort(F.collect_list("_step")).alias("_steps"))
    ahead = Window.partitionBy(*by, CHUNK).orderBy("_block").rowsBetween(0, span - 1)
    found = blocks.withColumn("_steps", F.slice(F.flatten(F.collect_list("_steps").over(ahead)), 1, length))
    if ordered.spans:
        found = found.where(F.floor(F.col("_block") / chunk_blocks) == F.col(CHUNK))
    found = found.where(F.size("_steps") == length)
    first, last = F.get("_steps", F.lit(0)), F.get("_steps", F.lit(length - 1))
    columns = {
        "k": F.col("_block"),
        "start_us": first["ts_us"], "end_us": last["ts_us"],
        "start_event_id": first["event_id"], "end_event_id": last["event_id"],
        "event_count": F.lit(length),
    }
    if min_malicious is not None:
        def count(label: str) -> Column:
            return F.size(F.filter("_steps", lambda s: s["manual_label"] == label))

        columns["benign_event_count"] = count("benign")
        columns["malicious_event_count"] = count("malicious")
    for source, target in (("tokens", "x_cat"), ("numeric", "x_num")):
        if source in ordered.df.columns:
            columns[target] = F.col("_steps")[source]
    found = found.select(*by, *[c.alias(n) for n, c in columns.items()])
    if min_malicious is not None:
        is_malicious = F.col("malicious_event_count") >= min_malicious
        found = found.withColumns({
            "sequence_label": F.when(is_malicious, "malicious").otherwise("benign"),
            "y": is_malicious.cast("int"),
        })
    return found


def with_tie(df: DataFrame, tie: str | None) -> tuple[DataFrame, str]:
    """A column that orders events of one time and number: the given one, else a hash of the row."""
    if tie and tie in df.columns:
        return df, tie
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return df.withColumn("row_hash", F.xxhash64(*sorted(plain))), "row_hash"


def segment_sizes(df: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """Events and first appearance per segment, and the size of the largest one."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*ORDER)).alias("_seen"))
    sizes, _ = checked(sizes)
    return sizes, sizes.agg(F.max("_n")).first()[0] or 0


def sequence_starts(sizes: DataFrame, by: list[str], length: int, stride: int, **limits: int) -> DataFrame:
    """First sequence id of every segment, segments counted in first-seen order."""
    count = F.when(F.col("_n") >= length, F.floor((F.col("_n") - length) / stride) + 1).otherwise(0)
    sizes = sizes.withColumn("_count", count.cast("bigint"))
    seen = order_rows(sizes, [], ["_seen", *by], **limits)
    return seen.running("sum", F.col("_count"), "first_id", before=True).df.select(*by, "first_id")


def number_sequences(sequences: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """Global ``sequence_id``: position in the segment plus the ids used before it."""
    numbered = attach(sequences, starts, by)
    return numbered.withColumn("sequence_id", F.col("first_id") + F.col("k")).drop("first_id")


def build_sequences(df: DataFrame, vocab: DataFrame | None = None, length: int = 50,
                    stride: int = 10, segment: str | None = "attack_run_id",
                    labels: list[str] | None = None, min_malicious: int = 5,
                    vocab_size: int = 256, tie: str | None = None, hosts: list[str] | None = None,
                    **limits: int) -> tuple[DataFrame, DataFrame]:
    """Labelled training sequences and the vocabulary used to encode them.

    One log is one run of events. With several, ``hosts`` names the columns that
    tell them apart: no sequence then holds events of two hosts, and the columns
    stay in the result.
    """
    events = prepare_sequence_events(df, labels or ["benign", "malicious"], tie)
    by = [*(hosts or []), "segment"]
    events = events.withColumn("segment", F.col(segment) if segment in events.columns else F.lit("all"))
    events = solid_keys(events, by)
    vocab = learn_vocab(events, vocab_size) if vocab is None else vocab
    sizes, largest = segment_sizes(events, by)
    ordered = with_numeric_features(order_events(encode(events, vocab), by, largest=largest, **limits))
    found = sliding_sequences(ordered, length, stride, min_malicious)
    found = number_sequences(found, sequence_starts(sizes, by, length, stride, **limits), by)
    return found.withColumn("segment_id", segment_name(F.col("segment"))).drop("segment", "k"), vocab


def inference_sequences(df: DataFrame, vocab: DataFrame, length: int = 50, stride: int = 10,
                        by: list[str] | None = None, tie: str | None = None,
                        **limits: int) -> DataFrame:
    """Unlabelled sequences, one segment per source; ``sequence_id`` counts per source."""
    by = ["source"] if by is None else by
    events = encode(prepare_sequence_events(df, None, tie), vocab)
    ordered = with_numeric_features(order_events(events, by, **limits))
    return sliding_sequences(ordered, length, stride, None).withColumnRenamed("k", "sequence_id")


def too_short(df: DataFrame, length: int, by: list[str] | None = None) -> DataFrame:
    """Sources with fewer events than one sequence needs: ``events, needed``."""
    by = ["source"] if by is None else by
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))
    return sizes.where(F.col("events") < length).withColumn("needed", F.lit(length))


def require_sequences(df: DataFrame, length: int, by: list[str] | None = None) -> DataFrame:
    """Fail when a source has fewer events than one sequence needs."""
    by = ["source"] if by is None else by
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    message = F.format_string("only %d events available; need at least %d", F.col("n"), F.lit(length))
    return sizes.withColumn("n", F.when(F.col("n") < length, F.raise_error(message)).otherwise(F.col("n")))
