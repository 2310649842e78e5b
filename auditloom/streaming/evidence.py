"""Evidence of open alerts: state that follows a session until the watermark closes it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom.functions import text as X
from auditloom.operators.alerts import EVIDENCE, PATH_EVIDENCE
from auditloom.shipping import ship
from auditloom.streaming.runs import event_time

# Arbitrary state needs this state store.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SEQUENCES = "sequence_ids"
EVENTS = "event_count"
BLOCK_ROWS = 50_000
# where a value was seen: the order of an event, or more numbers that order it
AT = ("a0", "a1", "a2")
PENDING = pa.schema([("ts", pa.int64()), ("value", pa.string()), *[(a, pa.int64()) for a in AT]])
VALUES = pa.schema([("first", pa.int64()), ("value", pa.string()), ("n", pa.int64()), *[(a, pa.int64()) for a in AT]])


class SessionEvidence(StatefulProcessor):
    """One group and one field: its open sessions, the values seen inside them, and the events not yet placed.

    Rows are held as compressed blocks of Arrow columns, in the state and while they
    are placed; only those of one block are Python objects or columns at a time.
    """

    def __init__(self, gap_us: int, k: int):
        self.gap, self.k = gap_us, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        # lists, read and written whole: a call for each entry costs more than all else
        self.handle = handle
        self.sessions = handle.getListState("sessions", "first long, last long")
        self.values = handle.getListState("values", "block binary")
        self.pending = handle.getListState("pending", "block binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        starts, ends = [], []

        def found() -> Iterator[pa.Table]:
            for frame in rows:
                is_event = frame["is_event"].to_numpy()
                sequences = frame[~is_event]
                starts.append(sequences["start_us"].astype("int64").to_numpy())
                ends.append(sequences["end_us"].astype("int64").to_numpy())
                # the ids of the sequences themselves are found too; each starts inside its session
                yield _rows(sequences if key[-1] == SEQUENCES else frame[is_event])

        blocks = list(_blocks(found()))
        before = self._open()
        sessions = self._merged(before, np.concatenate(starts), np.concatenate(ends))
        values = self._moved([VALUES.empty_table(), *_tables(self.values)], sessions)
        self._keep(self.values, self._place(sessions, blocks, values, timerValues))
        if not np.array_equal(sessions, before):
            self._keep_open(sessions)
            self._wake(sessions)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = self._open()
        over = sessions[:, 1] + self.gap <= now
        done, rest, out = sessions[over], sessions[~over], iter(())
        if len(done):
            values = pa.concat_tables([VALUES.empty_table(), *_tables(self.values)])
            is_done = np.isin(values["first"].to_numpy(), done[:, 0])
            out = self._found(key, done, values.filter(is_done))
            self._keep(self.values, self._place(rest, [], [values.filter(~is_done)], timerValues))
            self._keep_open(rest)
        self._wake(rest)
        return out

    def _found(self, key, done: np.ndarray, values: pa.Table) -> Iterator[pd.DataFrame]:
        """The values of sessions that are over, by rank: all ids of sequences, the ``k`` most frequent of others."""
        best = values.sort_by([("first", "ascending"), ("n", "descending"), *[(a, "ascending") for a in AT], ("value", "ascending")])
        first = best["first"].to_numpy()
        rank = np.arange(len(first)) - np.searchsorted(first, first) + 1
        if key[-1] != SEQUENCES:
            best, first, rank = best.filter(rank <= self.k), first[rank <= self.k], rank[rank <= self.k]
        last = done[np.searchsorted(done[:, 0], first), 1] if len(first) else first
        for at in range(0, len(first), BLOCK_ROWS):
            part = slice(at, at + BLOCK_ROWS)
            block = best.slice(at, BLOCK_ROWS)
            yield pd.DataFrame({
                **{f"k{i}": [k] * block.num_rows for i, k in enumerate(key)}, "start_us": first[part], "end_us": last[part],
                "value": block["value"].to_pandas(), "n": block["n"].to_numpy(), "rank": rank[part].astype("int32")})

    def _open(self) -> np.ndarray:
        """Open sessions, first and last moment, in order."""
        return np.array(sorted(map(tuple, self.sessions.get())), dtype="int64").reshape(-1, 2)

    def _keep_open(self, sessions: np.ndarray) -> None:
        if len(sessions):
            self.sessions.put(list(map(tuple, sessions.tolist())))
        else:
            self.sessions.clear()

    @staticmethod
    def _keep(state, blocks: list[bytes]) -> None:
        state.clear()
        # one at a time: a message holds all it sends several times
        for block in blocks:
            state.appendValue((block,))

    def _wake(self, sessions: np.ndarray) -> None:
        """One timer, at the first end: it finds all that are over by then and sets the next."""
        if len(sessions):
            self.handle.registerTimer((int(sessions[:, 1].min()) + self.gap) // 1000 + 1)

    def _merged(self, old: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Open sessions after new sequences: what starts within the gap of the latest end so far belongs together."""
        if not len(starts):
            return old
        first, last = np.concatenate([old[:, 0], starts]), np.concatenate([old[:, 1], ends])
        order = np.lexsort((last, first))
        first, reach = first[order], np.maximum.accumulate(last[order])
        begins = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1] + self.gap]))
        return np.column_stack([first[begins], reach[np.concatenate([begins[1:] - 1, [len(reach) - 1]])]])

    @staticmethod
    def _moved(values: list[pa.Table], sessions: np.ndarray) -> list[pa.Table]:
        """Values of sessions that grew together, under the session that now holds theirs."""
        def moved(table: pa.Table) -> pa.Table:
            if not table.num_rows:
                return table
            at = np.searchsorted(sessions[:, 0], table["first"].to_numpy(), side="right") - 1
            return table.set_column(0, "first", pa.array(sessions[at, 0]))

        return [moved(t) for t in values]

    def _place(self, sessions: np.ndarray, new: list[bytes], values: list[pa.Table], timerValues) -> list[bytes]:
        """Count events inside sessions; keep those that a session may still reach, let the others go."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        counted = [VALUES.empty_table(), *values]

        def kept() -> Iterator[pa.Table]:
            for rows in chain(_tables(self.pending), map(_unpacked, new)):
                ts = rows["ts"].to_numpy()
                reachable = ts > now
                inside = np.zeros(len(ts), dtype=bool)
                if len(sessions):
                    at = np.minimum(np.searchsorted(sessions[:, 1], ts), len(sessions) - 1)
                    inside = (sessions[at, 0] <= ts) & (ts <= sessions[at, 1])
                    reachable |= ts >= sessions[0, 0]
                    seen = rows.filter(inside)
                    columns = [pa.array(sessions[at[inside], 0]), seen["value"], pa.array(np.ones(seen.num_rows, dtype="int64")), *[seen[a] for a in AT]]
                    counted.append(_counted(pa.table(columns, schema=VALUES)))
                yield rows.filter(reachable & ~inside)

        self._keep(self.pending, list(_blocks(kept())))
        return list(_blocks([_counted(pa.concat_tables(counted))]))


def _rows(frame: pd.DataFrame) -> pa.Table:
    numbers = {c: frame[c].astype("int64").to_numpy() for c in ("start_us", *AT)}
    return pa.table([numbers["start_us"], pa.array(frame["value"], pa.string()), *[numbers[a] for a in AT]], schema=PENDING)


def _counted(values: pa.Table) -> pa.Table:
    """One row for each session and value: how often it was seen, and its least place."""
    if not values.num_rows:
        return values
    ordered = values.sort_by([(a, "ascending") for a in AT])
    found = ordered.group_by(["first", "value"], use_threads=False).aggregate([("n", "sum"), *[(a, "first") for a in AT]])
    return pa.table([found["first"], found["value"], found["n_sum"], *[found[f"{a}_first"] for a in AT]], schema=VALUES)


def _blocks(tables: Iterable[pa.Table]) -> Iterator[bytes]:
    """The rows of many tables in blocks of about ``BLOCK_ROWS``."""
    held, n = [], 0
    for table in tables:
        for at in range(0, table.num_rows, BLOCK_ROWS):
            held.append(table.slice(at, BLOCK_ROWS))
            n += held[-1].num_rows
            if n >= BLOCK_ROWS:
                yield _packed(held)
                held, n = [], 0
    if n:
        yield _packed(held)


def _packed(tables: list[pa.Table]) -> bytes:
    rows, sink = pa.concat_tables(tables).combine_chunks(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _tables(state) -> Iterator[pa.Table]:
    return (_unpacked(block) for block, in state.get())


def _parts(events: DataFrame, name: str) -> Column:
    if name not in events.columns:
        return F.array().cast("array<string>")
    if events.schema[name].dataType.typeName() == "array":
        return F.flatten(F.transform(name, lambda v: F.split(v, r"\|")))
    return F.split(F.coalesce(name, F.lit("")), r"\|")


def stream_alert_evidence(events: DataFrame, sequences: DataFrame, gap_us: int = 5 * X.MICROS, k: int = 8, order: str = "ts_us",
                          watermark: str = "1 minute", by: list[str] | None = None, fields: dict[str, str] | None = None) -> DataFrame:
    """Evidence of every alert once the watermark has closed it: ``by..., field, start_us, end_us, value, n, rank``.

    Sequences with ``combined_alert = 1`` that start within ``gap_us`` of the
    latest end so far are one alert, named by its start. For each field the ``k``
    most frequent values of the events between the alert's bounds come out, ties
    by the least ``order`` (a whole-number column), as in ``alerts.top_values``
    and ``alerts.top_paths``; the field ``sequence_ids`` lists all its sequences in
    order, ``event_count`` counts its events. Run it with ``SETTINGS``.

    State is kept by group and field, so one busy host is spread over its fields:
    open sessions, one entry for each value inside them, and the events that an
    open session may still reach. A timer at the first end of a session plus the
    gap releases it and is set anew for the next. Rows later than the watermark are dropped and counted in the run's
    progress.
    """
    if gap_us < 0 or k <= 0:
        raise ValueError("the alert gap must not be negative and the number of top values must be positive")
    by = ["source"] if by is None else by
    ship(events.sparkSession)
    fields = EVIDENCE if fields is None else fields
    number = F.col(order).cast("bigint")

    def places(*numbers: Column | int) -> list[Column]:
        given = [*numbers, 0, 0][:len(AT)]
        return [(F.lit(n) if isinstance(n, int) else n).cast("bigint").alias(a) for a, n in zip(AT, given, strict=True)]

    def entry(name: str, value: Column, *at: Column | int) -> Column:
        return F.struct(F.lit(name).alias("field"), value.alias("value"), *places(*at))

    def paths(name: str, column_no: int) -> Column:
        return F.transform(_parts(events, name), lambda v, i: entry(PATH_EVIDENCE, X.stripped(v), column_no, number, i))

    single = [entry(name, X.stripped(F.col(c).cast("string")), number) for name, c in fields.items()]
    values = F.concat(F.array(*single), paths("path", 0), paths("paths", 1))
    seen = events.select(*by, F.col("ts_us").alias("start_us"), F.col("ts_us").alias("end_us"), F.inline(values)).where("value <> ''")
    whole = events.select(*by, F.col("ts_us").alias("start_us"), F.col("ts_us").alias("end_us"), F.inline(F.array(entry(EVENTS, F.lit(""), number))))
    names = F.array(*[F.lit(n) for n in [*fields, PATH_EVIDENCE, EVENTS, SEQUENCES]])
    spans = sequences.where("combined_alert = 1").select(
        *by, "start_us", "end_us", F.explode(names).alias("field"), F.col("sequence_id").cast("string").alias("value"),
        *places(F.col("start_us"), F.col("end_us"), F.col("sequence_id")))
    rows = seen.unionByName(whole).withColumn("is_event", F.lit(True)).unionByName(spans.withColumn("is_event", F.lit(False)))
    rows = rows.withColumn("event_time", event_time("start_us")).withWatermark("event_time", watermark)
    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in by]
    schema = ", ".join([*[f"k{i} {kind}" for i, (_, kind) in enumerate(kinds)], f"k{len(by)} string", "start_us long, end_us long, value string, n long, rank int"])
    found = rows.groupBy(*by, "field").transformWithStateInPandas(SessionEvidence(gap_us, k), schema, "Append", "EventTime")
    return found.withColumnsRenamed({f"k{i}": c for i, c in enumerate([*by, "field"])})
