"""Text columns as byte buffers inside Arrow tasks, and inputs with fixed columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
SLOTS = 1 << 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def plain(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` alone: other columns of any name are left out, null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def shield(docs: DataFrame) -> DataFrame:
    """``docs`` with its extra columns under names that no operator uses; ``toDF(*docs.columns)`` undoes it."""
    return docs.toDF(*[c if c in ("doc_id", "text", "lang") else f"__extra{i}" for i, c in enumerate(docs.columns)])


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _bits(column: str) -> tuple[Column, Column]:
    """Slot and bit of a hash in a bitmap of fixed size."""
    bit = F.shiftright(F.col(column), 40).bitwiseAND(63).cast("int")
    return F.pmod(F.col(column), F.lit(SLOTS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose hash is in ``wanted``, and a few others by chance; the bitmap that is broadcast never grows."""
    slot, one = _bits(column)
    bits = wanted.groupBy(slot.alias("__slot")).agg(F.bit_or(one).alias("__bits"))
    return rows.join(F.broadcast(bits), slot == F.col("__slot")).where(F.col("__bits").bitwiseAND(one) != 0).drop("__slot", "__bits")


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], held[offsets[0]:offsets[-1]]


def by_bytes(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of text, of one row at least."""
    for batch in batches:
        offsets, _ = byte_view(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def split_words(offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as byte runs that never cross a row.

    ``inside`` marks the bytes of words. Returns starts, ends and, for each row,
    the number of words before it (one more than rows).
    """
    size = len(inside)
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    first = np.zeros(size, bool)
    first[offsets[:-1][offsets[:-1] < size]] = True
    begins = inside & (~before | first)
    after = np.zeros(size + 1, bool)
    after[:-1] = ~inside | begins
    after[size] = True
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(after)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def as_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as one string column.

    Words and the gaps between them tile the buffer, so no text is copied: the
    words are the odd entries of the tiling.
    """
    if not len(starts):
        return pa.array([], pa.large_string())
    tiles = np.empty(2 * len(starts) + 1, np.int64)
    tiles[0::2][:-1] = starts
    tiles[1::2] = ends
    tiles[-1] = len(data)
    whole = pa.Array.from_buffers(pa.large_binary(), len(tiles) - 1, [None, pa.py_buffer(tiles), pa.py_buffer(np.ascontiguousarray(data))])
    return whole.take(pa.array(np.arange(0, len(tiles) - 1, 2)))
