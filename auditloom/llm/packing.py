"""Harmonic packing of token streams into fixed-length training sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.texts import by_bytes, plain
from auditloom.llm.tokens import encoder
from auditloom.shipping import map_arrow

CAPACITY = 4096
CLASSES = 64
SLACK = 0.01
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut_lengths(tokens: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> list[tuple[int, int]]:
    """``(length, class)`` of the pieces of one document, in reading order.

    Class j holds pieces of at most ``capacity // j`` tokens and puts j of them
    into a bin. A length that nearly fills its class, or is small, stays whole.
    Any other length gives off the largest piece that fills the next class
    exactly, so a document ends in a handful of pieces.
    """
    pieces = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        j = capacity // rest
        if j >= classes or j * rest >= capacity * (1 - slack):
            pieces.append((rest, j))
            break
        size = capacity // (j + 1)
        pieces.append((size, j + 1))
        rest -= size
    return pieces


class HarmonicPacker:
    """Open bins of one task: at most one per class, each below one sequence of tokens."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, first_id: int = 0):
        self.capacity, self.classes, self.next_id = capacity, classes, first_id
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), doc_tokens, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        for length, j in cut_lengths(len(ids), self.capacity, self.classes):
            held = self.open.setdefault(j, [])
            held.append((doc_id, start, ids[start:start + length].copy(), len(ids)))
            start += length
            if len(held) == j:
                self._emit(held)
                self.open[j] = []

    def finish(self) -> None:
        """Join what the unfilled bins hold into full sequences.

        The last remainder of a task becomes sequences of power-of-two lengths,
        which need no padding.
        """
        held = [piece for j in sorted(self.open) for piece in self.open[j]]
        left = sum(len(p[2]) for p in held)
        self.open = {}
        room = fill = self.capacity if left >= self.capacity else _power(left)
        taken: list[tuple] = []
        for doc_id, start, ids, doc_tokens in held:
            while len(ids):
                part = ids[:room]
                taken.append((doc_id, start, part, doc_tokens))
                ids, start, room, left = ids[len(part):], start + len(part), room - len(part), left - len(part)
                if not room:
                    self._emit(taken)
                    taken = []
                    room = fill = min(fill, self.capacity if left >= self.capacity else _power(left))


def _power(n: int) -> int:
    return 1 << (n.bit_length() - 1) if n else 0


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids.

    ``ids`` are little-endian unsigned 32-bit values. Every task packs what it
    reads, class by class, without a shuffle; sequence ids start at the task's
    partition number times 2^33. Per task at most one open bin per class is held.

    Null text counts as empty: such a document is its end id alone. A null
    ``doc_id`` is kept. Repeated rows are packed once each. Texts of any length
    are cut; other columns are ignored; an empty table gives no rows.
    """
    def packed(batches):
        packer = HarmonicPacker(capacity, first_id=TaskContext.get().partitionId() << 33)
        for batch in by_bytes(batches):
            ids, bounds = encoder(tokenizer_path).encode(batch.column("text"), end_id)
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(doc_id, ids[bounds[i]:bounds[i + 1]])
            if packer.rows:
                yield _batch(packer)
        packer.finish()
        if packer.rows:
            yield _batch(packer)

    return map_arrow(plain(docs), packed, SCHEMA)


def _batch(packer: HarmonicPacker) -> pa.RecordBatch:
    columns = list(zip(*packer.rows, strict=True))
    packer.rows = []
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
