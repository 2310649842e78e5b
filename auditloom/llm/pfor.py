"""Token ids in patched frame-of-reference files, and reading them back.

A file holds the ids of consecutive documents:

======== =============================================================
bytes    content
======== =============================================================
8        ``b"PFOR0001"``
4 x 8    u64: ids, documents, blocks, ids per block
8 x d    i64 document id of each document (0 where null)
1 x d    u8: 1 where the document id is null
8 x d    u64 ids up to and with each document
8 x b    u64 first byte of each block, from the end of the header
4 x b    u32 least id of each block
1 x b    u8 bit width of each block
...      blocks: packed differences, then exceptions
======== =============================================================

A block stores ``id - least`` in its width, least bit first. The width covers a
chosen percentile of the differences; those that need more bits follow as a
list: u16 count, u16 positions, u32 differences. All numbers are little-endian.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm import shared_files
from auditloom.llm.texts import by_bytes, plain
from auditloom.llm.tokens import encoder
from auditloom.session import materialise
from auditloom.shipping import map_arrow

MAGIC = b"PFOR0001"
BLOCK = 512
FILE_IDS = 4 << 20
PERCENTILES = (75, 90, 95, 99, 100)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of u32 values as rows of bytes, ``width`` bits a value, least bit first."""
    bits = np.unpackbits(values.view(np.uint8).reshape(len(values), -1, 4), axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, bitorder="little")[:, :count * width].reshape(len(packed), count, width)
    wide = np.zeros((len(packed), count, 32), np.uint8)
    wide[:, :, :width] = bits
    return np.packbits(wide, axis=2, bitorder="little").view(np.uint32)[:, :, 0]


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Payload, least id and width of each block; the last block may be shorter."""
    whole = len(ids) // block
    payloads: list[bytes] = []
    least, widths = [], []
    pieces = [ids[:whole * block].reshape(whole, block)] if whole else []
    if len(ids) % block:
        pieces.append(ids[whole * block:].reshape(1, -1))
    for rows in pieces:
        low = rows.min(axis=1)
        gaps = (rows - low[:, None]).astype(np.uint32)
        n = rows.shape[1]
        ranked = np.sort(gaps, axis=1)
        at = [min(n - 1, -(-n * p // 100) - 1) for p in PERCENTILES]
        bits = np.ceil(np.log2(ranked[:, at].astype(np.float64) + 1)).astype(np.int64)
        beyond = np.stack([(ranked >> np.minimum(bits[:, i], 31)[:, None].astype(np.uint32) > 0).sum(axis=1) for i in range(len(at))], 1)
        cost = bits * n + beyond * 48
        best = bits[np.arange(len(rows)), cost.argmin(axis=1)]
        body: list = [b""] * len(rows)
        for width in np.unique(best):
            chosen = np.flatnonzero(best == width)
            for part in np.array_split(chosen, max(1, len(chosen) // 512)):
                packed = _pack(gaps[part], int(width)) if width else np.zeros((len(part), 0), np.uint8)
                large = gaps[part] >> np.uint32(width) > 0 if width < 32 else np.zeros_like(gaps[part], bool)
                for i, row, over in zip(part, packed, large, strict=True):
                    where = np.flatnonzero(over).astype(np.uint16)
                    body[i] = row.tobytes() + np.uint16(len(where)).tobytes() + where.tobytes() + gaps[i][where].tobytes()
        payloads += body
        least.append(low)
        widths.append(best)
    joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return payloads, joined(least, np.uint32), joined(widths, np.uint8)


def encode_file(doc_ids: list, bounds: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A whole file; ``bounds`` are the ids before each document, and all at the end."""
    payloads, least, widths = encode_blocks(ids, block)
    starts = np.cumsum([0, *map(len, payloads)])[:len(payloads)].astype(np.uint64)
    head = np.array([len(ids), len(doc_ids), len(payloads), block], np.uint64)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    parts = [MAGIC, head, keys, nulls, np.asarray(bounds[1:], np.uint64), starts, least, widths]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts) + b"".join(payloads)


class TokenFile:
    """A file of ``encode_file``: documents by number, any range of ids by block."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.data, self.at = data, 8
        self.n_ids, n_docs, n_blocks, self.block = map(int, self._take(np.uint64, 4))
        keys, nulls = self._take(np.int64, n_docs), self._take(np.uint8, n_docs)
        self.doc_ids = [None if n else int(k) for k, n in zip(keys, nulls, strict=True)]
        self.ends = self._take(np.uint64, n_docs).astype(np.int64)
        self.starts = self._take(np.uint64, n_blocks).astype(np.int64)
        self.least = self._take(np.uint32, n_blocks)
        self.widths = self._take(np.uint8, n_blocks)

    def _take(self, kind, count: int) -> np.ndarray:
        found = np.frombuffer(self.data, kind, count, self.at)
        self.at += found.nbytes
        return found

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last - 1``."""
        count = np.minimum(self.block, self.n_ids - np.arange(first, last) * self.block)
        out = np.zeros((last - first, self.block), np.uint32)
        widths = self.widths[first:last].astype(np.int64)
        size = (count * widths + 7) // 8
        at = self.at + self.starts[first:last]
        whole = np.frombuffer(self.data, np.uint8)
        for width, n in {(int(w), int(c)) for w, c in zip(widths, count, strict=True) if w}:
            chosen = np.flatnonzero((widths == width) & (count == n))
            bytes_each = (n * width + 7) // 8
            out[chosen, :n] = _unpack(whole[at[chosen][:, None] + np.arange(bytes_each)], width, n)
        for i in range(last - first):
            begin = int(at[i] + size[i])
            n = int(np.frombuffer(self.data, np.uint16, 1, begin)[0])
            if n:
                where = np.frombuffer(self.data, np.uint16, n, begin + 2)
                out[i, where] = np.frombuffer(self.data, np.uint32, n, begin + 2 + 2 * n)
        out += self.least[first:last, None]
        return out.reshape(-1)[:int(count.sum())]

    def documents(self, step: int = 512) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, ids before it in the file, its ids)`` in file order."""
        held, base = np.zeros(0, np.uint32), 0
        start, block = 0, 0
        for doc_id, end in zip(self.doc_ids, self.ends.tolist(), strict=True):
            while base + len(held) < end:
                last = min(block + step, len(self.starts))
                held, base, block = np.concatenate((held[start - base:], self.blocks(block, last))), start, last
            yield doc_id, start, held[start - base:end - base]
            start = end


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents in ascending ``doc_id`` order; return the list of files.

    Columns: ``file``, ``start`` (ids in the files before it), ``n_ids``,
    ``n_docs``. Documents are dealt out by ranges of ``(doc_id, hash of text)``,
    so neither one id nor many equal ones decide a task's share. A task writes a
    file whenever it holds ``FILE_IDS`` ids (a longer document gets a file of its
    own) and needs no more memory than that.

    Null text counts as empty (its end id alone). Null ids come first. Repeated
    rows are written once each. Other columns are ignored; an empty table gives
    no files.
    """
    spark = docs.sparkSession
    folder = folder or shared_files.new_folder(spark, "token-files")
    rows = plain(docs).withColumn("tie", F.xxhash64("text"))

    def written(batches):
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, bounds, held = [], [0], []

        def flush():
            nonlocal number, doc_ids, bounds, held
            ids = np.concatenate(held)
            name = shared_files.put(folder, f"{part:07d}-{number:05d}.pfor", encode_file(doc_ids, np.array(bounds), ids))
            row = pa.RecordBatch.from_pydict({"file": [name], "part": [part], "number": [number], "n_ids": [len(ids)], "n_docs": [len(doc_ids)]})
            number, doc_ids, bounds, held = number + 1, [], [0], []
            return row

        for batch in by_bytes(batches):
            ids, ends = encoder(tokenizer_path).encode(batch.column("text"), end_id)
            keys = batch.column("doc_id").to_pylist()
            at = 0
            while at < len(keys):  # as many documents as fit
                room = ends[at] + FILE_IDS - bounds[-1]
                stop = min(max(int(np.searchsorted(ends, room, "right")) - 1, at), len(keys))
                if stop == at:
                    if doc_ids:
                        yield flush()
                        continue
                    stop = at + 1
                held.append(ids[ends[at]:ends[stop]])
                bounds += (bounds[-1] + ends[at + 1:stop + 1] - ends[at]).tolist()
                doc_ids += keys[at:stop]
                at = stop
        if doc_ids:
            yield flush()

    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    files = materialise(map_arrow(dealt, written, "file string, part long, number long, n_ids long, n_docs long"), "token-manifest")
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("start"), "n_ids", "n_docs")


def read_tokens(files: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32``."""
    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = [(d, base + s, len(ids), zlib.crc32(ids.tobytes())) for d, s, ids in TokenFile(shared_files.get(name)).documents()]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    dealt = files.select("file", "start").repartition(max(1, files.count()), "file")  # a file is a task's work
    return map_arrow(dealt, read, "doc_id long, start long, n_tokens long, ids_crc32 long")
