"""SimHash fingerprints of whole texts and their near-duplicate groups."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.components import components
from auditloom.llm.gray_index import least_linked
from auditloom.llm.texts import LOWER, SPACE, by_bytes, byte_view, plain, shield, split_words
from auditloom.session import materialise
from auditloom.shipping import map_arrow

SEED = 42
RADIUS = 2
GROUP_ROWS = 1 << 14
GROUP_CODES = 1 << 16


def shingle_hashes(offsets: np.ndarray, data: np.ndarray, words: int):
    """Yield the hashes of each text's shingles of ``words`` words, repeats included."""
    low = LOWER[data]
    starts, ends, bounds = split_words(offsets, ~SPACE[low])
    # words joined by single blanks
    lengths = ends - starts + 1
    place = np.concatenate(([0], np.cumsum(lengths)))
    take = np.repeat(starts - place[:-1], lengths) + np.arange(place[-1])
    text = low[np.minimum(take, max(len(low) - 1, 0))] if len(take) else low[:0]
    text[place[1:] - 1] = 32
    text = text.tobytes()
    begin, stop = place[:-1].tolist(), (place[1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        span = min(words, last - first)
        total = last - first - span + 1 if span else 0
        yield np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin[first:first + total], stop[first + span - 1:last], strict=True)), np.uint64, total) if total else np.zeros(0, np.uint64)


def fingerprints_of(offsets: np.ndarray, data: np.ndarray, words: int = 3) -> np.ndarray:
    """64-bit fingerprints of texts in a byte buffer."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for row, hashes in enumerate(shingle_hashes(offsets, data, words)):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at:at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if len(hashes):
            out[row] = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, own, code)`` of every row: its id, its text's hash and its fingerprint's bits as a long."""
    def coded(batches):
        for batch in by_bytes(batches):
            codes = fingerprints_of(*byte_view(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), pa.array(codes.view(np.int64))], ["doc_id", "own", "code"])

    return map_arrow(plain(docs).withColumn("own", F.xxhash64("text")), coded, "doc_id long, own long, code long")


def _splits(free: list[int], parts: int, agree: int) -> list[int]:
    """Masks of ``agree`` of ``parts`` blocks of the free bits, as signed longs."""
    blocks = [sum(1 << b for b in block.tolist()) for block in np.array_split(np.array(free), parts)]
    masks = [sum(chosen) for chosen in itertools.combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _mask_bits(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def links(codes: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``(a, b)`` that join all distinct codes within ``radius`` of each other.

    Codes within two bits agree in two of four blocks of bits, whichever bits
    differ. So each code is filed under the six masked patterns of two blocks,
    the upper nodes of the index; patterns held by one code are dropped. A
    pattern with more than ``group_rows`` codes is divided by masks of one of
    three blocks of its free bits, again and again. As masks fix 32, 42 and 49
    bits and more, a group ends below 2^15 codes whatever the data. Inside a
    group the Gray-order index finds the pairs, and each code is linked to the
    least one it reaches: one link a code and pattern, not all pairs.
    """
    if radius > 2:
        raise ValueError("the masks cover a radius of two bits")
    level = [(m, None) for m in _splits(list(range(64)), 4, 2)]
    rows = codes.select("code").withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m, _ in level])))
    found = []
    while True:
        keyed = rows.withColumn("key", F.col("code").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = materialise(keyed.join(sizes, ["mask", "key"]), "simhash-groups")
        found.append(_search(sized.where(F.col("n") <= group_rows), radius))
        masks = [r[0] for r in sized.where(F.col("n") > group_rows).select("mask").distinct().collect()]  # some hundreds at most
        finer = {m: [m | s for s in _splits(_mask_bits(m), 3, 1)] for m in masks if len(_mask_bits(m)) > 15}
        last = [m for m in masks if m not in finer]
        if last:
            found.append(_search(sized.where((F.col("n") > group_rows) & F.col("mask").isin(last)), radius))
        if not finer:
            break
        choice = F.create_map(*[x for m, s in finer.items() for x in (F.lit(m), F.array(*[F.lit(v) for v in s]))])
        rows = sized.where((F.col("n") > group_rows) & F.col("mask").isin(list(finer))).select("code", F.explode(choice[F.col("mask")]).alias("mask"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _search(sized: DataFrame, radius: int) -> DataFrame:
    """Links inside the groups of equal ``(mask, key)``, many groups at a time."""
    def near(batches):
        held: list[np.ndarray] = []
        count = 0

        def linked(rows: np.ndarray):
            # a group's own number takes the place of the masked bits, which all its codes share
            edge = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
            group = np.concatenate(([0], np.cumsum(edge)))
            code = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            size = np.bincount(group)
            small = size[group] <= 16
            target = np.arange(len(rows))
            a, b = [], []
            for lag in range(1, 16):
                at = np.flatnonzero(small[:-lag] & (group[:-lag] == group[lag:]))
                if not len(at):
                    break
                at = at[np.bitwise_count(code[at] ^ code[at + lag]) <= radius]
                a.append(at)
                b.append(at + lag)
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            for g in np.flatnonzero(size > 16):
                part = slice(starts[g], starts[g] + size[g])
                target[part] = starts[g] + least_linked(code[part], radius)
            moved = np.flatnonzero(target != np.arange(len(rows)))
            a, b = np.concatenate([target[moved], *a]), np.concatenate([moved, *b])
            signed = rows[:, 2]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(signed[a], signed[b])), pa.array(np.maximum(signed[a], signed[b]))], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "code")], axis=1).astype(np.int64)
            if not len(rows):
                continue
            held.append(rows)
            count += len(rows)
            if count >= GROUP_CODES:
                rows = np.concatenate(held)
                last = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
                keep = last[-1] + 1 if len(last) else 0
                if keep:
                    yield linked(rows[:keep])
                held, count = [rows[keep:]], len(rows) - keep
        if count:
            yield linked(np.concatenate(held))

    dealt = sized.select("mask", "key", "code").repartition("mask", "key").sortWithinPartitions("mask", "key", "code")
    return map_arrow(dealt, near, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = 3) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Words are runs of non-blank characters of the whole text with A-Z lowered;
    shingles are ``words`` words joined by blanks, repeats included. A text of
    fewer words is one shingle; a text without words (null, empty) has
    fingerprint zero and is linked like any other. A bit is set when over half
    of the shingles' hashes have it. ``component_id`` is the least ``doc_id``
    reachable over fingerprints that differ in at most ``radius`` bits.

    Copies share one fingerprint and are compared once. Repeated rows come back
    as often as they went in; a null ``doc_id`` never names a component unless
    all its members are null; an empty table gives no rows.
    """
    return _grouped(docs, radius, words).select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, radius: int, words: int = 3) -> DataFrame:
    """``doc_id, own, code, part, component_id`` of every row; ``part`` numbers the components by code."""
    coded = materialise(fingerprints(docs, words), "simhash-codes")
    codes = materialise(coded.groupBy("code").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    parts = components(links(codes, radius))
    classes = codes.join(parts, F.col("code") == F.col("node"), "left").select("code", "least_id", F.coalesce("component", "code").alias("part"))
    least = classes.groupBy("part").agg(F.min("least_id").alias("component_id"))
    classes = classes.join(least, "part").select(F.col("code").alias("__code"), "part", "component_id")
    return coded.join(classes, F.col("code") == F.col("__code")).drop("__code")


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``docs`` with all columns, one row of each ``part`` of ``grouped`` (``doc_id, own, part`` of every row)."""
    no_id = F.lit(-(1 << 63)).cast("long")
    ranked = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", no_id).alias("id"), "own")
    first = grouped.groupBy("part").agg(F.min(ranked).alias("row"))
    first = first.select(F.col("row.id").alias("__first"), F.col("row.own").alias("__first_own")).distinct()
    rows = shield(docs)
    keyed = rows.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), no_id), "__own": F.xxhash64(F.coalesce("text", F.lit("")))})
    chosen = keyed.join(first, (F.col("__id") == F.col("__first")) & (F.col("__own") == F.col("__first_own")), "left_semi")
    return chosen.dropDuplicates(["__id", "__own"]).select(*rows.columns).toDF(*docs.columns)


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with all columns, one row of each near-duplicate group.

    The row with the least ``doc_id`` stays (null last); of rows with one id the
    one with the least hash of its text, and of rows alike in both, one.
    """
    return keep_first(docs, _grouped(docs, radius))
