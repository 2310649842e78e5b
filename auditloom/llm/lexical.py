"""Ranked lexical search over bit-sliced Bloom signatures."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm import item_blocks
from auditloom.llm.decontaminate import words_of
from auditloom.llm.packed import scramble
from auditloom.llm.texts import by_bytes
from auditloom.operators.small import checked
from auditloom.session import materialise
from auditloom.shipping import map_arrow

TOP = 20
LEVELS = 6           # occurrences 1, 2-3, 4-7, 8-15, 16-31 and more each have entries of their own
HASHES = 6
BITS = 10            # rows of a signature for each entry of its fullest document
ROWS_A_BLOCK = 512
CELLS = 1 << 23      # rows x documents of a block at most, or eight documents
INDEX = "docs long, terms long, doc_ids array<bigint>, n array<bigint>, n_rows int, slices binary"
LAST = (1 << 63) - 1  # a null id ranks behind all others


@dataclass(frozen=True)
class Items:
    """The items of a block: their terms by number, repeats counted."""

    ids: pa.Array
    terms: pa.Array         # distinct, as bytes
    number: np.ndarray      # term numbers, item after item
    times: np.ndarray
    first: np.ndarray       # where each item begins in ``number``, one more than items


def item_terms(table: pa.Table) -> Items:
    """Items of a block without those that have no term."""
    _, _, bounds, words = words_of(table.column("text"))
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    width = max(len(coded.dictionary), 1)
    keys, times = np.unique(row * width + number, return_counts=True)
    held = np.flatnonzero(np.diff(bounds))
    first = np.searchsorted(keys // width, np.append(held, len(bounds)))
    return Items(table.column("item_id").combine_chunks().take(pa.array(held)), coded.dictionary, keys % width, times, first)


def document_terms(column) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a column, their number, row and count for each pair, and the length of each row."""
    _, _, bounds, words = words_of(column)
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(bounds)
    width = max(len(coded.dictionary), 1)
    keys, times = np.unique(np.repeat(np.arange(len(n)), n) * width + number, return_counts=True)
    return coded.dictionary, keys % width, keys // width, times, n


def term_hashes(terms: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms.to_pylist()), np.uint64, len(terms))


def places(hashes: np.ndarray, level: int, n_rows: int) -> np.ndarray:
    """The rows of ``(term, level)`` in a signature of ``n_rows`` rows."""
    mixed = scramble(hashes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & LAST))
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    at = (mixed & np.uint64(0xFFFFFFFF))[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return (at % np.uint64(n_rows)).astype(np.int64)


def levels_of(times: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(times).astype(np.int64), LEVELS - 1)


def signature(hashes, number, row, level, docs: int, n_rows: int) -> np.ndarray:
    """Bit slices: one row of document bits for each place; an entry for each level that a term reaches."""
    bits = np.zeros((n_rows, docs), np.uint8)
    for at in range(LEVELS):
        reached = level >= at
        if not reached.any():
            break
        bits[places(hashes[number[reached]], at, n_rows).ravel(), np.repeat(row[reached], HASHES)] = 1
    return np.packbits(bits, axis=1)


def build_index(docs: DataFrame) -> DataFrame:
    """Signatures of all documents, written once: one row for each block of documents of alike size.

    A document enters every distinct term once for each level its count reaches
    (1, 2, 4, ... occurrences). Documents of one slice of the input are put
    together by their number of entries, so a long one does not fill, or widen,
    the signatures of short ones. Documents without terms are left out. No row is
    shuffled; the index is about an eighth of the texts.
    """
    def indexed(batches):
        for batch in by_bytes(batches):
            terms, number, row, times, n = document_terms(batch.column("text"))
            hashes, level = term_hashes(terms), levels_of(times)
            entries = np.bincount(row, level + 1, len(n)).astype(np.int64)
            size = np.zeros(len(n), np.int64)
            size[entries > 0] = np.ceil(2 * np.log2(entries[entries > 0]))
            first = np.searchsorted(row, np.arange(len(n) + 1))
            ids = batch.column("doc_id")
            for kind in np.unique(size[entries > 0]):
                n_rows = int(math.ceil(BITS * 2 ** (kind / 2)))
                members = np.flatnonzero((size == kind) & (entries > 0))
                step = min(ROWS_A_BLOCK, max(8, CELLS // n_rows // 8 * 8))
                for start in range(0, len(members), step):
                    part = members[start:start + step]
                    held = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
                    local = np.repeat(np.arange(len(part)), first[part + 1] - first[part])
                    slices = signature(hashes, number[held], local, level[held], len(part), n_rows)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([len(part)]), pa.array([int(n[part].sum())]),
                        pa.array([ids.take(pa.array(part)).to_pylist()], pa.list_(pa.int64())), pa.array([n[part].tolist()], pa.list_(pa.int64())),
                        pa.array([n_rows], pa.int32()), pa.array([slices.tobytes()], pa.binary())],
                        ["docs", "terms", "doc_ids", "n", "n_rows", "slices"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(map_arrow(rows, indexed, INDEX), "lexical-index")


def frequencies(docs: DataFrame, path: str) -> dict[int, int]:
    """Documents that hold each term of an item block, by term number; counted in tasks, at most a block's terms return."""
    def counted(batches):
        terms = item_blocks.load(path).terms
        found = np.zeros(len(terms), np.int64)
        for batch in by_bytes(batches):
            held, number, *_ = document_terms(batch.column("text"))
            at = pc.index_in(held, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)[number]
            found += np.bincount(at[at >= 0], minlength=len(terms))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "df"])

    rows = map_arrow(docs.select("text"), counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}


def term_share(times, n, docs: int, terms: int) -> np.ndarray:
    """The score's part of a term, before its weight, in whole numbers."""
    m = 100 - 25 + (25 * n * docs) // terms
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def upper_bounds(slices: np.ndarray, n: np.ndarray, items: Items, hashes: np.ndarray, weight: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Items x documents: no score is above its bound.

    A term counts as present where all its rows are set, with as many
    occurrences as the highest level that is set allows.
    """
    n_rows, count = len(slices), len(n)
    parts = np.zeros((len(hashes), count))
    live = np.arange(len(hashes))
    for level in range(LEVELS):
        there = np.bitwise_and.reduce(slices[places(hashes[live], level, n_rows)], axis=1)
        kept = there.any(axis=1)
        live, there = live[kept], np.unpackbits(there[kept], axis=1, count=count).view(bool)
        if not len(live):
            break
        if level:
            there &= parts[live] > 0
        most = n if level == LEVELS - 1 else np.minimum(n, 2 ** (level + 1) - 1)
        share = term_share(most, n, docs, terms)
        # weights and shares are whole and small: products and sums are exact in doubles
        parts[live] = np.where(there, np.maximum(weight[live, None], 1e-9) * share, parts[live])
    bounds = np.empty((len(items.ids), count))
    for i, (a, b) in enumerate(zip(items.first[:-1], items.first[1:], strict=True)):
        bounds[i] = items.times[a:b] @ parts[items.number[a:b]]
    return bounds


def exact_scores(column, wanted: list[np.ndarray], items: Items, weight: np.ndarray, docs: int, terms: int):
    """``(row, item, score)`` of the wanted items of each row, from the whole text."""
    held, number, row, times, n = document_terms(column)
    at = pc.index_in(held, value_set=items.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.searchsorted(row, np.arange(len(n) + 1))
    for i, asked in enumerate(wanted):
        part = slice(first[i], first[i + 1])
        known = at[number[part]]
        value = np.zeros(len(items.terms), np.int64)
        value[known[known >= 0]] = (weight[known[known >= 0]] * term_share(times[part][known >= 0], int(n[i]), docs, terms)) if n[i] else 0
        for item in asked:
            a, b = items.first[item], items.first[item + 1]
            yield i, int(item), int(items.times[a:b] @ value[items.number[a:b]])


def _best(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` best rows of each item: first within 64 groups of tasks, then of all."""
    order = [F.desc(value), F.col("doc_id").isNull(), F.asc("doc_id")]
    part = rows.withColumn("_salt", F.spark_partition_id() % 64)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    return part.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search_block(docs: DataFrame, index: DataFrame, path: str, k: int = TOP) -> DataFrame:
    """``item, rank, doc_id, score`` of one block of items; ``item`` is its number in the block."""
    totals = index.agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = totals[0] or 0, max(totals[1] or 0, 1)
    df = frequencies(docs, path)

    def weights(items: Items) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(items.terms))], np.int64)

    def bounded(floors: dict[int, int] | None):
        def run(batches):
            items = item_blocks.load(path)
            hashes, weight = term_hashes(items.terms), weights(items)
            least = np.ones(len(items.ids))
            if floors is not None:
                least = np.array([max(floors.get(i, 1), 1) for i in range(len(items.ids))], float)
            for batch in batches:
                columns = {c: batch.column(c) for c in ("doc_ids", "n", "n_rows", "slices")}
                for r in range(batch.num_rows):
                    n = np.asarray(columns["n"][r].values)
                    slices = np.frombuffer(columns["slices"][r].as_buffer(), np.uint8).reshape(columns["n_rows"][r].as_py(), -1)
                    bounds = upper_bounds(slices, n, items, hashes, weight, n_docs, n_terms)
                    if floors is None and len(n) > k:
                        # no more than the block's best are needed to find a floor
                        cut = np.partition(bounds, len(n) - k, axis=1)[:, len(n) - k]
                        item, at = np.nonzero(bounds >= np.maximum(cut, 1)[:, None])
                    else:
                        item, at = np.nonzero(bounds >= least[:, None])
                    ids = columns["doc_ids"][r].values.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids, pa.array(bounds[item, at].astype(np.int64))], ["item", "doc_id", "bound"])
        return map_arrow(index.select("doc_ids", "n", "n_rows", "slices"), run, "item int, doc_id long, bound long")

    def scored(pairs: DataFrame) -> DataFrame:
        # an id that several rows share brings all of them, each with a score of its own text
        asked = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
        asked, small = checked(asked.withColumnRenamed("doc_id", "_id"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        joined = rows.join(F.broadcast(asked) if small else asked, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")

        def run(batches):
            items = item_blocks.load(path)
            weight = weights(items)
            best: dict[int, list] = {}
            for batch in by_bytes(batches):
                ids, wanted = batch.column("doc_id").to_pylist(), [np.asarray(x.values) for x in batch.column("items")]
                for i, item, score in exact_scores(batch.column("text"), wanted, items, weight, n_docs, n_terms):
                    if score > 0:
                        held = best.setdefault(item, [])
                        held.append((-score, LAST if ids[i] is None else ids[i], ids[i]))
                        if len(held) > 8 * k:
                            # only a task's k best can be among the best of all
                            held.sort(key=lambda x: x[:2])
                            del held[k:]
            found = [(item, i, -score) for item, held in best.items() for score, _, i in sorted(held, key=lambda x: x[:2])[:k]]
            a, b, c = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["item", "doc_id", "score"])

        return map_arrow(joined, run, "item int, doc_id long, score long")

    # a floor under each item's k-th score: exact scores of the documents with the highest bounds
    seeds = _best(scored(_best(bounded(None), "bound", k)), "score", k)
    floors = {r["item"]: r["floor"] for r in seeds.groupBy("item").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
    return _best(scored(materialise(bounded(floors), "lexical-candidates")), "score", k)


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = item_blocks.BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lowered. Scores add ``weight * share`` over an item's terms, repeats counted,
    in whole numbers; equal scores rank by ascending ``doc_id``. All documents are
    indexed once (:func:`build_index`). For each block of items the signatures
    give upper bounds of every score; the exact scores of the documents with the
    highest bounds give a floor; every document whose bound reaches the floor is
    scored from its text. The others are proven to rank lower.

    Null text has no terms; an item or document without terms has no rows; a
    null ``doc_id`` ranks behind equal scores; documents count row by row, also
    repeated ones; equal item rows count once, different texts under one
    ``item_id`` are ranked apart; other columns are ignored; empty tables give no
    rows.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    index, found = build_index(docs), None
    for path in item_blocks.build(items.select("item_id", "text"), "lexical-items", item_terms, block_bytes):
        rows = materialise(search_block(docs, index, path, k), "lexical-ranks")

        def named(batches, path=path):
            ids = item_blocks.load(path).ids
            for batch in batches:
                yield pa.RecordBatch.from_arrays([
                    ids.take(batch.column("item")), *[batch.column(c) for c in ("rank", "doc_id", "score")]], ["item_id", "rank", "doc_id", "score"])

        part = map_arrow(rows.select("item", "rank", "doc_id", "score"), named, f"item_id {kind}, rank int, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found


ORACLE = r"""
WITH t AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark) GROUP BY ALL),
lens AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
            FROM tf, totals GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id,
    CAST(sum(q.times * w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN lens USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
