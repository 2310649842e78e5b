"""Near-duplicate texts by the Jaccard similarity of their word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.components import components
from auditloom.llm.simhash import keep_first, shingle_hashes
from auditloom.llm.texts import among, by_bytes, byte_view, plain
from auditloom.session import materialise
from auditloom.shipping import map_arrow

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
SLICE = 4 << 20
ROWS = 5
_rng = np.random.default_rng(42)
SALT = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MIX = _rng.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def least_values(hashes: np.ndarray) -> np.ndarray:
    """Least value of a set under each of the hash functions; two sets agree in a share of them that is their similarity."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1 << 12):
        part = hashes[start:start + (1 << 12)]
        least = np.minimum(least, ((part[None, :] ^ SALT[:, None]) * ODD[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of ``ROWS`` least values; sets of similarity s share a given key with chance s ** ROWS."""
    return (least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def keyed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, own, keys, sketch)`` of every row: its id, its text's hash, its band keys and 16 bits of each least value."""
    def coded(batches):
        for batch in by_bytes(batches, limit=SLICE):
            least = [least_values(hashes) for hashes in shingle_hashes(*byte_view(batch.column("text")), words)]
            sketches = [(v >> np.uint64(16)).astype(np.uint16).tobytes() for v in least]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("own"), pa.array([band_keys(v).tolist() for v in least], pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "own", "keys", "sketch"])

    return map_arrow(plain(docs).withColumn("own", F.xxhash64("text")), coded, "doc_id long, own long, keys array<long>, sketch binary")


def alike(left: np.ndarray, right: np.ndarray, similarity: float) -> bool:
    """Whether two sets of shingles have the Jaccard similarity; two empty sets are equal."""
    left, right = np.unique(left), np.unique(right)
    both = len(np.intersect1d(left, right, assume_unique=True))
    union = len(left) + len(right) - both
    return not union or both / union >= similarity


def promising(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` without those whose sketches agree too seldom.

    A pair of the similarity falls below the bound of five and a half standard
    deviations with a chance of about one in ten million.
    """
    n = BANDS * ROWS
    least = similarity - 5.5 * (similarity * (1 - similarity) / n) ** 0.5

    def near(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, n) for c in ("left", "right"))
            yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(axis=1) >= least))

    joined = pairs.join(sketches.select(F.col("own").alias("b"), F.col("sketch").alias("right")), "b")
    joined = joined.join(sketches.select(F.col("own").alias("a"), F.col("sketch").alias("left")), "a")
    return map_arrow(joined.select("a", "b", "left", "right"), near, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose texts have the similarity."""
    def checked(batches):
        for batch in batches:
            for some in by_bytes([batch], "left"):
                for part in by_bytes([some], "right"):
                    sides = [shingle_hashes(*byte_view(part.column(c)), words) for c in ("left", "right")]
                    good = [alike(x, y, similarity) for x, y in zip(*sides, strict=True)]
                    yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(texts.select(F.col("own").alias("b"), F.col("text").alias("right")), "b")
    joined = joined.join(texts.select(F.col("own").alias("a"), F.col("text").alias("left")), "a")
    return map_arrow(joined.select("a", "b", "left", "right"), checked, "a long, b long")


def groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """``doc_id, own, part`` of every row: the connected groups of texts with ``similarity``.

    Texts that share a band key are candidates. In each round the first texts of
    every key are compared with all others of the key, four times as many as in
    the round before: first by their sketches, then, if those are near, by all
    their shingles. Texts already in
    one group need no comparison, so copies of one passage end after one round;
    the rounds end when no key holds two groups that were not compared.
    """
    coded = materialise(keyed(docs, words), "near-keys")
    sketches = materialise(coded.groupBy("own").agg(F.any_value("sketch").alias("sketch")), "near-sketches")
    spread = coded.groupBy("own").agg(F.any_value("keys").alias("keys")).select("own", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = materialise(spread.join(sizes, "key").select("key", "own"), "near-members")
    needed = members.select("own").distinct()
    # most texts are like no other: they go before the shuffle
    texts = among(plain(docs).select(F.xxhash64("text").alias("own"), "text"), "own", needed).join(needed, "own", "left_semi").dropDuplicates(["own"])
    texts = materialise(texts, "near-texts")
    links, parts, first = None, None, 1
    while True:
        now = members.withColumn("part", F.col("own")) if parts is None else members.join(
            parts.withColumnRenamed("node", "own"), "own", "left").select("key", "own", F.coalesce("component", "own").alias("part"))
        mixed = now.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
        ranked = now.join(mixed, "key").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("own")))
        ranked = materialise(ranked, "near-ranked")
        heads = ranked.where(F.col("rank") <= first).select("key", F.col("own").alias("a"), F.col("part").alias("__part"), F.col("rank").alias("__rank"))
        pairs = ranked.join(heads, "key").where("rank > __rank AND part <> __part").select("a", F.col("own").alias("b")).distinct()
        pairs = materialise(promising(materialise(pairs, "near-candidates"), sketches, similarity), "near-pairs")
        members, first = ranked.where(F.col("rank") > first).select("key", "own"), first * 4
        if not pairs.isEmpty():
            found = materialise(verified(pairs, texts, words, similarity), "near-links")
            links = found if links is None else links.unionByName(found)
            parts = components(links)
        elif members.isEmpty():
            break
    if parts is None:
        return coded.select("doc_id", "own", F.col("own").alias("part"))
    return coded.join(parts, F.col("own") == F.col("node"), "left").select("doc_id", "own", F.coalesce("component", "own").alias("part"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """``docs`` with all columns, one row of each group of texts whose word shingles are that similar.

    Words are those of ``simhash``; the shingles of a text are a set. Texts
    without words are one group. Of two texts at ``similarity`` the chance that
    no band shows them is below one in ten thousand, less for closer ones; what
    the bands show is compared exactly (on 64-bit hashes of shingles). The row
    that stays is chosen as in ``simhash.keep_one``.
    """
    return keep_first(docs, groups(docs, similarity, words))
