"""Vectors compressed to codes of small integer codebooks, with exact nearest entries found through a GNAT."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.small import checked
from auditloom.session import materialise
from auditloom.shipping import map_arrow

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 1 << 15    # beyond this a squared distance may leave 64 bits
SPLITS = 4
LEAF = 2


def down(x):
    return np.nextafter(x, -np.inf)


def up(x):
    return np.nextafter(x, np.inf)


class Gnat:
    """Nearest entry by squared Euclidean distance over whole numbers, ties to the lower index.

    A node has up to ``SPLITS`` split points, far apart; every other entry belongs
    to its nearest split point. For each split point and each child the node keeps
    the range of distances from the point to the child's entries. A query at
    distance ``d`` of a split point cannot come nearer to a child's entries than
    ``d`` is outside the range, so a child is left out when that bound is strictly
    above the best distance. Ranges, distances and bounds are rounded in the
    direction that keeps a child; distances that decide are whole numbers.
    """

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        index = np.arange(len(entries)) if index is None else index
        chosen = [0]
        while len(chosen) < min(SPLITS, len(index)):
            gap = self._squares(entries[index], entries[index[chosen]]).min(axis=1)
            gap[chosen] = -1
            chosen.append(int(gap.argmax()))
        self.index, self.points = index[chosen], entries[index[chosen]]
        rest = np.setdiff1d(np.arange(len(index)), chosen)
        squares = self._squares(entries[index[rest]], self.points)
        home = squares.argmin(axis=1)
        self.children, low, high = [], [], []
        for s in np.unique(home):
            held = home == s
            distance = np.sqrt(squares[held].astype(float))
            low.append(down(distance.min(axis=0)))
            high.append(up(distance.max(axis=0)))
            members = index[rest[held]]
            self.children.append(Gnat(entries, members) if len(members) > LEAF else (members, entries[members]))
        self.low, self.high = np.array(low), np.array(high)

    @staticmethod
    def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), np.int64)
        for k in range(a.shape[1]):
            gap = a[:, k, None] - b[None, :, k]
            out += gap * gap
        return out

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each query's nearest entry, and the distances computed."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        found = np.full(len(queries), np.iinfo(np.int64).max)
        work = self._visit(queries, np.arange(len(queries)), best, found)
        return found, best, work

    @staticmethod
    def _take(squares: np.ndarray, index: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        for k, entry in enumerate(index):
            new = squares[:, k]
            wins = (new < best[rows]) | ((new == best[rows]) & (entry < found[rows]))
            best[rows[wins]], found[rows[wins]] = new[wins], entry

    def _visit(self, queries, rows, best, found) -> int:
        squares = self._squares(queries[rows], self.points)
        self._take(squares, self.index, rows, best, found)
        work, distance = squares.size, np.sqrt(squares.astype(float))
        # children of the nearest split points first would save little: a node has four at most
        for child, low, high in zip(self.children, self.low, self.high, strict=True):
            outside = np.maximum(down(down(distance) - high), down(low - up(distance))).max(axis=1)
            open_ = outside <= up(np.sqrt(best[rows].astype(float)))
            if not open_.any():
                continue
            if isinstance(child, Gnat):
                work += child._visit(queries, rows[open_], best, found)
            else:
                members, points = child
                near = self._squares(queries[rows[open_]], points)
                self._take(near, members, rows[open_], best, found)
                work += near.size
        return work


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, label`` of the rows with a vector of finite components within ``LARGEST``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return rows.where((F.size("embedding") > 0) & F.forall("embedding", lambda x: F.abs(x) <= LARGEST))


def whole(column) -> np.ndarray:
    """Rows x components as ``floor(4096 * x)``."""
    flat = column.flatten()
    return np.floor(np.asarray(flat) * SCALE).astype(np.int64).reshape(len(column), -1)


def parts_of(numbers: np.ndarray) -> list[np.ndarray]:
    return np.split(numbers, PARTS, axis=1)


def first_entries(rows: DataFrame) -> list[np.ndarray]:
    """Codebooks of the smallest ids; only those rows reach the driver."""
    smallest = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").isNull(), "vec_id", "embedding").limit(ENTRIES)
    held = [r["embedding"] for r in smallest.collect()]
    if not held:
        return []
    size = len(held[0])
    if size % PARTS:
        raise ValueError(f"vectors of {size} components do not divide into {PARTS} parts")
    held = [v for v in held if len(v) == size]
    return parts_of(np.floor(np.array(held, float) * SCALE).astype(np.int64))


def refined(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, every used entry to the floor of its parts' mean.

    Tasks add up their rows first: 128 sums a task are shuffled, 128 rows return.
    """
    def summed(batches):
        trees = [Gnat(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for p, part in enumerate(parts_of(whole(batch.column("embedding")))):
                near, _, _ = trees[p].nearest(part)
                counts[p] += np.bincount(near, minlength=len(books[p]))
                np.add.at(sums[p], near, part)
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used]),
                pa.array(sums[p][used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    width = books[0].shape[1]
    found = map_arrow(rows.select("embedding"), summed, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    books = [b.copy() for b in books]
    for r in found.collect():
        books[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def train(vectors: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks by part: whole-number entries after ``rounds`` rounds; none for an empty table."""
    rows = usable(vectors)
    books = first_entries(rows)
    if books:
        rows = rows.where(F.size("embedding") == PARTS * books[0].shape[1])
        for _ in range(rounds):
            books = refined(rows, books)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error`` of the vectors that fit the codebooks."""
    rows = usable(vectors)
    label = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    if not books:
        return rows.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))

    def coded(batches):
        trees = [Gnat(b) for b in books]
        for batch in batches:
            numbers, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, part in enumerate(parts_of(whole(batch.column("embedding")))):
                numbers[:, p], squares, _ = trees[p].nearest(part)
                error += squares
            code = numbers.tobytes().hex()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), pa.array([code[i:i + 2 * PARTS] for i in range(0, len(code), 2 * PARTS)], pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"])

    return map_arrow(rows.where(F.size("embedding") == PARTS * books[0].shape[1]), coded, schema)


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([b[n] for b, n in zip(books, bytes.fromhex(code), strict=True)])


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector.

    Dropped are null vectors, those with null or non-finite components, without
    components, of another length than the vector with the smallest id, and with
    components beyond ±32768. Repeated rows and ids are coded one by one; a null
    ``vec_id`` sorts last; equal ids sort by their components; with fewer than 16
    vectors the codebooks are smaller; null labels form one group; other columns
    are ignored; an empty table gives no rows. Each of the eight passes over the
    vectors moves 128 sums a task; the errors by label are aggregated before they
    are joined back.
    """
    books = train(vectors)
    rows = materialise(encode(vectors, books), "vector-codes")
    totals = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    totals, small = checked(totals)
    joined = rows.join(F.broadcast(totals) if small else totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""gaps{r} AS MATERIALIZED (
  SELECT v.row, v.part, e.entry, CAST(sum((v.x - e.x) * (v.x - e.x)) AS BIGINT) AS d
  FROM comps v JOIN book{r} e ON v.part = e.part AND v.k = e.k GROUP BY ALL),
near{r} AS MATERIALIZED (SELECT row, part, entry, d FROM gaps{r} QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY d, entry) = 1)""")
        if r < ROUNDS:
            rounds.append(f"""sums{r} AS MATERIALIZED (
  SELECT n.part, n.entry, v.k, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS c FROM near{r} n JOIN comps v USING (row, part) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.k, coalesce((s - ((s % c) + c) % c) // c, b.x) AS x FROM book{r} b LEFT JOIN sums{r} USING (part, entry, k))""")
    return f"""WITH good AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT) FOR x IN embedding] AS v,
    row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
comps AS MATERIALIZED (
  SELECT row, (i - 1) // (len(v) // {PARTS}) AS part, (i - 1) % (len(v) // {PARTS}) AS k, v[i] AS x
  FROM good, unnest(range(1, len(v) + 1)) AS t(i)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, k, x FROM comps WHERE row <= {ENTRIES}),
{", ".join(rounds)},
final AS (SELECT row, CAST(sum(d) AS BIGINT) AS error, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY part) AS code FROM near{ROUNDS} GROUP BY row),
labelled AS (SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM final JOIN good USING (row))
SELECT *, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, k)) FROM book{ROUNDS}) AS codebooks_sha256 FROM labelled"""


ORACLE = _oracle()
