"""Interpolated modified Kneser-Ney model of word pairs or triples, counted by Spark, looked up in mapped files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm import shared_files
from auditloom.llm.packed import expand, from_planes, planes, scramble, squeeze, unscramble
from auditloom.llm.texts import LOWER, SPACE, as_strings, by_bytes, byte_view, plain, split_words
from auditloom.session import materialise
from auditloom.shipping import map_arrow

END = 0  # hash kept for the end token
HELD_ROWS = 3_000_000
STAT_WORDS = 1 << 17  # words, or pairs, whose statistics one task writes
ORDER = 2


def total(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values[order], first)


class Sums:
    """Sums by key that are folded whenever they grow past ``HELD_ROWS``."""

    def __init__(self):
        self.keys, self.values, self.held = [], [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys.append(keys)
        self.values.append(values)
        self.held += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found = total(np.concatenate(self.keys), np.concatenate(self.values))
        self.keys, self.values, self.held = [], [], 0
        return found


def held_out(doc_id: str = "doc_id") -> Column:
    """``crc32`` of the id as text, modulo 10, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10 == 0


def _words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct word, the place of each token in them, and the words before each row."""
    offsets, data = byte_view(column)
    low = LOWER[data]
    starts, ends, bounds = split_words(offsets, ~SPACE[low])
    coded = as_strings(low, starts, ends).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) or 1 for w in coded.dictionary.to_pylist()], np.uint64)
    return hashes, coded.indices.to_numpy(zero_copy_only=False), bounds


def _with_ends(values: np.ndarray, bounds: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Token values with ``end`` after each row, and the new bounds."""
    rows = len(bounds) - 1
    out = np.full(len(values) + rows, end, values.dtype)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] + np.arange(rows)] = False
    out[keep] = values
    return out, bounds + np.arange(rows + 1)


PACKED = "kind string, bucket long, keys binary, counts binary, files array<string>, numbers array<long>"


def _row(kind: str, bucket: int, keys: bytes = b"", counts: bytes = b"", files=(), numbers=()) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([kind]), pa.array([bucket]), pa.array([keys], pa.binary()), pa.array([counts], pa.binary()),
        pa.array([list(files)], pa.list_(pa.string())), pa.array([[int(n) for n in numbers]], pa.list_(pa.int64()))],
        ["kind", "bucket", "keys", "counts", "files", "numbers"])


def _packed(kind: str, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket; ``keys`` ascend."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    for b, start, stop in _spans(bucket):
        yield _row(kind, b, squeeze(keys[start:stop]), planes(counts[start:stop]))


def _by_bucket(batches) -> Iterator[tuple[int, dict[str, Sums]]]:
    """Sums of each bucket by kind; rows arrive in bucket order."""
    now, sums = None, {}
    for batch in batches:
        for bucket, kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "keys", "counts")), strict=True):
            if bucket != now:
                if sums:
                    yield now, sums
                now, sums = bucket, {}
            held = sums.setdefault(kind, Sums())
            held.add(expand(keys), from_planes(counts).astype(np.int64))
            if held.held > HELD_ROWS:
                held.add(*held.take())
    if sums:
        yield now, sums


def _dealt(packed: DataFrame, buckets: int) -> DataFrame:
    return packed.select("kind", "bucket", "keys", "counts").repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")


class Lookup:
    """Arrays of the model by bucket, mapped when first needed."""

    def __init__(self, files: dict[int, list[str]], kinds: list):
        self.files, self.kinds, self.open = files, kinds, {}

    def array(self, bucket: int, at: int) -> np.ndarray | None:
        if bucket not in self.files:
            return None
        if (bucket, at) not in self.open:
            self.open[bucket, at] = shared_files.mapped(self.files[bucket][at], self.kinds[at])
        return self.open[bucket, at]

    def find(self, hashes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Place of each ascending hash in its bucket's sorted array 0, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        for b, start, stop in _spans(bucket):
            known = self.array(b, 0)
            if known is None or not len(known):
                continue
            place = np.searchsorted(known, hashes[start:stop])
            place[place == len(known)] = 0
            out[start:stop] = np.where(known[place] == hashes[start:stop], place, -1)
        return out

    def values(self, bucket: np.ndarray, place: np.ndarray, at: int) -> np.ndarray:
        """Entry ``place`` of array ``at``, 0 where the place is below 0; buckets ascend."""
        out = np.zeros(len(place), np.int64)
        for b, start, stop in _spans(bucket):
            known = self.array(b, at)
            if known is not None:
                real = place[start:stop] >= 0
                out[start:stop][real] = known[place[start:stop][real]]
        return out


def _spans(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(bucket):
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for start, stop in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            yield int(bucket[start]), start, stop


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2, and 3 or more from the numbers of entries counted 1 to 4 times."""
    n1, n2, n3, n4 = (max(x, 0) for x in n)
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k) for d, k in zip(found, (0.95, 1.9, 2.9), strict=True)]


class Model:
    """Where the model's files are, and its few global numbers. ``train`` makes it."""

    def __init__(self, buckets: int, words: dict[int, list[str]], sizes: dict[int, int], tokens: int, order: int = ORDER):
        self.buckets, self.words, self.tokens, self.n = buckets, words, tokens, order
        self.shift = np.uint64(64 - max(1, (buckets - 1).bit_length()))
        order = sorted(sizes)
        self.base = dict(zip(order, np.cumsum([0, *[sizes[b] for b in order]]).tolist(), strict=False))
        self.order = np.array(order, np.int64)
        self.bases = np.array([self.base[b] for b in order], np.int64)
        self.vocabulary = sum(sizes.values())
        self.pairs: dict[int, list[str]] = {}
        self.stats: dict[int, list[str]] = {}
        self.triples: dict[int, list[str]] = {}
        self.pair_stats: dict[int, list[str]] = {}
        self.pair_base: dict[int, int] = {}
        self.pair_total = 0
        self.d_triple, self.d_pair, self.d_word = [0.5, 1.0, 1.5], [0.5, 1.0, 1.5], [0.5, 1.0, 1.5]
        self.pair_kinds, self.word_kinds = 0, [0, 0, 0]

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def ids(self, lookup: Lookup, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words not in the training texts."""
        order = np.argsort(hashes)
        ranked = hashes[order]
        bucket = self.bucket(ranked)
        place = lookup.find(ranked, bucket)
        out = np.empty(len(hashes), np.int64)
        base = np.zeros(len(ranked), np.int64)
        for b, start, stop in _spans(bucket):
            base[start:stop] = self.base.get(b, 0)
        out[order] = np.where(place >= 0, base + place, -1)
        return out

    def home(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and place of ascending word numbers."""
        at = np.searchsorted(self.bases, ids, "right") - 1
        return self.order[at], ids - self.bases[at]

    def key(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first.astype(np.uint64) * np.uint64(self.vocabulary + 1) + second.astype(np.uint64)

    def triple_key(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Key of a triple from the numbers of its two pairs."""
        return first.astype(np.uint64) * np.uint64(self.pair_total + 1) + second.astype(np.uint64)

    def pair_ids(self, pairs: Lookup, previous: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Number of each pair, -1 for those not in the training texts."""
        out = np.full(len(tokens), -1, np.int64)
        known = (tokens >= 0) & (previous >= 0)
        if known.any() and self.pairs:
            keys, back = np.unique(scramble(self.key(previous[known], tokens[known])), return_inverse=True)
            bucket = (keys >> self.shift).astype(np.int64)
            place = pairs.find(keys, bucket)
            base = np.zeros(len(keys), np.int64)
            for b, start, stop in _spans(bucket):
                base[start:stop] = self.pair_base.get(b, 0)
            out[known] = np.where(place >= 0, base + place, -1)[back]
        return out

    def set_pairs(self, files: dict[int, list[str]], sizes: dict[int, int]) -> None:
        self.pairs, at = files, 0
        for b in sorted(sizes):
            self.pair_base[b], at = at, at + sizes[b]
        self.pair_total = at

    def pair_keys(self, pairs: Lookup, first: int, stop: int) -> np.ndarray:
        """Keys of the pairs numbered ``first`` to ``stop``."""
        out = []
        for b, base in sorted(self.pair_base.items(), key=lambda x: x[1]):
            known = pairs.array(b, 0)
            low, high = max(first, base), min(stop, base + len(known))
            if low < high:
                out.append(unscramble(np.asarray(known[low - base:high - base])))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


_open: dict[str, Lookup] = {}


def _lookup(files: dict[int, list[str]], kinds: list) -> Lookup:
    """Mapped files of a worker, kept between its tasks."""
    key = next(iter(files.values()))[0] if files else ""
    if key not in _open:
        if len(_open) > 6:
            _open.clear()
        _open[key] = Lookup(files, kinds)
    return _open[key]


WORD_KINDS = [np.uint64, np.int64]
PAIR_KINDS = [np.uint64, np.uint32]
STAT_KINDS = [np.int64] * 5
TRIPLE_KINDS = [np.uint64, np.uint32]
PAIR_STAT_KINDS = [np.uint32] * 5
STATS = ("before", "total", "followers1", "followers2", "followers3")


def _statistics(keys: np.ndarray, counts: np.ndarray, first: np.ndarray, second: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """What smoothing needs of n-grams by the number of their context, and how many precede ``second``, by blocks of numbers."""
    level = np.minimum(counts, 3)
    found = [("total", first, counts), *[(f"followers{n}", first[level == n], np.ones((level == n).sum(), np.int64)) for n in (1, 2, 3)]]
    if second is not None:
        found.append(("before", second, np.ones(len(keys), np.int64)))
    for kind, ids, values in found:
        ids, values = total(ids.astype(np.uint64), values)
        yield from _packed(kind, ids, values, ids.astype(np.int64) // STAT_WORDS)


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


def train(docs: DataFrame, folder: str | None = None, order: int = ORDER) -> Model:
    """Count the model on all of ``docs``; ``order`` is 2 (pairs) or 3 (triples of words).

    First words, then pairs of neighbouring tokens are summed inside each task,
    sent once as compressed blocks by hash bucket, and written by the bucket's
    task as sorted hash arrays with their counts. Frequent words spread over all
    buckets, as pairs are dealt by the hash of both words. Each bucket also sends
    on, by blocks of words, what Kneser-Ney needs per word: how many words stand before it, and how
    many of its followers were seen once, twice, or more often. There are as many
    buckets as shuffle partitions; a task holds one bucket's distinct entries.

    At order 3 a triple is the numbers of its two pairs. Counts of triples then
    give, by blocks of pair numbers, the different words before each pair, which
    take the place of the pairs' own counts below the highest level.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    folder = folder or shared_files.new_folder(spark, "ngram-model")
    buckets = max(2, 1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    rows = plain(docs)
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def count_words(batches):
        sums = Sums()
        for batch in by_bytes(batches):
            hashes, place, _ = _words(batch.column("text"))
            sums.add(hashes, np.bincount(place, minlength=len(hashes)).astype(np.int64))
            sums.add(np.zeros(1, np.uint64) + np.uint64(END), np.array([batch.num_rows]))
            if sums.held > HELD_ROWS:
                keys, counts = sums.take()
                yield from _packed("word", keys, counts, (keys >> shift).astype(np.int64))
        keys, counts = sums.take()
        yield from _packed("word", keys, counts, (keys >> shift).astype(np.int64))

    def keep_words(batches):
        for bucket, sums in _by_bucket(batches):
            keys, counts = sums["word"].take()
            name = f"words-{bucket:06d}"
            files = [shared_files.put(folder, f"{name}-hash", keys), shared_files.put(folder, f"{name}-count", counts)]
            yield _row("word", bucket, files=files, numbers=[len(keys), counts.sum()])

    words = materialise(map_arrow(_dealt(map_arrow(rows, count_words, PACKED), buckets), keep_words, PACKED), "ngram-words")
    listed = words.select("bucket", "files", "numbers").collect()  # one row a bucket
    model = Model(buckets, {r[0]: r[1] for r in listed}, {r[0]: r[2][0] for r in listed}, sum(r[2][1] for r in listed), order)
    if not model.vocabulary:
        return model

    def count_pairs(batches):
        lookup, sums, before = _lookup(model.words, WORD_KINDS), Sums(), model.vocabulary
        end = model.ids(lookup, np.array([END], np.uint64))[0]

        def flush():
            keys, counts = sums.take()
            yield from _packed("pair", keys, counts, (scramble(keys) >> shift).astype(np.int64))

        for batch in by_bytes(batches):
            hashes, place, bounds = _words(batch.column("text"))
            tokens, bounds = _with_ends(model.ids(lookup, hashes)[place], bounds, end)
            keys = model.key(_before(tokens, bounds, before), tokens)
            sums.add(*total(keys, np.ones(len(keys), np.int64)))
            if sums.held > HELD_ROWS:
                yield from flush()
        yield from flush()

    def keep_pairs(batches):
        for bucket, sums in _by_bucket(batches):
            keys, counts = sums["pair"].take()
            hashes = scramble(keys)
            ranked = np.argsort(hashes)
            name = f"pairs-{bucket:06d}"
            files = [shared_files.put(folder, f"{name}-hash", hashes[ranked]), shared_files.put(folder, f"{name}-count", counts[ranked].astype(np.uint32))]
            yield _row("files", bucket, files=files, numbers=[len(keys), *_count_of_counts(counts)])
            first, second = keys // np.uint64(model.vocabulary + 1), keys % np.uint64(model.vocabulary + 1)
            if order == 2:
                yield from _statistics(keys, counts, first, second)
            else:
                ids, values = total(second, np.ones(len(keys), np.int64))
                yield from _packed("before", ids, values, ids.astype(np.int64) // STAT_WORDS)

    def keep_stats(batches):
        for bucket, sums in _by_bucket(batches):
            base = bucket * STAT_WORDS
            size = min(STAT_WORDS, model.vocabulary + 1 - base)
            files, numbers = [], []
            for kind in STATS:
                ids, values = sums[kind].take() if kind in sums else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                out = np.zeros(size, np.int64)
                out[ids.astype(np.int64) - base] = values
                files.append(shared_files.put(folder, f"stats-{bucket:06d}-{kind}", out))
                if kind == "before":
                    numbers = [out.sum(), *[(out == n).sum() for n in (1, 2, 3, 4)], (out >= 3).sum()]
            yield _row("stats", bucket, files=files, numbers=numbers)

    pairs = materialise(map_arrow(_dealt(map_arrow(rows, count_pairs, PACKED), buckets), keep_pairs, PACKED), "ngram-pairs")
    listed = pairs.where("kind = 'files'").select("bucket", "files", "numbers").collect()
    model.set_pairs({r[0]: r[1] for r in listed}, {r[0]: r[2][0] for r in listed})
    model.d_pair = discounts([sum(r[2][i] for r in listed) for i in (1, 2, 3, 4)])
    facts = pairs.where("kind <> 'files'")
    if order == 3:
        facts = facts.unionByName(_train_triples(rows, model, folder, buckets, shift))
    stats = materialise(map_arrow(_dealt(facts, buckets), keep_stats, PACKED), "ngram-stats")
    listed = stats.select("bucket", "files", "numbers").collect()
    model.stats = {r[0]: r[1] for r in listed}
    numbers = [sum(r[2][i] for r in listed) for i in range(6)]
    model.d_word = discounts(numbers[1:5])
    model.pair_kinds, model.word_kinds = numbers[0], [numbers[1], numbers[2], numbers[5]]
    return model


def _train_triples(rows: DataFrame, model: Model, folder: str, buckets: int, shift: np.uint64) -> DataFrame:
    """Files of triples and of pair statistics; returns the statistics of words that follow from them."""
    if (model.pair_total + 1) ** 2 >= 1 << 64:
        raise ValueError(f"{model.pair_total} different pairs are too many for triples of 64-bit keys")

    def count_triples(batches):
        words, pairs, sums = _lookup(model.words, WORD_KINDS), _lookup(model.pairs, PAIR_KINDS), Sums()
        end = model.ids(words, np.array([END], np.uint64))[0]

        def flush():
            keys, counts = sums.take()
            yield from _packed("triple", keys, counts, (scramble(keys) >> shift).astype(np.int64))

        for batch in by_bytes(batches):
            hashes, place, bounds = _words(batch.column("text"))
            tokens, bounds = _with_ends(model.ids(words, hashes)[place], bounds, end)
            second = model.pair_ids(pairs, _before(tokens, bounds, model.vocabulary), tokens)
            keys = model.triple_key(_before(second, bounds, model.pair_total), second)
            sums.add(*total(keys, np.ones(len(keys), np.int64)))
            if sums.held > HELD_ROWS:
                yield from flush()
        yield from flush()

    def keep_triples(batches):
        for bucket, sums in _by_bucket(batches):
            keys, counts = sums["triple"].take()
            hashes = scramble(keys)
            order = np.argsort(hashes)
            name = f"triples-{bucket:06d}"
            files = [shared_files.put(folder, f"{name}-hash", hashes[order]), shared_files.put(folder, f"{name}-count", counts[order].astype(np.uint32))]
            yield _row("files", bucket, files=files, numbers=[len(keys), *_count_of_counts(counts)])
            yield from _statistics(keys, counts, keys // np.uint64(model.pair_total + 1), keys % np.uint64(model.pair_total + 1))

    def keep_pair_stats(batches):
        pairs = _lookup(model.pairs, PAIR_KINDS)
        for bucket, sums in _by_bucket(batches):
            base = bucket * STAT_WORDS
            size = min(STAT_WORDS, model.pair_total + 1 - base)
            files, before = [], None
            for kind in STATS:
                ids, values = sums[kind].take() if kind in sums else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                out = np.zeros(size, np.uint32)
                out[ids.astype(np.int64) - base] = values
                files.append(shared_files.put(folder, f"pair-stats-{bucket:06d}-{kind}", out))
                before = out if before is None else before
            yield _row("files", bucket, files=files, numbers=_count_of_counts(before))
            # below the highest level a pair counts once for each different word before it
            keys = model.pair_keys(pairs, base, base + size)
            counts = before[:len(keys)].astype(np.int64)
            some = counts > 0
            yield from _statistics(keys[some], counts[some], keys[some] // np.uint64(model.vocabulary + 1), None)

    triples = materialise(map_arrow(_dealt(map_arrow(rows, count_triples, PACKED), buckets), keep_triples, PACKED), "ngram-triples")
    listed = triples.where("kind = 'files'").select("bucket", "files", "numbers").collect()
    model.triples = {r[0]: r[1] for r in listed}
    model.d_triple = discounts([sum(r[2][i] for r in listed) for i in (1, 2, 3, 4)])
    stats = materialise(map_arrow(_dealt(triples.where("kind <> 'files'"), buckets), keep_pair_stats, PACKED), "ngram-pair-stats")
    listed = stats.where("kind = 'files'").select("bucket", "files", "numbers").collect()
    model.pair_stats = {r[0]: r[1] for r in listed}
    model.d_pair = discounts([sum(r[2][i] for r in listed) for i in range(4)])
    return stats.where("kind <> 'files'")


def _before(values: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The value one place earlier in the row, ``start`` at its beginning."""
    out = np.concatenate(([start], values[:-1]))
    out[bounds[:-1]] = start
    return out


def _level(count: np.ndarray, context: np.ndarray, discount: list[float], lower) -> np.ndarray:
    """One step of interpolation: ``context`` has the total and the followers seen once, twice, and more often."""
    d = np.array([0.0, *discount])
    size = np.maximum(context[:, 0], 1)
    spare = context[:, 1:] @ np.array(discount) / size
    return np.where(context[:, 0] > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / size + spare * lower, lower)


def probabilities(model: Model, pair: np.ndarray, context: np.ndarray, before: np.ndarray, triple: np.ndarray | None = None, pair_context: np.ndarray | None = None) -> np.ndarray:
    """P(token | the words before it) from the counts of each level and the statistics of its context, lowest level first."""
    lower = 1 / (model.vocabulary + 1)
    if model.pair_kinds:
        d = np.array([0.0, *model.d_word])
        spare = float(np.dot(model.d_word, model.word_kinds)) / model.pair_kinds
        lower = np.maximum(before - d[np.minimum(before, 3)], 0) / model.pair_kinds + spare * lower
    found = _level(pair, context, model.d_pair, lower)
    return found if triple is None else _level(triple, pair_context, model.d_triple, found)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Scores are log10 probabilities of the whole text with its end token. Words
    that training has not seen share the mass of the lowest level. Null and empty
    texts are the end token alone. Repeated rows are scored alike; other columns
    are ignored. With no training text all words are unknown and probabilities
    are uniform; an empty table gives no rows.
    """
    def scored(batches):
        words, pairs, stats = _lookup(model.words, WORD_KINDS), _lookup(model.pairs, PAIR_KINDS), _lookup(model.stats, STAT_KINDS)
        triples, pair_stats = _lookup(model.triples, TRIPLE_KINDS), _lookup(model.pair_stats, PAIR_STAT_KINDS)
        start = model.vocabulary
        shift = model.shift

        def by_id(ids: np.ndarray, arrays: Lookup, columns: list[int], home) -> np.ndarray:
            """Values of words by number; row per number, column per array."""
            kinds, back = np.unique(ids, return_inverse=True)
            out = np.zeros((len(kinds), len(columns)), np.int64)
            real = kinds >= 0
            bucket, place = home(kinds[real])
            for i, column in enumerate(columns):
                out[real, i] = arrays.values(bucket, place, column)
            return out[back]

        def block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return ids // STAT_WORDS, ids % STAT_WORDS

        end = model.ids(words, np.array([END], np.uint64))[0]
        for batch in by_bytes(batches):
            hashes, place, bounds = _words(batch.column("text"))
            tokens, bounds = _with_ends(model.ids(words, hashes)[place], bounds, end)
            previous = _before(tokens, bounds, start)
            pair, triple, pair_context = np.zeros(len(tokens), np.int64), None, None
            if model.pairs and model.n == 2:
                known = (tokens >= 0) & (previous >= 0)
                keys, back = np.unique(scramble(model.key(previous[known], tokens[known])), return_inverse=True)
                bucket = (keys >> shift).astype(np.int64)
                pair[known] = pairs.values(bucket, pairs.find(keys, bucket), 1)[back]
            elif model.pairs:
                second = model.pair_ids(pairs, previous, tokens)
                first = _before(second, bounds, model.pair_total)
                pair = by_id(second, pair_stats, [0], block)[:, 0]
                pair_context = by_id(first, pair_stats, [1, 2, 3, 4], block)
                triple, known = np.zeros(len(tokens), np.int64), (first >= 0) & (second >= 0)
                keys, back = np.unique(scramble(model.triple_key(first[known], second[known])), return_inverse=True)
                bucket = (keys >> shift).astype(np.int64)
                triple[known] = triples.values(bucket, triples.find(keys, bucket), 1)[back]
            count = by_id(tokens, words, [1], model.home)[:, 0] if model.vocabulary else np.zeros(len(tokens), np.int64)
            if model.stats:
                context = by_id(previous, stats, [1, 2, 3, 4], block)
                before = by_id(tokens, stats, [0], block)[:, 0]
            else:
                context, before = np.zeros((len(tokens), 4), np.int64), np.zeros(len(tokens), np.int64)
            p = probabilities(model, pair, context, before, triple, pair_context)
            base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
            rows = bounds[:-1]
            n = np.diff(bounds)
            full = np.add.reduceat(np.log10(p), rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), rows)),
                pa.array(np.full(len(n), model.tokens)), pa.array(np.add.reduceat(base, rows)), pa.array(full), pa.array(10 ** (-full / n))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    found = map_arrow(plain(docs), scored, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def report(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return score(docs, train(docs.where(~held_out()), order=order))
