"""Removal of repeated byte strings with a hash-compared suffix sort.

Every 50-byte window has one anchor, the 16-byte string in it with the least
hash, and equal windows have equal anchors at equal places. So only anchors
travel first; those that one document alone holds are done with. The windows
around the others meet by anchor and are sorted as suffixes there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.packed import compress, decompress, expand, from_planes, planes, scramble, squeeze
from auditloom.llm.texts import by_bytes, byte_view, runs
from auditloom.session import materialise
from auditloom.shipping import map_arrow

WINDOW = 50
GRAM = 16
SPAN = WINDOW - GRAM  # windows of one anchor start at most so far before it
SEGMENT = 1 << 18
SLICE = 2 << 20
CHUNK_ANCHORS = 1 << 20
CHUNK_CONTEXTS = 1 << 17
SORT_SUFFIXES = 1 << 18
GATHER = 1 << 21
KIND_ROWS = 1 << 14
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOW = np.uint64((1 << 23) - 1)
NO_ID = -(1 << 63)
WHOLE = -1  # end of a range that is a whole text
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``size`` of each."""
    have = next(iter(_powers), 0)
    if have < size:
        _powers.clear()
        have = max(size, 1 << 16)
        grow = np.full(have, BASE)
        back = np.full(have, INVERSE)
        grow[0] = back[0] = 1
        _powers[have] = np.cumprod(grow), np.cumprod(back)
    return _powers[have]


class PrefixHashes:
    """Polynomial hashes of all substrings of a buffer, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def anchors(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """The anchors of all windows of some texts: ``row, gram, place``, and the first and last window start.

    Places count from the start of the row's bytes. Long rows are walked in
    segments that overlap by a window, so no buffer grows with them.
    """
    pieces: list[tuple] = []
    size = 0
    out: list[tuple] = []

    def walk():
        starts = np.array([p[1] for p in pieces])
        lengths = np.array([p[2] for p in pieces])
        rows = np.array([p[0] for p in pieces])
        bases = np.array([p[3] for p in pieces])
        buffer = np.concatenate([data[a:a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
        ends = np.cumsum(lengths)
        begin = ends - lengths
        piece = np.repeat(np.arange(len(pieces)), lengths)
        n = len(buffer)
        hashes = scramble(PrefixHashes(buffer).of(np.arange(n - GRAM + 1), GRAM))
        key = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        m = key  # least key of 2, 4, 8, 16, 32 and then 35 places from here on
        for step in (1, 2, 4, 8, 16):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[:-3], m[3:]) if len(m) > 3 else m[:0]
        at = (m & LOW).astype(np.int64)
        windows = np.arange(len(at))
        inside = windows + WINDOW <= ends[piece[:len(at)]]
        edge = np.ones(len(at), bool)
        edge[1:] = (at[1:] != at[:-1]) | ~inside[:-1] | (piece[1:len(at)] != piece[:len(at) - 1])
        first = np.flatnonzero(edge & inside)
        stop = np.flatnonzero(np.concatenate((edge[1:] | ~inside[1:], [True])) & inside) if len(at) else first
        where = piece[first]
        shift = bases[where] - begin[where]
        out.append((rows[where], hashes[at[first]], at[first] + shift, first + shift, stop + shift))

    for row in np.flatnonzero(np.diff(offsets) >= WINDOW).tolist():
        start, end = int(offsets[row]), int(offsets[row + 1])
        for a in range(start, end - WINDOW + 1, SEGMENT):
            n = min(end - a, SEGMENT + WINDOW - 1)
            pieces.append((row, a, n, a - start))
            size += n
            if size >= SEGMENT:
                walk()
                pieces, size = [], 0
    if pieces:
        walk()
    names = ("row", "gram", "place", "first", "last")
    return {k: np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.uint64 if k == "gram" else np.int64) for i, k in enumerate(names)}


def _by_bucket(batches, columns: list[str]):
    """``(bucket, lists of its rows' columns)``; rows arrive in bucket order."""
    now, held = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ["bucket", *columns]), strict=True):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, []
            held.append(row)
    if held:
        yield now, held


def _spans(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return first, np.append(first[1:], len(sorted_values))


def gather(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte ranges one after another."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = 0
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + GATHER, "right")))
        part = sizes[at:stop]
        out[done:ends[stop - 1]] = data[np.arange(int(ends[stop - 1]) - done) + np.repeat(begin[at:stop] - (ends[at:stop] - part - done), part)]
        at = stop
    return out


def kinds(gram: np.ndarray, lead: np.ndarray, buffer: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each entry, equal for equal ``(gram, lead, text)``; the texts stand one after another in ``buffer``.

    Entries are grouped by the hash of their text and compared byte by byte with
    the first of their group; those that differ are numbered by their bytes.
    """
    starts = np.cumsum(sizes) - sizes
    hashes = np.empty(len(sizes), np.uint64)
    for a in range(0, len(sizes), KIND_ROWS):
        part = slice(a, min(a + KIND_ROWS, len(sizes)))
        low, high = int(starts[a]), int(starts[part.stop - 1] + sizes[part.stop - 1])
        hashes[part] = PrefixHashes(buffer[low:high]).of(starts[part] - low, sizes[part])
    order = np.lexsort((hashes, sizes, lead, gram))
    edge = np.ones(len(order), bool)
    same = [key[order[1:]] == key[order[:-1]] for key in (gram, lead, sizes, hashes)]
    edge[1:] = ~np.logical_and.reduce(same) if len(order) > 1 else edge[1:]
    group = np.cumsum(edge) - 1
    number = np.empty(len(order), np.int64)
    number[order] = group
    leader = order[edge][group]
    follow = np.flatnonzero(~edge)
    wrong: list[int] = []
    for a in range(0, len(follow), KIND_ROWS):
        mine, first = order[follow[a:a + KIND_ROWS]], leader[follow[a:a + KIND_ROWS]]
        differ = gather(buffer, starts[mine], sizes[mine]) != gather(buffer, starts[first], sizes[mine])
        if differ.any():
            wrong += mine[np.logical_or.reduceat(differ, np.cumsum(sizes[mine]) - sizes[mine])].tolist()
    seen: dict[tuple, int] = {}
    for i in wrong:
        text = buffer[starts[i]:starts[i] + sizes[i]].tobytes()
        number[i] = seen.setdefault((int(gram[i]), int(lead[i]), text), int(edge.sum()) + len(seen))
    return number


class Suffixes:
    """Suffixes of a buffer, compared through their common extension."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, limit: int = WINDOW):
        self.data, self.starts, self.limit = data, starts, limit
        self.hashes = PrefixHashes(data)
        self.whole = self.hashes.of(starts, limit)

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix x sorts before y: binary search for the common extension, then one byte."""
        out = np.full(len(x), or_equal)
        at = np.flatnonzero(self.whole[x] != self.whole[y])
        a, b = self.starts[x[at]], self.starts[y[at]]
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.limit - 1)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashes.of(a, mid) == self.hashes.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[at] = self.data[a + low] < self.data[b + low]
        return out

    def sort(self, order: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merge sort of ``order`` within classes (``begin`` and ``size`` of each one), all classes at once."""
        owner = np.repeat(np.arange(len(size)), size)
        width = 1
        while len(size) and width < size.max():
            place = np.flatnonzero(size[owner] > width)
            start, count = begin[owner[place]], size[owner[place]]
            index = place - start
            pair = index - index % (2 * width)
            right = index % (2 * width) >= width
            low = start + np.where(right, pair, np.minimum(pair + width, count))
            other = low.copy()
            high = start + np.where(right, pair + width, np.minimum(pair + 2 * width, count))
            while (low < high).any():
                live = np.flatnonzero(low < high)
                mid = (low[live] + high[live]) // 2
                mine = order[place[live]]
                # the left run's entries go first where equal
                before = np.where(right[live], self.less(order[mid], mine, True), self.less(order[mid], mine, False))
                low[live] = np.where(before, mid + 1, low[live])
                high[live] = np.where(before, high[live], mid)
            target = start + pair + (index - pair - np.where(right, width, 0)) + (low - other)
            fresh = order.copy()
            fresh[target] = order[place]
            order, width = fresh, 2 * width
        return order

    def classes(self, order: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A number for each entry of the sorted ``order``, equal for equal strings of ``limit`` bytes of one class.

        Neighbours whose hashes agree are compared byte by byte; if any differ,
        their class is numbered by its bytes.
        """
        edge = np.ones(len(order), bool)
        edge[1:] = self.whole[order[1:]] != self.whole[order[:-1]]
        edge[begin] = True
        number = np.cumsum(edge)
        joined = np.flatnonzero(~edge)
        wrong = np.zeros(len(joined), bool)
        for i in range(self.limit):
            wrong |= self.data[self.starts[order[joined]] + i] != self.data[self.starts[order[joined - 1]] + i]
        owner = np.repeat(np.arange(len(size)), size)
        for c in np.unique(owner[joined[wrong]]):
            seen: dict[bytes, int] = {}
            for p in range(begin[c], begin[c] + size[c]):
                s = self.starts[order[p]]
                number[p] = seen.setdefault(self.data[s:s + self.limit].tobytes(), -(p + 1))
        return number


def _least(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each entry the least value among entries of its key."""
    order = np.argsort(keys, kind="stable")
    first, stop = _spans(keys[order])
    out = np.empty(len(keys), values.dtype)
    if len(keys):
        out[order] = np.repeat(np.minimum.reduceat(values[order], first), stop - first)
    return out


def _smaller(buffer: np.ndarray, starts: np.ndarray, by: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows have an equal window of the same class ``by`` with a smaller ``doc``.

    Windows are dealt into finer classes by their first and last eight bytes; the
    suffixes of each class are then merge-sorted.
    """
    head, tail = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for i in range(8):
        head = (head << np.uint64(8)) | buffer[starts + i]
        tail = (tail << np.uint64(8)) | buffer[starts + WINDOW - 8 + i]
    ranked = np.lexsort((tail, head, by))
    edge = np.ones(len(ranked), bool)
    for key in (by, head, tail):
        edge[1:] &= key[ranked[1:]] == key[ranked[:-1]]
    edge[1:] = ~edge[1:]
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(ranked)))
    ranked = ranked[np.repeat(size > 1, size)]
    size = size[size > 1]
    hit = np.zeros(len(starts), bool)
    if len(size):
        begin = np.cumsum(size) - size
        suffixes = Suffixes(buffer, starts)
        order = suffixes.sort(ranked, begin, size)
        hit[order] = _least(suffixes.classes(order, begin, size), doc[order]) < doc[order]
    return hit


def covered(gram: np.ndarray, doc: np.ndarray, own: np.ndarray, first: np.ndarray, lead: np.ndarray, buffer: np.ndarray, sizes: np.ndarray):
    """Covered byte ranges ``(doc, own, start, end)`` of entries that share anchors.

    An entry is the stretch of text of one anchor's windows: ``first`` is where
    it starts in its document and ``lead`` how far before the anchor; the texts
    of ``sizes`` bytes stand one after another in ``buffer``. Entries with
    equal text, anchor and lead collapse to their least document; the others are
    covered whole. The windows of what is left are classed by anchor and distance
    to it, sorted as suffixes, and covered where a smaller document has them.
    """
    if not len(gram):
        return [np.zeros(0, np.int64)] * 4
    texts, starts = buffer, np.cumsum(sizes) - sizes
    kind = np.unique(kinds(gram, lead, buffer, sizes), return_inverse=True)[1]
    count = int(kind.max()) + 1
    least = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc)
    late = doc > least[kind]
    spans = [(doc[late], own[late], first[late], first[late] + sizes[late])]
    # one text of each kind, where its anchor has others
    some = np.zeros(count, np.int64)
    some[kind] = np.arange(len(sizes))
    order = np.argsort(gram[some], kind="stable")
    begin, stop = _spans(gram[some][order])
    crowded = np.flatnonzero(stop - begin > 1)
    early = np.flatnonzero(~late)
    early = early[np.argsort(kind[early], kind="stable")]
    at_kind = np.searchsorted(kind[early], np.arange(count + 1))
    count_of = sizes[some] - WINDOW + 1
    windows = np.cumsum(np.add.reduceat(count_of[order], begin)[crowded]) if len(crowded) else np.zeros(0, np.int64)
    at = 0
    while at < len(crowded):
        stop_at = max(at + 1, int(np.searchsorted(windows, (windows[at - 1] if at else 0) + SORT_SUFFIXES, "right")))
        groups = crowded[at:stop_at]
        blocks = -(-int(windows[stop_at - 1] - (windows[at - 1] if at else 0)) // SORT_SUFFIXES)
        at = stop_at
        members = np.concatenate([order[begin[g]:stop[g]] for g in groups])
        group = np.repeat(np.arange(len(groups)), stop[groups] - begin[groups])
        shown = some[members]
        buffer = gather(texts, starts[shown], sizes[shown])
        base = np.concatenate(([0], np.cumsum(sizes[shown])[:-1]))
        # a group with very many windows is taken by ranges of the distance to the anchor
        for near in np.array_split(np.arange(SPAN + 1), min(blocks, SPAN + 1)):
            first_step = np.maximum(lead[shown] - near[-1], 0)
            count = np.maximum(np.minimum(lead[shown] - near[0] + 1, count_of[members]) - first_step, 0)
            owner = np.repeat(np.arange(len(shown)), count)
            if not len(owner):
                continue
            step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first_step[owner]
            hit = _smaller(buffer, base[owner] + step, group[owner] * (SPAN + 1) + lead[shown][owner] - step, least[members[owner]])
            at_hit = np.flatnonzero(hit)
            joined = (np.diff(at_hit) == 1) & (owner[at_hit[1:]] == owner[at_hit[:-1]])
            run_first = at_hit[np.concatenate(([True], ~joined))] if len(at_hit) else at_hit
            run_last = at_hit[np.concatenate((~joined, [True]))] if len(at_hit) else at_hit
            met = members[owner[run_first]]
            copies = at_kind[met + 1] - at_kind[met]
            e = early[np.repeat(at_kind[met], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)]
            spans.append((doc[e], own[e], first[e] + np.repeat(step[run_first], copies), first[e] + np.repeat(step[run_last], copies) + WINDOW))
    return [np.concatenate([s[i] for s in spans]) for i in range(4)]


def _keyed(docs: DataFrame) -> DataFrame:
    """``id`` (null ids before all others), ``own`` (hash of the text), ``salt`` (some bits of it) and ``text``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("own"), text.alias("text"))
    return rows.withColumn("salt", F.col("own").bitwiseAND(0xFFFF))


def _copies(rows: DataFrame) -> DataFrame:
    """``(__id, __salt, __own)`` of the documents whose whole text a document with a smaller id has."""
    named = rows.select("id", "salt", "own", F.unhex(F.sha2("text", 256)).alias("sha"))
    first = named.groupBy("sha").agg(F.min("id").alias("first")).withColumnRenamed("sha", "__sha")
    late = named.join(first, (F.col("sha") == F.col("__sha")) & (F.col("id") > F.col("first")))
    return late.select(F.col("id").alias("__id"), F.col("salt").alias("__salt"), F.col("own").alias("__own")).distinct()


def _same():
    return (F.col("id") == F.col("__id")) & (F.col("salt") == F.col("__salt"))


def _covers(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``(id, own, start, end)``: byte ranges covered by windows of documents with a smaller id.

    Whole copies are left out: their first document holds every string of theirs.
    """
    tasks = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = 4 << (tasks - 1).bit_length()  # a task takes some buckets, one at a time

    def bucket_of(gram: np.ndarray) -> np.ndarray:
        """Ranges of hashes that hold as many anchors each: an anchor is the least of its windows, so low hashes are far more common."""
        above = 1 - gram.astype(np.float64) / 2.0 ** 64
        half = (SPAN + 2) / 2
        below = 1 - half * above ** (SPAN + 1) + (half - 1) * above ** (SPAN + 2)
        return np.clip((below * buckets).astype(np.int64), 0, buckets - 1)

    def pack(kept: list[dict]):
        """One row a bucket of the anchors held."""
        columns = {k: np.concatenate([x[k] for x in kept]) for k in kept[0]}
        order = np.argsort(columns["gram"], kind="stable")
        gram = columns["gram"][order]
        bucket = bucket_of(gram)
        starts, stops = _spans(bucket)
        for a, b in zip(starts, stops, strict=True):
            o = order[a:b]
            yield (int(bucket[a]), squeeze(gram[a:b]), planes(columns["id"][o]), planes(columns["salt"][o]), planes(columns["place"][o]))

    def find(batches):
        kept, count = [], 0

        def flush():
            rows = list(zip(*pack(kept), strict=True))
            kinds = [pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["bucket", "gram", "ids", "salts", "places"])

        for batch in by_bytes(batches, limit=SLICE):
            found = anchors(*byte_view(batch.column("text")))
            if not len(found["row"]):
                continue
            ids, salts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "salt"))
            kept.append({"gram": found["gram"], "id": ids[found["row"]], "salt": salts[found["row"]], "place": found["place"]})
            count += len(found["row"])
            if count >= CHUNK_ANCHORS:
                yield flush()
                kept, count = [], 0
        if kept:
            yield flush()

    def shared(batches):
        """Anchors whose string occurs in two documents or more."""
        for _, held in _by_bucket(batches, ["gram", "ids", "salts", "places"]):
            gram = np.concatenate([expand(h[0]) for h in held])
            ids = np.concatenate([from_planes(h[1]).view(np.int64) for h in held])
            salts = np.concatenate([from_planes(h[2]) for h in held]).astype(np.int64)
            places = np.concatenate([from_planes(h[3]) for h in held]).astype(np.int64)
            order = np.argsort(gram, kind="stable")
            ids, salts, places = ids[order], salts[order], places[order]
            first, stop = _spans(gram[order])
            many = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
            keep = np.repeat(many, stop - first)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(salts[keep]), pa.array(places[keep].astype(np.int32))], ["id", "salt", "place"])

    packed = map_arrow(rows, find, "bucket long, gram binary, ids binary, salts binary, places binary")
    dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    places = map_arrow(dealt, shared, "id long, salt long, place int").groupBy("id", "salt").agg(F.collect_set("place").alias("places"))
    places = places.withColumnsRenamed({"id": "__id", "salt": "__salt"})
    copied = copies.groupBy("__id", "__salt").agg(F.collect_set("__own").alias("copied")).withColumnsRenamed({"__id": "_c", "__salt": "_s"})
    places = places.join(copied, (F.col("__id") == F.col("_c")) & (F.col("__salt") == F.col("_s")), "left").drop("_c", "_s")
    joined = rows.join(places, _same())  # the texts move once: the last step joins them in the same way

    def contexts(batches):
        kept, count = [], 0

        def flush():
            gram, ids, owns, first, lead, sizes = (np.concatenate([k[i] for k in kept]) for i in range(6))
            buffer = np.concatenate([k[6] for k in kept])
            starts = np.cumsum(sizes) - sizes
            # equal contexts travel once: what a smaller document of this chunk holds is covered already
            kind = np.unique(kinds(gram, lead, buffer, sizes), return_inverse=True)[1]
            least = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, kind, ids)
            late = ids > least[kind]
            bucket = bucket_of(gram)
            order = np.argsort(gram, kind="stable")
            begin, stop = _spans(bucket[order])
            out = []
            for a, b in zip(begin, stop, strict=True):
                o, gone = order[a:b][~late[order[a:b]]], order[a:b][late[order[a:b]]]
                out.append((int(bucket[order[a]]), squeeze(gram[o]), planes(ids[o]), planes(owns[o]), planes(first[o]), planes(lead[o]),
                            planes(sizes[o]), compress(gather(buffer, starts[o], sizes[o]).tobytes()),
                            b"".join(len(x).to_bytes(8, "little") + x for x in (planes(v[gone]) for v in (ids, owns, first, first + sizes)))))
            kinds_of = [pa.int64(), *[pa.binary()] * 8]
            names = ["bucket", "gram", "ids", "owns", "first", "lead", "sizes", "texts", "late"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_of, strict=True)], names)

        for batch in by_bytes(batches, limit=SLICE):
            offsets, data = byte_view(batch.column("text"))
            found = anchors(offsets, data)
            ids, owns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "own"))
            lists = batch.column("places")
            wanted_row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            wanted = np.sort((wanted_row << 40) + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            mine = (found["row"] << 40) + found["place"]
            at = np.searchsorted(wanted, mine)
            keep = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == mine) if len(wanted) else np.zeros(0, np.int64)
            # a long text may have very many contexts: they leave in chunks as well
            for k in range(0, len(keep), CHUNK_CONTEXTS):
                part = keep[k:k + CHUNK_CONTEXTS]
                row, first = found["row"][part], found["first"][part]
                sizes = found["last"][part] + WINDOW - first
                kept.append((found["gram"][part], ids[row], owns[row], first, found["place"][part] - first, sizes, gather(data, offsets[row] + first, sizes)))
                count += len(part)
                if count >= CHUNK_CONTEXTS:
                    yield flush()
                    kept, count = [], 0
        if kept:
            yield flush()

    def cover(batches):
        columns = ["gram", "ids", "owns", "first", "lead", "sizes", "texts", "late"]
        for _, held in _by_bucket(batches, columns):
            for h in held:
                raw, gone = h[7], []
                while raw:
                    size = int.from_bytes(raw[:8], "little")
                    gone.append(from_planes(raw[8:8 + size]).view(np.int64))
                    raw = raw[8 + size:]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in gone], ["id", "own", "start", "end"])
            gram = np.concatenate([expand(h[0]) for h in held])
            ids, owns, first, lead, sizes = (np.concatenate([from_planes(h[i]).view(np.int64) for h in held]) for i in (1, 2, 3, 4, 5))
            buffer = np.concatenate([np.frombuffer(decompress(h[6]), np.uint8) for h in held])
            held.clear()
            found = covered(gram, ids, owns, first, lead, buffer, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], ["id", "own", "start", "end"])

    copy = F.coalesce(F.array_contains("copied", F.col("own")), F.lit(False))
    around = map_arrow(joined.select("id", "own", F.when(copy, "").otherwise(F.col("text")).alias("text"), "places"), contexts,
                       "bucket long, gram binary, ids binary, owns binary, first binary, lead binary, sizes binary, texts binary, late binary")
    dealt = around.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, cover, "id long, own long, start long, end long")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay).

    A byte goes if a 50-byte string that covers it also starts in a document with
    a smaller id; overlaps count, and all strings are judged on the input. Matches
    never cross documents. Null text counts as empty; texts below 50 bytes stay
    whole. Null ids count as smaller than all others and not as smaller than each
    other; rows of one id are judged one by one and never remove each other's
    bytes. Other columns are ignored; an empty table gives no rows.
    """
    rows = _keyed(docs)
    salt = F.col("own").bitwiseAND(0xFFFF).alias("__salt")
    copies = materialise(_copies(rows), "suffix-copies")
    whole = copies.select(F.col("__id").alias("id"), F.col("__own").alias("own"), F.lit(0).cast("long").alias("start"), F.lit(WHOLE).cast("long").alias("end"))
    gone = _covers(rows, copies).unionByName(whole).select(F.col("id").alias("__id"), salt, F.struct("own", "start", "end").alias("s"))
    gone = gone.groupBy("__id", "__salt").agg(F.collect_set("s").alias("gone"))
    joined = rows.join(gone, _same(), "left").select("id", "own", "text", "gone")

    def cut(batches):
        for batch in by_bytes(batches, limit=SLICE):
            offsets, data = byte_view(batch.column("text"))
            lists = batch.column("gone")
            rows_of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            own, start, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            mine = own == batch.column("own").to_numpy(zero_copy_only=False)[rows_of]
            length = np.diff(offsets)[rows_of]
            mine &= (end != WHOLE) | (length >= WINDOW)
            end = np.where(end == WHOLE, length, end)
            at = offsets[rows_of]
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, (at + start)[mine], 1)
            np.add.at(depth, (at + end)[mine], -1)
            gone_byte = np.cumsum(depth[:-1]) > 0
            first = np.zeros(len(data), bool)
            first[offsets[:-1][offsets[:-1] < len(data)]] = True
            begins = gone_byte & (first | ~np.concatenate(([False], gone_byte[:-1])))
            total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
            kept, keep = data[~gone_byte].tobytes(), np.concatenate(([0], np.cumsum(~gone_byte)))[offsets].tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(np.diff(offsets)), pa.array(total(gone_byte)), pa.array(total(begins)),
                pa.array([kept[a:b] for a, b in zip(keep, keep[1:], strict=False)], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = map_arrow(joined, cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return found.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def report(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same result from a table of all windows, for tests."""
    texts = [(NO_ID if i is None else i, i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for key, _, text in sorted(texts, key=lambda t: t[0]):
        for a in range(len(text) - WINDOW + 1):
            least.setdefault(text[a:a + WINDOW], key)
    out = []
    for key, doc_id, text in texts:
        gone = np.zeros(len(text), bool)
        for a in range(len(text) - WINDOW + 1):
            if least[text[a:a + WINDOW]] < key:
                gone[a:a + WINDOW] = True
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(text), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out
