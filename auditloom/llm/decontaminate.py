"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import item_blocks
from auditloom.llm.texts import LOWER, as_strings, by_bytes, byte_view, plain, split_words
from auditloom.shipping import map_arrow

WINDOW = 10
BLOCK_BYTES = 2 << 20
SLICES_A_BLOCK = 4
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, clean string"


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Starts, ends and row bounds of the words of a column, and the words in lower case."""
    offsets, data = byte_view(column)
    low = LOWER[data]
    starts, ends, bounds = split_words(offsets, WORD[low])
    return starts, ends, bounds, as_strings(low, starts, ends)


class SuffixAutomaton:
    """All word sequences that occur inside the items of one block.

    States are numbered from the root 0; ``next`` maps word numbers, ``link`` is
    the suffix link and ``length`` the longest sequence of a state. Every item is
    inserted from the root. ``items`` holds, for states whose sequences include
    one of ``window`` words, the items with that window; ``short`` holds, for
    states of a whole item below ``window`` words, its length and items.
    """

    def __init__(self, items: list[tuple[str, list]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        texts = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for key, words in items if words]
        for _, words in texts:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for key, words in texts:
            self._mark(key, words)
        self.least = min((min(window, len(w)) for _, w in texts), default=0)

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the sequences of ``q`` no longer than ``p`` and ``word``."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        fresh, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = fresh
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[fresh] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return fresh

    def holder(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a sequence that ends in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _mark(self, key: str, words: list[int]) -> None:
        if len(words) < self.window:
            state = self.walk(words)[-1][0]
            self.short.setdefault(self.holder(state, len(words)), {}).setdefault(len(words), set()).add(key)
            return
        for state, length in self.walk(words):
            if length >= self.window:
                self.items.setdefault(self.holder(state, self.window), set()).add(key)

    def walk(self, words) -> list[tuple[int, int]]:
        """State and longest matching length after each word."""
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state, length = 0, 0
            out.append((state, length))
        return out

    def hits(self, words) -> tuple[list[tuple[int, int]], set]:
        """Word ranges covered by windows, and the items of those windows."""
        ranges, found = [], set()
        for at, (state, length) in enumerate(self.walk(words)):
            size = 0
            if length >= self.window:
                full = self.holder(state, self.window)
                size, state = self.window, full
                found |= self.items[full]
            while self.short and state > 0:
                for n, keys in self.short.get(state, {}).items():
                    if n <= length:
                        size = max(size, n)
                        found |= keys
                state = self.link[state]
            if size:
                ranges.append((at + 1 - size, at + 1))
        return ranges, found


def build_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Files of automata, each over about ``block_bytes`` of items, built and written by tasks; the driver has their names."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def automaton(table: pa.Table) -> tuple[SuffixAutomaton, pa.Array]:
        items = [(key, words_of(pa.array([text]))[3].to_pylist()) for key, text in zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)]
        built = SuffixAutomaton(items, window)
        return built, pa.array(list(built.vocabulary), pa.large_binary())

    return item_blocks.build(rows, "benchmark", automaton, block_bytes)


def _mark(block: tuple[SuffixAutomaton, pa.Array], bounds: np.ndarray, words: pa.Array, hit: np.ndarray, items: dict[int, set]) -> None:
    """Mark the words that lie in an occurrence of a window of the block, and the items by row."""
    automaton, vocabulary = block
    if not automaton.least:
        return
    number = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    # runs of benchmark words within one row; shorter ones hold no window
    known = np.concatenate((number >= 0, [False]))
    starts = np.flatnonzero(known & ~np.concatenate(([False], known[:-1])))
    inner = bounds[1:-1]
    starts = np.union1d(starts, inner[known[inner]])
    stops = np.union1d(np.flatnonzero(~known), inner)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    long = ends - starts >= automaton.least
    for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        ranges, found = automaton.hits(number[start:end].tolist())
        for a, b in ranges:
            hit[start + a:start + b] = True
        if found:
            items.setdefault(int(np.searchsorted(bounds, start, "right")) - 1, set()).update(found)


def _judged(files: list[str], batches):
    """``(slice, starts, ends, bounds, hit, items)``; with several blocks each is read once for a few slices."""
    slices = by_bytes(batches)
    while some := list(itertools.islice(slices, 1 if len(files) < 2 else SLICES_A_BLOCK)):
        parsed = [words_of(batch.column("text")) for batch in some]
        hits, items = [np.zeros(len(p[3]), bool) for p in parsed], [{} for _ in some]
        for name in files:
            block = item_blocks.load(name)
            for (_, _, bounds, words), hit, found in zip(parsed, hits, items, strict=True):
                _mark(block, bounds, words, hit, found)
        for batch, (starts, ends, bounds, _), hit, found in zip(some, parsed, hits, items, strict=True):
            yield batch, starts, ends, bounds, hit, found


def _cleaned(data: bytes, offset: int, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray, min_span: int) -> str:
    """The text without its hit spans of ``min_span`` words or more."""
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    out, at = [], 0
    for first, last in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if last - first >= min_span:
            out.append(data[at:starts[first] - offset])
            at = ends[last - 1] - offset
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "replace")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = 1, with_text: bool = True,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items, clean``.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lowered. A window is ``window`` consecutive words of an item, or a whole
    shorter item. ``n_hit`` counts the words inside any occurrence of a window,
    ``items`` lists the items of the windows found, sorted. ``clean`` is the text
    without the hit spans of ``min_span`` words or more (null with
    ``with_text=False``).

    The automaton's longest matching length after each word shows every window
    that ends there. Only words of the benchmark can match, so the walk visits
    runs of those alone. Blocks of items are built in tasks and read from the
    shared folder, one at a time. The documents are not shuffled.

    Null text has no words; an item without words has no window; a null
    ``item_id`` is the empty string; repeated rows and ids are judged one by one;
    other columns are ignored; empty tables give no hits or no rows.
    """
    files = build_blocks(benchmark, window, block_bytes)

    def judged(batches):
        for batch, starts, ends, bounds, hit, items in _judged(files, batches):
            column = batch.column("text")
            n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[bounds])
            clean = None
            if with_text:
                offsets, data = byte_view(column)
                texts = [None] * batch.num_rows
                for row in range(batch.num_rows):
                    raw = data[offsets[row]:offsets[row + 1]].tobytes()
                    part = slice(bounds[row], bounds[row + 1])
                    texts[row] = _cleaned(raw, int(offsets[row]), starts[part], ends[part], hit[part], min_span) if n_hit[row] else raw.decode("utf-8", "replace")
                clean = texts
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(n_hit),
                pa.array([sorted(items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string())),
                pa.array(clean or [None] * batch.num_rows, pa.string())], ["doc_id", "n_words", "n_hit", "items", "clean"])

    return map_arrow(plain(docs), judged, SCHEMA)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of ``scan``: counts, the items' hash and the verdict."""
    return scan(docs, benchmark, with_text=False).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_span: int = 1, max_share: float = 0.5) -> DataFrame:
    """The documents, with their columns, after removal of benchmark spans.

    Spans of ``min_span`` hit words or more are cut out of the text; a document
    with more than ``max_share`` of its words hit is dropped. A document without
    hits, or with null text, is returned unchanged. Repeated rows and ids are judged
    one by one; a share of exactly ``max_share`` stays; extra columns pass through;
    an empty table gives no rows, an empty benchmark changes nothing.
    """
    files = build_blocks(benchmark)
    at = docs.columns.index("text")

    def kept(batches):
        for batch, starts, ends, bounds, hit, _ in _judged(files, batches):
            column = batch.column("text")
            n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[bounds])
            offsets, data = byte_view(column)
            texts = column.to_pylist() if n_hit.any() else None
            for row in np.flatnonzero(n_hit):
                part = slice(bounds[row], bounds[row + 1])
                texts[row] = _cleaned(data[offsets[row]:offsets[row + 1]].tobytes(), int(offsets[row]), starts[part], ends[part], hit[part], min_span)
            if texts is not None:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
            yield batch.filter(pa.array(n_hit <= max_share * np.diff(bounds)))

    return map_arrow(docs, kept, docs.schema)


ORACLE = r"""
WITH it AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM it, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT o.doc_id, o.i, o.n, win.item_id FROM occ o JOIN win ON o.n = win.n AND o.s = win.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ks, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
