"""Toxic texts by a gapped-subsequence kernel, Nyström landmarks and a linear SVM."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.texts import LOWER, SPACE, as_strings, by_bytes, byte_view, plain, split_words
from auditloom.session import checkpointed
from auditloom.shipping import map_arrow

DECAY = 0.7
SPAN = 6
POWER = 3
LANDMARKS = 96
SAMPLE_ROWS = 20_000
FLOOR = 0.1
UNIT_CHARS = 24
STEM = 5
THRESHOLD = 0.3
SHORT_WORDS = 20     # shorter texts are treated as if they had so many more words
RATIO = 4.0
CACHE_WORDS = 1_000_000
GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]


def triples(word: str) -> dict[str, float]:
    """Weights of all three-character subsequences of a word within ``SPAN`` characters."""
    out: dict[str, float] = {}
    for a, b in GAPS:
        for i in range(len(word) - a - b):
            key = word[i] + word[i + a] + word[i + a + b]
            out[key] = out.get(key, 0.0) + DECAY ** (a + b + 1)
    return out


def kernel(x: str, y: str) -> float:
    """Normalised kernel of two words, raised to ``POWER``: 1 for equal words, near 0 for unlike ones."""
    p, q = triples(x), triples(y)
    norm = np.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
    return float((sum(v * q[k] for k, v in p.items() if k in q) / norm) ** POWER) if norm else 0.0


def tidy(word: str) -> str:
    """Lower case without punctuation at either end."""
    word = word.lower()
    first, last = 0, len(word)
    while first < last and not word[first].isalnum():
        first += 1
    while last > first and not word[last - 1].isalnum():
        last -= 1
    return word[first:last]


def units(word: str) -> list[str]:
    """A word, or overlapping pieces of a long one."""
    step = UNIT_CHARS // 2
    return [word[i:i + UNIT_CHARS] for i in range(0, len(word) - step, step)] if len(word) > UNIT_CHARS else [word]


class Landmarks:
    """Kernel values of words against the landmark words.

    The kernel is a product of explicit subsequence weights, so one table from
    subsequence to its weight in every landmark gives all values of a word in one
    pass over its characters.
    """

    def __init__(self, words: list[str]):
        self.words = words
        weights = [triples(w) for w in words]
        letters = sorted({c for w in weights for u in w for c in u})
        self.letter = {c: i + 1 for i, c in enumerate(letters)}
        self.base = len(letters) + 1
        keys = sorted({u for w in weights for u in w})
        self.row = np.full(self.base ** 3, -1, np.int32)
        self.weight = np.zeros((len(keys), len(words)), np.float32)
        for i, u in enumerate(keys):
            a, b, c = (self.letter[x] for x in u)
            self.row[(a * self.base + b) * self.base + c] = i
        place = {u: i for i, u in enumerate(keys)}
        for j, w in enumerate(weights):
            for u, v in w.items():
                self.weight[place[u], j] = v
        self.norm = np.sqrt([sum(v * v for v in w.values()) or 1.0 for w in weights]).astype(np.float32)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.stems: dict[str, int] = {}
        self.vectors = np.zeros((1, len(self.words)), np.float32)

    def _values(self, texts: list[str]) -> np.ndarray:
        """Kernel values of units, one row each; values below ``FLOOR`` are zero."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), sizes)
        code = np.fromiter((self.letter.get(c, 0) for t in texts for c in t), np.int64, sizes.sum())
        who, row, weight = [], [], []
        for a, b in GAPS:
            n = len(code) - a - b
            if n <= 0:
                continue
            i, j, k = code[:n], code[a:a + n], code[a + b:]
            same = (owner[:n] == owner[a + b:]) & (i > 0) & (j > 0) & (k > 0)
            at = np.flatnonzero(same)
            found = self.row[(i[at] * self.base + j[at]) * self.base + k[at]]
            at, found = at[found >= 0], found[found >= 0]
            who.append(owner[at])
            row.append(found)
            weight.append(np.full(len(at), DECAY ** (a + b + 1), np.float32))
        out = np.zeros((len(texts), len(self.words)), np.float32)
        if not who or not sum(map(len, who)):
            return out
        who, row, weight = np.concatenate(who), np.concatenate(row), np.concatenate(weight)
        order = np.argsort(who, kind="stable")
        who, row, weight = who[order], row[order], weight[order]
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        out[who[first]] = np.add.reduceat(self.weight[row] * weight[:, None], first, axis=0)
        out /= self.norm
        # a unit's own norm is at least that of distinct subsequences; few units pass this bound
        least = np.zeros(len(texts))
        for a, b in GAPS:
            least += np.maximum(sizes - a - b, 0) * DECAY ** (2 * (a + b + 1))
        best = out.max(axis=1) / np.sqrt(np.maximum(least, 1e-9))
        near = best >= FLOOR ** (1 / POWER)
        for i in np.flatnonzero(near):
            own = triples(texts[i])
            out[i] = (out[i] / np.sqrt(sum(v * v for v in own.values()))) ** POWER
        out[~near] = 0
        out[out < FLOOR] = 0
        return out

    def _keep(self, values: np.ndarray) -> np.ndarray:
        """Places of the rows in ``vectors``, 0 for rows without values."""
        some = values.any(axis=1)
        place = np.zeros(len(values), np.int64)
        place[some] = len(self.vectors) + np.arange(some.sum())
        self.vectors = np.concatenate((self.vectors, values[some]))
        return place

    def places(self, words: list[bytes]) -> np.ndarray:
        """For each word the row of ``vectors`` with its values; row 0 is zero."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        get = self.index.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        for start in range(0, len(missing), 20_000):
            part = missing[start:start + 20_000]
            plain = [tidy(words[i].decode("utf-8", "replace")) for i in part]
            # the beginnings of words, which endings do not change, are far fewer than words
            stems = [w[:STEM] if STEM < len(w) <= UNIT_CHARS else "" for w in plain]
            fresh = [w for w in dict.fromkeys(stems) if w not in self.stems]
            self.stems.update(zip(fresh, self._keep(self._values(fresh)).tolist(), strict=True))
            parts = [units(w) for w in plain]
            values = self._values([u for p in parts for u in p])
            bounds = np.cumsum([0, *map(len, parts)])
            values = np.maximum.reduceat(values, bounds[:-1], axis=0)
            stem = np.fromiter((self.stems[w] for w in stems), np.int64, len(stems))
            values[stem > 0] = np.maximum(values[stem > 0], self.vectors[stem[stem > 0]])
            place = self._keep(values)
            found[part] = place
            self.index.update(zip([words[i] for i in part], place.tolist(), strict=True))
        return found

    def pooled(self, column) -> np.ndarray:
        """Normalised kernel row of each text: the sum over its different words of their values, over a root of its length.

        The kernel of two texts is the sum of the kernels of their words, divided
        by the roots of both lengths, so many weak words of a long text weigh less
        than a few clear ones of a short text.
        """
        offsets, data = byte_view(column)
        low = LOWER[data]
        starts, ends, bounds = split_words(offsets, ~SPACE[low])
        out = np.zeros((len(offsets) - 1, len(self.words)), np.float32)
        if not len(starts):
            return out
        coded = as_strings(low, starts, ends).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = self.places(coded.dictionary.to_pylist())
        at = np.flatnonzero(place[number])
        rows = np.searchsorted(bounds, at, "right") - 1
        rows, word = np.divmod(np.unique(rows * len(place) + number[at]), len(place))
        np.add.at(out, rows, self.vectors[place[word]])
        # letters set apart by blanks: runs of four and more one-character words are one unit
        single = np.concatenate(([False], (ends - starts == 1) | ((ends - starts == 2) & (low[starts] >= 0xC2)), [False]))
        single[1:-1] &= ~np.isin(low[starts], np.frombuffer(b"|-*.,&%#$", np.uint8))
        # a run ends with its row
        edge = single[1:] != single[:-1]
        edge[bounds] = True
        cuts = np.flatnonzero(edge)
        long = np.flatnonzero((np.diff(cuts) >= 4) & single[cuts[:-1] + 1])
        for first, last in zip(cuts[long], cuts[long + 1], strict=True):
            row = int(np.searchsorted(bounds, first, "right")) - 1
            joined = b"".join(low[starts[i]:ends[i]].tobytes() for i in range(first, last))
            place = self.places([joined])[0]
            out[row] += self.vectors[place]
        return out / np.sqrt(np.diff(bounds) + SHORT_WORDS)[:, None].astype(np.float32)


class Model:
    """Landmarks, the Nyström map of their kernel values, SVM weights and the score's scale."""

    def __init__(self, words: list[str], values: np.ndarray, toxic: np.ndarray):
        self.words = words
        self.map, self.weights, self.bias, self.slope, self.shift = np.eye(len(words)), np.zeros(len(words)), -1.0, 1.0, 0.0
        if not words or not toxic.any() or toxic.all():
            return
        gram = np.array([[kernel(a, b) for b in words] for a in words])
        power, vectors = np.linalg.eigh(gram)
        self.map = vectors @ np.diag(1 / np.sqrt(np.maximum(power, 1e-3))) @ vectors.T
        x = values @ self.map
        held = np.arange(len(x)) % 5 == 0
        if len(set(toxic[held])) < 2:
            held[:] = True
        fit = ~held if held.sum() < len(x) else held
        self.weights, self.bias = svm(x[fit], toxic[fit])
        self.slope, self.shift = logistic(x[held] @ self.weights + self.bias, toxic[held])

    def scores(self, values: np.ndarray) -> np.ndarray:
        margin = (values.astype(np.float64) @ self.map) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def svm(x: np.ndarray, toxic: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on its support."""
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.where(toxic, 1.0, -1.0)
    cost = np.where(toxic, len(y) / (2 * toxic.sum()), len(y) / (2 * (~toxic).sum()))
    ridge = penalty * np.eye(x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        c = cost[inside, None] * x[inside]
        fresh = np.linalg.solve(ridge + x[inside].T @ c, c.T @ y[inside])
        if np.allclose(fresh, w, atol=1e-8):
            break
        w = fresh
    return w[:-1], float(w[-1])


def logistic(margin: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the probability as a function of the margin (Platt's targets)."""
    good = toxic.sum()
    target = np.where(toxic, (good + 1) / (good + 2), 1 / (len(toxic) - good + 2))
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def fold() -> Column:
    """``crc32`` of the id as text, modulo 4; fold 2 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, chosen by a hash of their ids."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.where(fold() != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # the bounded training sample
    return plain(docs).join(F.broadcast(marks.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id")).select("doc_id", "text", (F.col("toxic") > 0).alias("toxic"))


def landmark_words(rows: DataFrame, count: int = LANDMARKS) -> list[str]:
    """Words, and beginnings of words, that toxic training texts hold far more often than clean ones, the most telling first.

    A word must be in so many toxic texts, beyond ``RATIO`` times its share of the
    clean ones, that at the rate of toxic texts some ten words at most would get
    there by chance.
    """
    words = F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")
    word = F.explode(F.array_union(words, F.transform(words, lambda w: F.substring(w, 1, STEM)))).alias("word")
    table = rows.select("toxic", word).where(F.length("word").between(3, UNIT_CHARS)).groupBy("word").agg(
        F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    seen = rows.agg(F.count_if("toxic").alias("t"), F.count("*").alias("n")).first()
    chances = max(2, table.where("t + c >= 2").count())
    rate = min(max(seen["t"], 1) / max(seen["n"], 2), 0.5)
    # toxic texts beyond RATIO times those expected from the clean ones
    excess = F.col("t") - RATIO * F.col("c") * max(seen["t"], 1) / max(seen["n"] - seen["t"], 1)
    best = table.where(excess >= max(2.0, math.log(max(2.0, chances / 10)) / math.log(1 / rate)))
    return [r["word"] for r in best.orderBy(F.desc(excess), "word").limit(count).collect()]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on the bounded sample: landmarks, then pooled kernel values (``rows`` x landmarks numbers) in the driver."""
    sample = checkpointed(training_rows(docs, labels, rows))
    words = landmark_words(sample)

    def valued(batches):
        marks = _landmarks(words)
        for batch in by_bytes(batches):
            values = marks.pooled(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([v.tobytes() for v in values], pa.binary())], ["doc_id", "toxic", "v"])

    found = map_arrow(sample, valued, "doc_id long, toxic boolean, v binary").toArrow().sort_by("doc_id")
    values = np.frombuffer(b"".join(found["v"].to_pylist()), np.float32).reshape(found.num_rows, len(words)) if words and found.num_rows else np.zeros((found.num_rows, len(words)))
    return Model(words, values.astype(np.float64), np.array(found["toxic"].to_pylist(), bool))


_kept: dict[tuple, Landmarks] = {}


def _landmarks(words: list[str]) -> Landmarks:
    """One table per worker and set of landmarks, with the words met so far."""
    key = tuple(words)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Landmarks(words)
    return _kept[key]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    A text's value for a landmark is the sum over its different words (the largest
    piece of a long word, letters set apart by blanks joined) over a root of its
    length, and inserted or missing characters only lower the value. Null and empty texts
    get the score of a text without any match. Repeated rows are scored alike;
    other columns are ignored; an empty table gives no rows. Without labels of
    both kinds every score is that of a clean text.
    """
    def scored(batches):
        marks = _landmarks(model.words)
        for batch in by_bytes(batches):
            values = model.scores(marks.pooled(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    found = map_arrow(plain(docs), scored, "doc_id long, score double")
    return found.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
