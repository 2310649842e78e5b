"""Ranked search against a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditloom.llm import item_blocks, lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranks(docs, items, k=20):
    """Sorted rows ``(item_id, rank, doc_id, score)`` by scoring every document."""
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total, df = len(docs), sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for key, text in dict.fromkeys(items):
        scores = []
        for i, c, n in docs:
            m, score = 75 + 25 * n * n_docs // total, 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                scores.append((-score, i is None, i))
        out += [(key, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def ranked(docs, items, **options):
    return sorted(map(tuple, lexical.rank(docs, items, **options).collect()), key=repr)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_odd_rows(odd, items):
    found = lexical.rank(odd, items.withColumn("doc_id", F.lit(1)))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_ranks(rows_of(odd, "doc_id", "text"), rows_of(items, "item_id", "text"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_empty_tables(odd, none, items):
    assert ranked(none, items) == [] and ranked(odd, items.where("false")) == []


def test_many_blocks_ties_and_counts(spark):
    """Copies tie beyond k, counts pass every level, and several item blocks give what one gives."""
    random.seed(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(random.choices(words, [1 / (j + 1) for j in range(60)], k=random.choice([3, 12, 80, 500])))) for i in range(400)]
    docs += [(1000 + i, "w59 w58 w57 ä-b") for i in range(50)] + [(2000 + i, "w1 " * n) for i, n in enumerate([1, 2, 31, 32, 33, 64, 500])]
    items = [(i, " ".join(random.choices(words, k=9))) for i in range(12)] + [(100, "W59 w58, w58; Ä ä"), (101, "w1"), (101, "w2"), (102, "nowhere")]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = plain_ranks(docs, items)
    assert ranked(frame, asked) == want
    assert ranked(frame, asked, block_bytes=64) == want
    assert len(item_blocks.build(asked, "t", lexical.item_terms, 64)) > 3


def test_bounds_exclude_and_never_cut(spark):
    """Every bound is at least the exact score, and most documents fall below the best ones."""
    random.seed(5)
    words = [f"x{i}" for i in range(3000)]
    texts = [" ".join(random.choices(words, k=40)) for _ in range(300)]
    table = pa.table({"item_id": [0, 1], "text": [texts[7], " ".join(words[:30])]})
    held = lexical.item_terms(table)
    hashes, weight = lexical.term_hashes(held.terms), np.full(len(held.terms), 5000)
    vocabulary, number, row, times, n = lexical.document_terms(pa.array(texts))
    slices = lexical.signature(lexical.term_hashes(vocabulary), number, row, lexical.levels_of(times), len(texts), 600)
    bounds = lexical.upper_bounds(slices, n, held, hashes, weight, 300, int(n.sum()))
    exact = np.zeros_like(bounds)
    for i, item, score in lexical.exact_scores(pa.array(texts), [np.arange(2)] * 300, held, weight, 300, int(n.sum())):
        exact[item, i] = score
    assert (bounds >= exact).all() and exact[0].argmax() == 7
    assert (bounds[0] >= np.sort(exact[0])[-20]).sum() < 100
