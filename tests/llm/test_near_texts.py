import random
import re

from auditloom.llm import near_texts
from tests.llm.conftest import ROWS
from tests.llm.test_near_and_exact import lowered


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def alike(x, y):
    return not (x | y) or len(x & y) / len(x | y) >= 0.8


def grouped(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if n == high else n for n in label]
    return label


def test_near_copies_leave_one(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))]
        for changes in (0, 1, 3, len(words) // 50, len(words) // 30, len(words) // 10):
            other = list(words)
            for at in rng.sample(range(len(words)), changes):
                other[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(other)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in near_texts.keep_one(frame).collect()}
    assert got == set(grouped([t for _, t in rows])) and 25 <= len(got) < 100


def test_crowded_keys_are_compared_in_rounds(spark, monkeypatch):
    # one shared key for all texts: nothing but the exact comparison tells them apart
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(30):
        words = list(base) if i % 3 else [f"v{rng.randrange(99)}" for _ in range(60)]
        for at in rng.sample(range(60), i % 4 + 1):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = near_texts.keyed
    from pyspark.sql import functions as F
    monkeypatch.setattr(near_texts, "keyed", lambda docs, words: keyed(docs, words).withColumn("keys", F.array(F.lit(7).cast("long"))))
    assert {r["doc_id"] for r in near_texts.keep_one(frame).collect()} == set(grouped(texts))


def test_odd_rows(odd, none):
    kept = near_texts.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(grouped([t for _, t, _ in ROWS])))
    assert near_texts.keep_one(none).count() == 0


def test_every_pair_of_a_whole_table_is_in_one_group(spark):
    """sf0.01: all pairs of five-word similarity 0.8 and more, found by an index of all shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    holders = {}
    for i, found in sets.items():
        for s in found:
            holders.setdefault(s, []).append(i)
    near = {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1:]}
    near = {(a, b) for a, b in near if alike(sets[a], sets[b])}
    part = {r["doc_id"]: r["part"] for r in near_texts.groups(docs).collect()}
    assert len(near) > 20 and all(part[a] == part[b] for a, b in near)
