import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from auditloom.llm import components, decontaminate, gray_index, line_templates, simhash, suffix_dedup
from tests.llm.conftest import ROWS


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(codes, ids):
    label = list(ids)
    near = [[j for j in range(len(codes)) if (codes[i] ^ codes[j]).bit_count() <= 2] for i in range(len(codes))]
    while True:
        fresh = [min(label[j] for j in near[i]) for i in range(len(codes))]
        if fresh == label:
            return label
        label = fresh


def test_gray_index_finds_all_neighbours():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    codes = np.unique(np.concatenate([codes, *[codes ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) for _ in range(4)]]))
    label = gray_index.least_linked(codes, 2)
    assert label.tolist() == reachable([int(c) for c in codes], list(range(len(codes))))


def test_simhash_of_odd_rows(odd, none):
    rows = [(d, fingerprint(t)) for d, t, _ in ROWS]
    got = simhash.near_duplicates(odd).collect()
    assert sorted((repr(r["doc_id"]), int(r["fingerprint"], 16)) for r in got) == sorted((repr(d), c) for d, c in rows)
    want = reachable([c for _, c in rows], [10**9 if d is None else d for d, _ in rows])
    assert sorted((repr(r["doc_id"]), r["component_id"] or 10**9) for r in got) == sorted((repr(d), w) for (d, _), w in zip(rows, want, strict=True))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(want))
    assert simhash.keep_one(none).count() == 0


def test_crowded_patterns_are_divided(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    codes = sorted({s ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)) ^ rng.choice([0, 1 << 40]) for s in seeds for _ in range(60)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "code long")
    small = components.components(simhash.links(frame, group_rows=5))
    got = dict((r["node"], r["component"]) for r in small.collect())
    want = reachable(codes, signed)
    assert [got.get(c, c) for c in signed] == want


def test_components_ignore_loops_and_nulls(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (3, 1), (1, 2)], "a long, b long")
    assert sorted(map(tuple, components.components(links).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert components.components(links.where("false")).count() == 0


def windows(items):
    for key, text in items:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            yield key or "", tuple(words[i:i + n])


def contaminated(text, items):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
    hit, found = [False] * len(words), set()
    for key, window in windows(items):
        for i in range(len(words) - len(window) + 1):
            if tuple(words[i:i + len(window)]) == window:
                found.add(key)
                hit[i:i + len(window)] = [True] * len(window)
    return len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)


def test_decontamination_of_odd_rows(odd, none, items):
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    want = sorted((repr(d), *contaminated(t, rows)) for d, t, _ in ROWS)
    got = [(repr(r[0]), *r[1:]) for r in decontaminate.report(odd, items).collect()]
    assert sorted(got) == want and any(w[5] for w in want)
    blocks = decontaminate.scan(odd, items, block_bytes=20).select("doc_id", "n_words", "n_hit", F.size("items"))
    assert sorted((repr(r[0]), *r[1:]) for r in blocks.collect()) == sorted(w[:4] for w in want)
    assert decontaminate.report(none, items).count() == 0
    assert decontaminate.report(odd, items.where("false")).where("contaminated").count() == 0
    clean = decontaminate.decontaminate(odd, items, max_share=1.0)
    assert clean.columns == odd.columns and clean.count() == len(ROWS)
    assert decontaminate.report(clean, items).where("contaminated").count() == 0
    gone = [d for d, t, _ in ROWS if contaminated(t, rows)[1] > 0.5 * contaminated(t, rows)[0]]
    assert gone and decontaminate.decontaminate(odd, items).count() == len(ROWS) - len(gone)


def test_suffix_dedup_equals_brute_force(spark, odd, none):
    key = lambda rows: sorted((repr(r[0]), *r[1:]) for r in rows)
    rows = [(d, t) for d, t, _ in ROWS]
    assert key(suffix_dedup.report(odd).collect()) == key(suffix_dedup.brute_force(rows))
    assert suffix_dedup.report(none).count() == 0
    rng = random.Random(1)
    parts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(20, 130))) for _ in range(12)]
    rows = [(i % 50, "".join(rng.choice([*parts, "é" * rng.randrange(40), "a" * rng.randrange(90)]) for _ in range(rng.randrange(6)))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert key(suffix_dedup.report(frame).collect()) == key(suffix_dedup.brute_force(rows))


def test_suffix_dedup_of_a_passage_in_a_third_of_many_texts(spark):
    """Contexts collapse in the tasks that find them; chunks, ties of ids and copies inside one text included."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(1500):
        own = " ".join(word() for _ in range(15))
        cut = passage[rng.randrange(20):len(passage) - rng.randrange(20)]
        rows.append((i // 2 if i % 5 == 0 else i, f"{own} {passage if i % 2 else cut} {own}" if i % 3 == 0 else own))
    rows += [(9000, passage + "|" + passage), (3, passage), (None, passage)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    key = lambda rows: sorted((repr(r[0]), *r[1:]) for r in rows)
    assert key(suffix_dedup.report(frame).collect()) == key(suffix_dedup.brute_force(rows))


def test_kinds_tell_texts_apart_when_hashes_agree(monkeypatch):
    """With all hashes equal the bytes alone decide."""
    texts = [b"a" * 50, b"b" * 50, b"a" * 50, b"c" * 50, b"b" * 50, b"a" * 51]
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    gram, lead = np.zeros(6, np.uint64), np.zeros(6, np.int64)
    monkeypatch.setattr(suffix_dedup.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(suffix_dedup, "KIND_ROWS", 2)
    number = suffix_dedup.kinds(gram, lead, buffer, np.array([len(t) for t in texts]))
    assert [[i for i in range(6) if number[i] == n] for n in sorted(set(number), key=list(number).index)] == [[0, 2], [1, 4], [3], [5]]


def test_suffix_sort_and_segments(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.arange(3900)
    sort = suffix_dedup.Suffixes(data, starts)
    order = sort.sort(starts.copy(), np.array([0]), np.array([len(starts)]))
    raw = data.tobytes()
    texts = [raw[i:i + 50] for i in order]
    assert texts == sorted(texts)
    offsets = np.array([0, 1500, 1549, 4000])
    whole = suffix_dedup.anchors(offsets, data)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    cut = suffix_dedup.anchors(offsets, data)
    spread = lambda a: {(r, w): p for r, p, f, la in zip(a["row"], a["place"], a["first"], a["last"], strict=True) for w in range(f, la + 1)}
    assert spread(whole) == spread(cut) and len(spread(whole)) == 1451 + 2402


def test_colliding_hashes_are_told_apart():
    data = np.frombuffer(b"x" * 60 + b"y" * 60 + b"x" * 60, np.uint8)
    suffixes = suffix_dedup.Suffixes(data, np.array([0, 60, 120]))
    suffixes.whole[:] = 1
    number = suffixes.classes(np.array([0, 1, 2]), np.array([0]), np.array([3]))
    assert number[0] == number[2] != number[1]


def test_line_templates(spark, odd, none):
    rows = [(i, f"{chr(97 + i) * 3} opening words of text {chr(97 + i)}.\nPosted on 12 May {2000 + i} by the staff of {chr(98 + i)} news\nshort one\nplain common closing words") for i in range(12)]
    rows += [(20, "plain common closing words"), (21, "plain common closing phrase"), (22, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_lines(frame).collect()}
    assert got[0] == rows[0][1] and got[21] == rows[13][1] and got[22] is None and got[20] == ""
    assert got[5] == "fff opening words of text f.\nshort one"
    same = line_templates.drop_lines(odd)
    assert same.columns == odd.columns and sorted(map(repr, same.collect())) == sorted(map(repr, odd.collect()))
    assert line_templates.drop_lines(none).count() == 0 and line_templates.report(none).count() == 0
    assert line_templates.report(odd).count() == len(ROWS)


def test_copies_are_no_templates(spark):
    frame = spark.createDataFrame([(i, "one and the same text in every row\nwith a second line too") for i in range(30)], "doc_id long, text string")
    assert line_templates.report(frame).where("n_dropped > 0").count() == 0


def filled(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def kept(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in line_templates.drop_lines(frame).collect()}


def test_long_lines_recur_from_two_texts_on(spark):
    rng = random.Random(6)
    long, middle, short = filled(rng, 60), filled(rng, 6), filled(rng, 3)
    own = [filled(rng, 12) for _ in range(9)]
    rows = [(i, own[i] + "\n" + "\n".join(([long] if i < 2 else []) + ([middle] if i in (3, 4, 5, 6) else []) + [short])) for i in range(9)]
    got = kept(spark, rows)
    assert got[0] == rows[0][1] and got[1] == own[1] + "\n" + short
    assert got[3] == rows[3][1] and all(got[i] == own[i] + "\n" + short for i in (4, 5, 6))
    assert all(got[i] == rows[i][1] for i in (2, 7, 8))


def test_short_lines_of_very_many_texts(spark):
    rng = random.Random(7)
    rows = [(i, filled(rng, 12) + "\nRead more" + ("\nseldom seen" if i < 50 else "") + "\n2024 17") for i in range(120)]
    got = kept(spark, rows)
    assert got[0] == rows[0][1] and all(got[i] == rows[i][1].replace("\nRead more", "") for i in range(1, 120))


def test_variable_words_of_long_lines(spark):
    rng = random.Random(8)
    for count in (2, 12):
        words, rows = filled(rng, 60).split(" "), []
        for i in range(count):
            line = list(words)
            for at in (5, 18, 31, 44):
                line[at] = filled(rng, 1)
            rows.append((i, filled(rng, 12) + "\n" + " ".join(line)))
        unlike = " ".join(words[:3] + filled(rng, 57).split(" "))
        got = kept(spark, [*rows, (99, unlike)])
        assert got[0] == rows[0][1] and got[99] == unlike and all(got[i] == rows[i][1].split("\n")[0] for i in range(1, count))
    pair = [" ".join(words), " ".join([*words[:20], "other", *words[21:]])]
    got = kept(spark, [(i, filled(rng, 12) + "\n" + line) for i, line in enumerate(pair)])
    assert [len(t.split("\n")) for _, t in sorted(got.items())] == [2, 1]


def test_component_rounds_have_tasks_by_their_links(spark):
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        pairs = [(i, i + 1) for i in range(60) if i % 10 != 9]
        found = components.components(spark.createDataFrame(pairs, "a long, b long"))
        links = found.where("node <> component")
        assert links.rdd.getNumPartitions() < 23
        assert {r["node"]: r["component"] for r in found.collect()} == {i: i // 10 * 10 for i in range(60)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
