"""Vector codes against a plain search."""

import numpy as np
import pytest

from auditloom.llm import vector_codes as V


@pytest.mark.parametrize("kind", ["spread", "ties", "equal", "far", "few"])
def test_nearest_entry_equals_brute_force(kind):
    """Ties included: entries on a small grid, all equal entries, numbers near the largest."""
    rng = np.random.default_rng(7)
    high = {"spread": 4000, "ties": 2, "equal": 1, "far": 1 << 27, "few": 3}[kind]
    entries = rng.integers(-high, high, (3 if kind == "few" else 40, 8)) if kind != "equal" else np.zeros((16, 8), np.int64)
    queries = rng.integers(-high, high, (3000, 8))
    queries[:len(entries)] = entries
    gaps = queries[:, None].astype(object) - entries[None].astype(object)
    squares = (gaps * gaps).sum(axis=2)
    index, best, work = V.Gnat(entries).nearest(queries)
    assert (index == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
    assert work <= squares.size


def test_subtrees_are_left_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-100_000, 100_000, (4, 8))
    entries = (centres[:, None] + rng.integers(-50, 50, (4, 20, 8))).reshape(-1, 8)
    queries = entries[rng.integers(0, 80, 2000)] + rng.integers(-50, 50, (2000, 8))
    _, _, work = V.Gnat(entries).nearest(queries)
    assert work < 0.5 * 2000 * 80


def plain_report(rows):
    kept = [(i, [int(np.floor(np.float64(x) * 4096)) for x in v], label) for i, v, label in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // 8
    books = [[v[p * width:(p + 1) * width] for _, v, _ in order[:16]] for p in range(8)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * width:(p + 1) * width], e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(6):
        new = [list(b) for b in books]
        for p in range(8):
            homes = [near(p, v)[1] for _, v, _ in kept]
            for e in range(len(books[p])):
                held = [v[p * width:(p + 1) * width] for (_, v, _), h in zip(kept, homes, strict=True) if h == e]
                if held:
                    new[p][e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
        books = new
    coded = [(i, [near(p, v) for p in range(8)], label) for i, v, label in kept]
    total = {}
    for _, parts, label in coded:
        total[label] = total.get(label, 0) + sum(d for d, _ in parts)
    digest = V.digest([np.array(b) for b in books])
    return sorted([(i, "".join(f"{e:02x}" for _, e in parts), sum(d for d, _ in parts), total[label], digest) for i, parts, label in coded], key=repr)


def test_report_equals_plain_rounds(spark):
    """Null ids and labels, repeated rows, ties, dropped vectors and clashing columns."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 16) / 4096 * 2], int(i % 3) if i % 5 else None) for i in range(80)]
    rows += [rows[3], rows[3], (None, rows[9][1], 1), (90, None, 1), (91, [None] + [0.0] * 15, 1), (92, [float("nan")] + [0.0] * 15, None),
             (93, [float("inf")] + [0.0] * 15, 2), (-5, [-0.00001] * 16, 7)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    found = V.report(frame.repartition(4))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_report(single)
    few = frame.where("vec_id < 5")
    assert sorted(map(tuple, V.report(few).collect()), key=repr) == plain_report([r for r in single if r[0] is not None and r[0] < 5])


def test_odd_lengths_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    frame = spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.25] * 16, 1), (3, [], 1), (4, [1e30] * 8, 1)], schema)
    assert [r["vec_id"] for r in V.report(frame).collect()] == [1]
    assert V.report(frame.where("false")).collect() == []
    with pytest.raises(ValueError, match="divide"):
        V.report(spark.createDataFrame([(1, [0.5] * 9, 1)], schema))


def test_codes_decode_to_their_entries(spark):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(40)], "vec_id long, embedding array<double>, label int")
    books = V.train(frame)
    vectors = {r["vec_id"]: np.floor(np.array(r["embedding"]) * 4096).astype(int) for r in frame.collect()}
    for r in V.encode(frame, books).collect():
        assert ((vectors[r["vec_id"]] - V.decode(r["code"], books)) ** 2).sum() == r["error"]
