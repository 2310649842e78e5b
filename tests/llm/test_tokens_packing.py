import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from auditloom.llm import packing, pfor, queries
from auditloom.llm.tokens import encoder
from tests.llm.conftest import ROWS

CASES = [
    "", "Don't stop's 'tis it'S <|endoftext|> foo<|startoftext|>bar <|ENDOFTEXT|>", "á. Å,b É. İI.ß! ×. x× y÷.",
    "tab\there\r\nnew\x0bline\x1cfs nbsp em ", "1234 5.6,7|a|b% é| ñ.", "  lead  trail  ", "\n\n",
    "e.́ é. K.Å. ﬁ. ǅ. 'LL 'll I'LL. o'clock 'sa", "日本語.テスト", "a|b c|>d t|x", "<| foo. BAR"]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(queries.word_bpe())
    return lambda text, end: [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_pieces_equal_whole_texts(whole):
    texts = [*CASES, None, " ".join(CASES)]
    ids, bounds = encoder(queries.word_bpe()).encode(pa.array(texts), 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [whole(t, 2) for t in texts]


def check_pieces(rows, sizes):
    """Every id in one piece, no gaps, little padding."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert sum(r["length"] for r in rows) == sum(sizes)
    return padding


def test_packing_keeps_each_id_once(odd, none, whole):
    rows = packing.pack(odd, queries.word_bpe()).collect()
    want = sorted(tuple(whole(t, 2)) for _, t, _ in ROWS)
    assert check_pieces(rows, map(len, want)) < 4096
    got, same_id = [], {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        same_id.setdefault(r["doc_id"], []).append(r)
    for pieces in same_id.values():
        if sum(r["start"] == 0 for r in pieces) == 1:
            got.append(tuple(np.frombuffer(b"".join(r["ids"] for r in sorted(pieces, key=lambda r: r["start"])), np.uint32).tolist()))
    assert got and set(got) <= set(want)
    assert packing.pack(none, queries.word_bpe()).count() == 0


def test_cut_lengths_fit_their_class():
    for n in [1, 2, 63, 64, 65, 819, 820, 1365, 1366, 2047, 2048, 2049, 4095, 4096, 4097, 9000, 123457]:
        pieces = packing.cut_lengths(n)
        assert sum(length for length, _ in pieces) == n
        assert all(0 < length <= 4096 // j for length, j in pieces)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 2000, 70_000])
def test_token_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_000).astype(np.uint32)
    ids[::97] = 2**32 - 1
    bounds = np.unique(np.concatenate(([0, n], rng.integers(0, n + 1, 5)))) if n else np.array([0, 0])
    keys = [None, *range(1, len(bounds) - 1)]
    file = pfor.TokenFile(pfor.encode_file(keys, bounds, ids))
    found = list(file.documents(step=3))
    assert [d for d, _, _ in found] == keys
    assert np.array_equal(np.concatenate([x for _, _, x in found]), ids)
    assert [s for _, s, _ in found] == bounds[:-1].tolist()


def test_token_files_in_order(spark, odd, none, whole, monkeypatch):
    got = [tuple(r) for r in pfor.read_tokens(pfor.write_tokens(odd, queries.word_bpe())).collect()]
    texts = sorted(((d, whole(t, 1)) for d, t, _ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    start, by_start = 0, sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == [d for d, _ in texts]
    for _, at, n, _ in by_start:
        assert at == start
        start += n
    want = sorted((d if d is not None else -1, len(x), zlib.crc32(np.array(x, np.uint32).tobytes())) for d, x in texts)
    assert sorted((d if d is not None else -1, n, c) for d, _, n, c in got) == want
    assert pfor.read_tokens(pfor.write_tokens(none, queries.word_bpe())).count() == 0
