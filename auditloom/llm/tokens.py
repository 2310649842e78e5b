"""Token ids of whole texts, encoding each distinct piece of a batch once."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from auditloom.llm.texts import LOWER, byte_view

# The splitting rule for which pieces may be encoded on their own.
SEPARABLE_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SEPARABLE_NORMALISERS = ["NFC", "Replace", "Lowercase"]

CACHE_PIECES = 400_000
JOINED = 200
_ONE_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = True
_CUT_BEFORE = np.zeros(256, bool)
_CUT_BEFORE[[ord(c) for c in ".,;:!?%$#&*()\"/=+-~'"]] = True
_BLANKS = LOWER.copy()
_BLANKS[[ord("\n"), ord("\t"), ord("\r")]] = 32
_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and file; its pieces are kept between tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder:
    """Ids of texts, equal to encoding each whole text without special tokens.

    A tokenizer that drops white space and never joins a letter to what follows
    it gives the same ids when a text is cut before blanks, and between a letter
    and ASCII punctuation. Such pieces recur, so each is encoded once and kept
    (at most ``CACHE_PIECES``; then the store starts afresh, which changes the
    speed only). Any other tokenizer file is applied to the whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        names = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers") or []]
        first = splits[0]
        self.separable = (
            names == SEPARABLE_NORMALISERS and first.get("type") == "Split" and first.get("invert")
            and first.get("behavior") == "Removed" and first.get("pattern", {}).get("Regex") == SEPARABLE_SPLIT)
        model = rules["model"]
        suffix = model.get("end_of_word_suffix") or ""
        ids = [*model["vocab"].values(), *(t["id"] for t in rules.get("added_tokens") or [])]
        self.closes = np.zeros(max(ids, default=0) + 1, bool)
        self.closes[[i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, column, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in row order and the bounds of each row in them (one more than rows).

        ``end_id`` is appended to every row.
        """
        ids, bounds = self._pieces(column) if self.separable else self._whole(column)
        if end_id is None:
            return ids, bounds
        spread = np.full(len(ids) + len(bounds) - 1, end_id, np.uint32)
        keep = np.ones(len(spread), bool)
        keep[bounds[1:] + np.arange(len(bounds) - 1)] = False
        spread[keep] = ids
        return spread, bounds + np.arange(len(bounds))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in order, and how many each has.

        Plain words are encoded many at a time: the ids that end a word tell
        them apart. A group where those do not add up is encoded piece by piece.
        """
        bare = [p.strip(" ") for p in pieces]
        plain = [bool(_ONE_WORD.fullmatch(b)) for b in bare]
        words = [i for i, ok in enumerate(plain) if ok]
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        single = [i for i, ok in enumerate(plain) if not ok]
        found: list = [None] * len(pieces)
        for group, ids in zip(groups, self._ids([" ".join(bare[i] for i in g) for g in groups]), strict=True):
            stops = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(stops) != len(group) or stops[-1] != len(ids):
                single += group
                continue
            start = 0
            for i, stop in zip(group, stops, strict=True):
                found[i] = ids[start:stop]
                start = stop
        for i, ids in zip(single, self._ids([pieces[i] for i in single]), strict=True):
            found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum()), sizes

    def _whole(self, column) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids([t or "" for t in column.to_pylist()])
        bounds = np.cumsum([0, *map(len, found)])
        return np.fromiter(chain.from_iterable(found), np.uint32, bounds[-1]), bounds

    def _pieces(self, column) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = byte_view(column)
        size = len(data)
        if not size:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        # special tokens are looked up before lower-casing, so their texts keep their case
        low = data if b"<|" in data.tobytes() else _BLANKS[data]
        cut = low == 32
        letter = _LETTER[LOWER[low]]
        pair = np.zeros(size, bool)  # ends of two-byte Latin letters
        pair[1:] = (low[:-1] == 0xC3) & (low[1:] != 0x97) & (low[1:] != 0xB7)
        cut[1:] |= (letter | pair)[:-1] & _CUT_BEFORE[low[1:]]
        cut[offsets[:-1][offsets[:-1] < size]] = True
        starts = np.flatnonzero(cut)
        tiles = np.append(starts, size).astype(np.int64)
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(tiles), pa.py_buffer(np.ascontiguousarray(low))])
        pieces = pieces.dictionary_encode()
        codes = self._codes(pieces.dictionary.to_pylist())[pieces.indices.to_numpy(zero_copy_only=False)]
        begin, length = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        total = np.concatenate(([0], np.cumsum(length)))
        ids = self.flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def _codes(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.index) > CACHE_PIECES:
            self._clear()
        get = self.index.get
        codes = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            fresh = [pieces[i] for i in missing]
            flat, sizes = self._piece_ids([p.decode("utf-8", "replace") for p in fresh])
            known = len(self.index)
            codes[missing] = known + np.arange(len(fresh))
            self.index.update(zip(fresh, range(known, known + len(fresh)), strict=True))
            self.flat = np.concatenate((self.flat, flat))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        return codes
