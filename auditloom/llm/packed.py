"""Numbers as compressed byte planes, for blocks that are shuffled whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_codec = pa.Codec("zstd", 1)


def compress(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def decompress(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return _codec.decompress(data[8:], size, asbytes=True) if size else b""


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: the high bytes of small numbers cost nothing."""
    wide = np.ascontiguousarray(values).astype(np.uint64, casting="unsafe")
    return compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def squeeze(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return planes(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def expand(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


MIX = ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1))


def scramble(keys: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit hash (multiply and shift rounds)."""
    h = keys.astype(np.uint64)
    for shift, factor in MIX:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def unscramble(hashes: np.ndarray) -> np.ndarray:
    """The keys of :func:`scramble`."""
    h = hashes.astype(np.uint64)
    for shift, factor in reversed(MIX):
        h = h * np.uint64(pow(factor, -1, 1 << 64))
        h = h ^ (h >> np.uint64(shift))  # a shift of half the bits and more undoes itself
    return h
