"""Vectorised words of many texts at once: byte classes, word hashes and per-text boundaries.

Texts are handled in blocks of bounded size. A word is named by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Byte classes of the two word definitions. Every byte of a multi-byte character is at least 0x80.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Letters, digits, signs: words, numbers and runs of punctuation apart.
KINDS = np.full(256, 3, dtype=np.int8)
KINDS[[0x20, *range(0x09, 0x0E)]] = 0
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KINDS[0x30:0x3A] = 2

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers(dict):
    """Arrays that stay in the process that made them: this module travels by value with every function that uses it."""

    def __reduce__(self):
        return _Powers, ()


_POWERS = _Powers()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 65536)
        for name, step in (("up", _STEP), ("down", _STEP_BACK)):
            steps = np.full(size, step, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def blocks(texts: pa.Array, lower: bool = True, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of runs of rows of about ``block_bytes``; NULL counts as empty."""
    rows = texts.cast(pa.binary() if not pa.types.is_large_string(texts.type) else pa.large_binary()).to_pylist()
    begin, size = 0, 0
    out: list[bytes] = []
    for i, row in enumerate(rows):
        row = row or b""
        out.append(row.translate(_LOWER) if lower else row)
        size += len(row)
        if size >= block_bytes:
            yield begin, out
            begin, size, out = i + 1, 0, []
    if out:
        yield begin, out


def word_hashes(texts: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the boundaries: text k has words bounds[k]:bounds[k+1].

    ``classes`` gives every byte a class; a word is a run of one class other than 0.
    """
    joined = b" " + b" ".join(texts) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = classes[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if classes.dtype == bool:
        starts, ends = turns[0::2], turns[1::2]
    else:
        real = inside[turns] != 0
        starts, ends = turns[real], turns[1:][real[:-1]]
    up, down = _powers(len(data))
    sums = np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64)
    # Bytes start..end-1; byte start-1 is a separator, so the difference has no gap.
    value = (sums[ends - 1] - sums[starts - 1]) * down[starts]
    hashes = mix(value + (ends - starts).astype(np.uint64) * _STEP)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate(([1], 1 + np.cumsum(lengths)))
    return hashes, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions with fewer words after them are left out."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        place = np.uint64((k * int(_STEP)) % (1 << 64))
        total += mix(words[k:k + len(total)] + place) if k else words[:len(total)]
        total *= np.uint64(0xD6E8FEB86659FD93)
    return mix(total + np.uint64(n))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
