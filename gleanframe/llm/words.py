"""Words of UTF-8 texts as numpy arrays: byte spans and 64-bit hashes, for many texts at once.

A word is a longest run of the bytes 0-9, A-Z, a-z and 0x80 to 0xFF; A-Z count as a-z. Equal words have equal hashes; where
a hash decides, the operator says so or verifies.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes per group of texts and per step inside a long text.
GROUP = 1 << 20

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
LOWER = _low
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[LOWER]
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64. Kept from call to call, and short where only words were hashed."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, 1 << 10 if n < 1 << 10 else GROUP + 1), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Words(NamedTuple):
    first: int  #: index of the first text of the group
    data: bytes  #: the group's texts, one zero byte after each
    starts: np.ndarray  #: byte offsets in data
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  #: words of text first + i: bounds[i] to bounds[i + 1]


def _words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_value[data] * up[: len(data)], out=sums[1:])
    edge = np.zeros(len(data) + 2, dtype=np.int8)
    edge[1:-1] = IS_WORD[data]
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one byte string, in steps of GROUP bytes that end between words."""
    whole, parts, at = np.frombuffer(data, dtype=np.uint8), [], 0
    while at < len(whole):
        end = min(at + GROUP, len(whole))
        while end < len(whole) and IS_WORD[whole[end - 1]] and IS_WORD[whole[end]]:
            gap = np.flatnonzero(~IS_WORD[whole[end : end + GROUP]])
            end = end + int(gap[0]) if len(gap) else min(end + GROUP, len(whole))
        s, e, h = _words_of(whole[at:end])
        parts.append((s + at, e + at, h))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def beginnings(words: Words, which: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first size bytes of the given words, which have as many; those bytes as a word would have the same hash."""
    data, up = np.frombuffer(words.data, dtype=np.uint8), powers(size)[0]
    total = np.zeros(len(which), dtype=np.uint64)
    for k in range(size):
        total += _value[data[words.starts[which] + k]] * up[k]
    return mix(total)


def groups(texts: list[bytes | None], most: int = GROUP) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in groups of about `most` bytes and at most 2^15 texts; null counts as empty."""
    group: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        text = text or b""
        if group and (size + len(text) > most or len(group) == 1 << 15):
            yield first, group
            group, size, first = [], 0, i
        group.append(text)
        size += len(text) + 1
    if group:
        yield first, group


def word_groups(texts: list[bytes | None]) -> Iterator[Words]:
    for first, group in groups(texts):
        data = b"\0".join(group) + b"\0"
        starts, ends, hashes = words_of(data)
        offsets = np.cumsum([0, *[len(t) + 1 for t in group]])
        yield Words(first, data, starts, ends, hashes, np.searchsorted(starts, offsets))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all runs of width words that lie in one text; positions count the group's words."""
    n = len(words.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(BASE) + words.hashes[k : k + n]
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    return at, mix(total[at] + np.uint64(width))


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string or binary column as bytes."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
