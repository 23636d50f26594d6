"""Vectorised word splitting and hashing of Arrow text columns inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the two polynomial hashes; any odd values do.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
#: Texts are handled in groups of about this many bytes, which bounds the memory of a task.
GROUP_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of words: all but space and the ASCII controls from tab to carriage return.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS, TAILS = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
TAILS[list(b".,;:?!")] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


class Powers:
    """Powers of ``BYTE_BASE`` and its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = powers(BYTE_BASE, n)
            self.down = powers(pow(BYTE_BASE, -1, 1 << 64), n)
        return self.up, self.down


def groups(texts: pa.Array, limit: int = GROUP_BYTES, lower: bool = True):
    """Yield (first row, bytes, with A-Z lower-cased if ``lower``, offsets) over
    runs of rows of about ``limit`` bytes. Null texts are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    raw, body = texts.buffers()[1], texts.buffers()[2]
    offsets = np.frombuffer(raw, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        part = data[offsets[first] : offsets[last]]
        yield first, LOWER[part] if lower else part, offsets[first : last + 1] - offsets[first]
        first = last


def split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of each text, and the number of the
    text that each word is in. A word never crosses two texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def distinct(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each word among them, and the
    number of the first word of each text, with the count of all words at the end.
    One of ``TAILS`` that ends a word after an ASCII letter is a word of its own."""
    starts, ends, owner = split(data, offsets, table)
    cut = (ends - starts > 1) & TAILS[data[ends - 1]] & LETTERS[data[ends - 2]]
    starts, ends, owner = np.sort(np.concatenate([starts, ends[cut] - 1])), np.sort(np.concatenate([ends - cut, ends[cut]])), np.sort(np.concatenate([owner, owner[cut]]))
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    body = np.ascontiguousarray(data[table[data]])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(body)).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False), np.searchsorted(owner, np.arange(len(offsets)))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cache: Powers) -> np.ndarray:
    """A 64-bit hash of each word; it depends on the word's bytes alone."""
    up, down = cache.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def windows(hashed: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive words."""
    n = len(hashed) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j, weight in enumerate(powers(WORD_BASE, length)):
        out += hashed[j : j + n] * weight
    return mix(out)
