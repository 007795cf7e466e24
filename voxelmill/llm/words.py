"""Word splitting and hashing over whole columns of text, vectorised over the UTF-8 bytes.

A word is a run of bytes other than space and 0x09 to 0x0D. All hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint8)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Buffers are cut at about this many bytes, between words, so that the tables of powers stay small.
BLOCK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all the others; a bijection."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    for table, base in ((up, BASE), (down, BASE_INVERSE)):
        table[0] = 1
        table[1:] = base
        np.multiply.accumulate(table, out=table)
    return up, down


@lru_cache(maxsize=4)
def byte_map(lower: bool, letters_only: bool) -> np.ndarray:
    """Byte to byte; separators become 255, which UTF-8 never holds."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[ord("A") : ord("Z") + 1] += 32
    table[SPACES] = 255
    if letters_only:
        ascii_part = np.arange(128)
        word_like = [chr(c).isalnum() or c == ord("'") for c in ascii_part]
        table[ascii_part[~np.array(word_like)]] = 255
    return table


def blocks(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts mapped bytes into stretches of about BLOCK bytes that end with a separator."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and raw[end - 1] != 255:
            rest = np.flatnonzero(raw[end : end + BLOCK] == 255)
            end = end + int(rest[0]) + 1 if len(rest) else min(n, end + BLOCK)
        yield at, end
        at = end


def word_table(texts: list[str | None], lower: bool = False, letters_only: bool = False, prefixes: tuple[int, ...] = ()):
    """Hashes of all words of all texts, in order.

    Returns (hashes, first, starts, ends, prefix_hashes): words of text i are hashes[first[i]:first[i + 1]];
    starts and ends are byte offsets in the text's own UTF-8. prefix_hashes has for each of ``prefixes`` the hash of
    the word's first so many bytes (the whole word's hash where it is shorter). Nulls count as empty.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    raw = byte_map(lower, letters_only)[np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)]
    found: list[tuple[np.ndarray, ...]] = []
    for lo, hi in blocks(raw):
        part = raw[lo:hi]
        inside = np.concatenate(([False], part != 255, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        up, down = powers(max(BLOCK, 1 << int(hi - lo - 1).bit_length()))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        hashed = [mix((total[e] - total[starts]) * down[starts]) for e in (ends, *(np.minimum(ends, starts + p) for p in prefixes))]
        found.append((starts + lo, ends + lo, *hashed))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint64)] * (1 + len(prefixes))
    starts, ends = columns[0], columns[1]
    first = np.searchsorted(starts, offsets)
    base = np.repeat(offsets[:-1], np.diff(first))
    return columns[2], first, starts - base, ends - base, columns[3:]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row; of all the words as one when there are fewer; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return h


def text_batches(texts: list, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of a batch whose texts have about ``most_bytes`` characters together."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most_bytes:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
