"""Word shingles of whole texts as 64-bit hashes, many documents at a time.

Words are runs of bytes other than space and \\x09 to \\x0D, with A-Z lower-cased. A prefix polynomial over the bytes
gives each word's hash as one difference; a shingle's hash mixes those of its words. Everything is arithmetic
over whole arrays, a bounded block of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at once; a longer text makes a block of its own.
BLOCK = 1 << 19
#: Odd multipliers, fixed so that hashes agree between tasks.
BASE, STEP, SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 to n - 1."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + (1 << 17))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a block."""
    a = np.frombuffer(block, np.uint8)
    n = len(a)
    up, down = _power_table(n + 1)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(SALT)), starts


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    ids: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        b = t.encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change
        if parts and size + len(b) > BLOCK:
            yield ids, parts
            ids, parts, size = [], [], 0
        ids.append(i)
        parts.append(b)
        size += len(b) + 1
    if parts:
        yield ids, parts


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for texts without words. A text with fewer than
    ``words`` words has one shingle, its whole sequence."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for ids, parts in _blocks(texts):
        w, starts = word_hashes(b"\n".join(parts))
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
        first = np.searchsorted(starts, bounds)
        whole = np.zeros(max(0, len(w) - words + 1), np.uint64)
        step = STEP
        for j in range(words):
            whole = whole * np.uint64(STEP) + w[j : len(whole) + j]
        whole = mixed(whole)
        for k, i in enumerate(ids):
            lo, hi = first[k], first[k + 1]
            if hi - lo >= words:
                s = np.sort(whole[lo : hi - words + 1])
                out[i] = s[np.append(True, s[1:] != s[:-1])]
            elif hi > lo:
                h = int(hi - lo)
                for x in w[lo:hi].tolist():
                    h = (h * step + x + SALT) & (1 << 64) - 1
                out[i] = mixed(np.array([h], np.uint64))
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
