"""Words and weighted word shingles of Arrow text columns, as 64-bit hashes computed by numpy.

A word is a maximal run of letters, digits and non-ASCII characters of the
lowercased text. A shingle is five words in a row; a text of one to four words
has one shingle of all of them, a text without words has none. A shingle that
occurs n times weighs 1 + ln n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 5
#: Texts are hashed in turns of about this many bytes.
TURN_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_factors = np.zeros(0, np.uint64)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factor(n: int) -> np.ndarray:
    """A pseudo-random odd factor for each of the first ``n`` places in a word."""
    global _factors
    if len(_factors) < n:
        _factors = mixed(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    return _factors[:n]


#: A pseudo-random number for each byte.
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def turns(texts: pa.Array, size: int = TURN_BYTES, least: int = 1) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``size`` bytes, each with its first row's number; a text counts for ``least`` bytes at least, and a long one is a slice of its own."""
    n = np.cumsum(np.maximum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), least))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + size, side="right")))
        yield at, texts.slice(at, upto - at)
        at = upto


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the lowercased texts, where each text's begin and the last ones end, and which bytes lie in words."""
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    at = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    raw = np.frombuffer(low.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return raw, at - at[0], _IN_WORD[raw]


def _ends(at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a word ends with its text."""
    n = len(inside)
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    before[at[:-1][at[:-1] < n]] = False
    after = np.concatenate([inside[1:], [False]]) if n else inside
    after[at[1:][at[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in a row, and where each text's words begin and the last ones end."""
    raw, at, inside = _lowered(texts)
    first, last = _ends(at, inside)
    length = last - first
    upto = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], length)
    # a sum of products with pseudo-random factors; powers of one base would let regular words collide
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[raw[inside]] * _factor(int(length.max(initial=0)))[place], dtype=np.uint64)])
    return mixed(sums[upto[1:]] - sums[upto[:-1]] + length.astype(np.uint64)), np.searchsorted(first, at)


def sequence_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (BLAKE2b) of each text's words, lowercased and one space apart, as two signed halves."""
    raw, at, inside = _lowered(texts)
    first, last = _ends(at, inside)
    length = last - first
    upto = np.concatenate([[0], np.cumsum(length + 1)])
    spaced = np.full(upto[-1], 32, np.uint8)
    spaced[np.arange(int(length.sum())) + np.repeat(np.arange(len(first)), length)] = raw[inside]
    edges, data = upto[np.searchsorted(first, at)].tolist(), spaced.data
    found = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def shingled(word: np.ndarray, at: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The shingle that starts at each word, in order, and where each text's shingles begin and the last ones end."""
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    edges = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(at[:-1] - edges[:-1], count) + np.arange(edges[-1])
    length = np.repeat(np.minimum(n, size), count)
    out = length.astype(np.uint64)
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    for k in range(size):
        out = mixed(out * _BASE + np.where(k < length, padded[start + k], np.uint64(0)))
    return out, edges


def weighted(shingle: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order within each text, their weights, and the texts' edges."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((shingle, row))
    s, r = shingle[order], row[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])]) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    times = np.diff(np.concatenate([first, [len(s)]]))
    return s[first], 1 + np.log(times), np.searchsorted(r[first], np.arange(len(edges)))


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two weighted sets (distinct ascending hashes, weights).

    It is the sum over common shingles d of 1 / sum_e max(x_e / x_d, y_e / y_d), where e runs over
    all shingles; with equal weights it is the plain Jaccard similarity. Sorting the common shingles by
    the ratio of their weights gives every inner sum from prefix sums.
    """
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia], wb[ib]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    # e counts with x_e / x_d where x_e / y_e >= x_d / y_d, else with y_e / y_d
    from_x = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    upto_y = np.concatenate([[0.0], np.cumsum(y)])
    cut = np.searchsorted(ratio, ratio, side="left")
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    return float(np.sum(1 / ((from_x[cut] + only_x) / x + (upto_y[cut] + only_y) / y)))
