"""Word hashes of whole texts, a batch of Arrow rows at a time, with numpy.

Words are runs of anything but space and bytes 0x09 to 0x0D; A to Z are lower-cased. A word's
hash is a polynomial over random values of its bytes, modulo 2**64, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; temporaries are about 60 times this.
PIECE = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Space and punctuation: what is not a letter, a digit or a byte of a non-ASCII character.
BREAKS = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts in them; null is empty."""
    column = column.cast(pa.large_binary())  # first: chunks of 32-bit offsets may be too large for one
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def runs(offs: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``piece`` bytes each; a longer row is alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + piece, "right")) - 1)
        yield i, j
        i = j


def _words(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = LOWER[data]
    word = ~gaps[x]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offs[offs < len(data)]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = heads[heads > 0] - 1
    last[tails] = word[tails]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[x] * up[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s]), np.searchsorted(s, offs)


def words(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows ``offs`` of ``data``, and where each row's words start.

    ``gaps`` says which bytes part words.
    """
    if len(data) <= 4 * PIECE or len(offs) > 2:
        return _words(data, offs, gaps)
    parts, at = [], 0  # one very long text, cut at white space
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not (gap := np.flatnonzero(gaps[data[end : end + PIECE]])[:1]).size:
            end = min(len(data), end + PIECE)
        if end < len(data):
            end += int(gap[0]) + 1
        parts.append(_words(data[at:end], np.array([0, end - at]), gaps)[0])
        at = end
    return np.concatenate(parts), np.array([0, sum(map(len, parts))])


def each_run(column: pa.Array, piece: int = PIECE, gaps: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j of a string column, with the hashes of their words and each row's start in these."""
    data, offs = bytes_of(column)
    for i, j in runs(offs, piece):
        yield i, j, *words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], gaps)


def packed(values: np.ndarray, shard: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each shard that occurs, the places of its values."""
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(n + 1))
    for k in np.flatnonzero(bounds[1:] > bounds[:-1]):
        yield int(k), values[order[bounds[k] : bounds[k + 1]]]


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Shard of each hash, from its upper 32 bits."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def joined(column: pa.Array, dtype: type) -> np.ndarray:
    """All values of a column of packed arrays, one after another."""
    data, _ = bytes_of(column)
    return np.frombuffer(data.tobytes(), dtype)
