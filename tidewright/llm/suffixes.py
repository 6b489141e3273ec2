"""Suffix arrays by induced sorting, with whole buckets at a time in numpy."""

from __future__ import annotations

import numpy as np

from tidewright.llm.tokens import VALUES, mix, powers


def prefix_hashes(t: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any substring follows."""
    up, _ = powers(len(t) + 1)
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(VALUES[t] * up[: len(t)], out=sums[1:])
    return sums


def substring_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (S), by the first character that differs; the last is."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int16) - t[:-1]).astype(np.int8)
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the character changes
    out = np.ones(n, bool)
    out[:-1] = np.where(at < n - 1, np.take(np.append(step, 1), np.minimum(at, n - 1)) > 0, False)
    return out


def _dealt(places: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends places to the buckets of their characters, in order."""
    order = np.argsort(chars, kind="stable")
    places, chars = places[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    firsts = np.concatenate([[0], cuts])
    for c, part in zip(chars[firsts], np.split(places, cuts), strict=True):
        into[c].append(part)


def induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the order of the leftmost smaller ones (``lms``).

    Larger suffixes follow from left to right, smaller ones from right to left. A bucket is walked
    in waves: what a wave induces within its own bucket is the next wave.
    """
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    _dealt(lms, t[lms], seeds)
    coming: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger: list[np.ndarray] = []
    none = lms[:0]
    for c in range(256):
        done, wave = [], (np.concatenate(coming[c]) if coming[c] else none)
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            chars = t[before]
            wave = before[chars == c]
            rest = chars > c
            if rest.any():
                _dealt(before[rest], chars[rest], coming)
        larger.append(np.concatenate(done) if done else none)
        for part in seeds[c]:
            before = part[part > 0] - 1
            before = before[~small[before]]
            if len(before):
                _dealt(before, t[before], coming)
    coming = [[] for _ in range(256)]
    smaller: list[np.ndarray] = []
    for c in range(255, -1, -1):
        done, wave = [], (np.concatenate(coming[c]) if coming[c] else none)
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[small[before]]
            chars = t[before]
            wave = before[chars == c]
            rest = chars < c
            if rest.any():
                _dealt(before[rest], chars[rest], coming)
        smaller.append(np.concatenate(done)[::-1] if done else none)
        before = larger[c][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        if len(before):
            _dealt(before, t[before], coming)
    smaller.reverse()
    smaller[0] = np.array([len(t) - 1], lms.dtype)  # the end of the text, which nothing induces
    return np.concatenate([x for c in range(256) for x in (larger[c], smaller[c])])


def _digits(names: np.ndarray) -> tuple[np.ndarray, int]:
    """A text of names as a text of bytes: each name as digits from 1 to 255, as many as the largest takes; and 0 at the end."""
    width = 1
    while 255**width <= int(names.max(initial=0)):
        width += 1
    out = np.zeros(len(names) * width + 1, np.uint8)
    for k in range(width):
        out[width - 1 - k : -1 : width] = names // 255**k % 255 + 1
    return out, width


def _ranked(names: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of a reduced text by their first ``most`` names, by doubling of ranks.

    This is for the texts of names whose digits are more than half as long as what they were reduced from.
    """
    rank, width = names.astype(np.int64), 1
    while True:
        after = np.zeros_like(rank)
        after[:-width] = rank[width:] + 1
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros_like(rank)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, width = new, width * 2
        if rank.max() == len(rank) - 1 or width >= most or width >= len(rank):
            return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray, most: int) -> np.ndarray:
    """Suffixes of ``t`` in order of their first ``most`` characters at least.

    ``t`` must end in a character 0 that is nowhere else in it.
    """
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int32)
    small = smaller_types(t)
    starts = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    # Leftmost smaller substrings in order: by induction from any order of their first characters.
    rough = induced(t, small, starts)
    is_lms = np.zeros(n, bool)
    is_lms[starts] = True
    ordered = rough[is_lms[rough]]
    place = np.zeros(n, np.int32)
    place[starts] = np.arange(len(starts))
    sums = prefix_hashes(t)
    end = np.minimum(np.append(starts[1:], n - 1) + 1, n)
    h = substring_hashes(sums, starts, end)[place[ordered]]
    names = np.zeros(len(starts), np.int64)
    names[place[ordered]] = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    if len(starts) > 1 and names.max() < len(starts) - 1:
        # Names repeat: the order of the text of names, of which none is shorter than two characters.
        digits, width = _digits(names)
        if 2 * len(digits) <= n:  # the same sorting of a text of half the length or less
            order = suffix_array(digits, (most // 2 + 2) * width)
            ordered = starts[order[(order % width == 0) & (order < len(digits) - 1)] // width]
        else:
            ordered = starts[_ranked(names, most // 2 + 2)]
    return induced(t, small, ordered)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place the common prefix with the suffix before it in order, up to ``most`` characters.

    ``sa`` may hold a part of the places, in order; others get 0.
    """
    sums, n = prefix_hashes(t), len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.flatnonzero(before >= 0)
    j, out = before[i], np.zeros(len(i), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        a, b = i + out, j + out
        ok = (np.maximum(a, b) + step <= n) & (out + step <= most)
        at = np.flatnonzero(ok)
        same = substring_hashes(sums, a[at], a[at] + step) == substring_hashes(sums, b[at], b[at] + step)
        out[at[same]] += step
        step >>= 1
    plcp = np.zeros(n, np.int64)
    plcp[i] = out
    return plcp
