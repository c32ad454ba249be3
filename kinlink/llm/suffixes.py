"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their successors.  Leftmost S suffixes bound
substrings that are sorted some symbols at a time; their names form a shorter text, whose suffix array is
made recursively where names repeat; a round of induction gives the whole array from it.  A virtual end
smaller than every symbol closes the text.  Over small alphabets a round walks the buckets in order and
induces all known entries of a bucket at once, again while the bucket grows; over the large alphabets of
recursion it sorts entries by their symbols up to the next leftmost suffix, and then as those are.
"""

from __future__ import annotations

import itertools

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
SMALL = 512
#: Rounds of sorting by some more symbols; what is still equal then is sorted by all of the rest.
ROUNDS = 12


def _classes(t: np.ndarray) -> np.ndarray:
    """True for S suffixes: the next different symbol is larger."""
    n = len(t)
    differs = t[1:] != t[:-1]
    at = np.where(differs, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    out = np.zeros(n, bool)
    out[:-1] = np.append(t[1:] > t[:-1], False)[following]
    return out


def _order(symbols: np.ndarray) -> np.ndarray:
    """A stable order by symbol, in linear time: a counting sort of 8 or 16 bits, wider symbols by their halves."""
    if symbols.dtype.itemsize <= 2:
        return np.argsort(symbols, kind="stable")
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]


def _spread(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, the place of each entry among its equals, and the symbols with their counts."""
    order = _order(symbols)
    s = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    count = np.diff(np.append(first, len(s)))
    return order, np.arange(len(s)) - np.repeat(first, count), s[first], count


def _induce_buckets(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    n = len(t)
    sa = np.full(n, -1, np.int64)
    size = np.bincount(t, minlength=k)
    stop = np.cumsum(size)
    start = stop - size
    larger = np.bincount(t[~smaller], minlength=k)
    before = np.arange(-1, n - 1)
    to_l = np.where((before >= 0) & ~smaller[before], before, -1)
    to_s = np.where((before >= 0) & smaller[before], before, -1)
    seeded = np.zeros(k, np.int64)
    if len(seeds):
        order, place, symbols, count = _spread(t[seeds])
        seeded[symbols] = count
        s = t[seeds][order]
        sa[stop[s] - seeded[s] + place] = seeds[order]
    present = np.flatnonzero(size).tolist()
    fill = start.copy()

    def push(entries: np.ndarray, source: np.ndarray, way: int) -> None:
        j = source[entries]
        j = j[j >= 0]
        if not len(j):
            return
        order, place, symbols, count = _spread(t[j])
        j = j[order]
        sa[fill[t[j]] + way * place - (way < 0)] = j
        fill[symbols] += way * count

    last = t[n - 1]
    sa[fill[last]] = n - 1
    fill[last] += 1
    for c in present:
        a = start[c]
        while a < fill[c]:
            b = fill[c]
            push(sa[a:b], to_l, 1)
            a = b
        if seeded[c]:
            push(sa[stop[c] - seeded[c] : stop[c]], to_l, 1)
    fill = stop.copy()
    for c in reversed(present):
        b = stop[c]
        while b > fill[c]:
            a = fill[c]
            push(sa[a:b][::-1], to_s, -1)
            b = a
        if larger[c]:
            push(sa[start[c] : start[c] + larger[c]][::-1], to_s, -1)
    return sa


def _induce_entries(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The array from sorted seeds by sorts of all entries at once.

    Entries are sorted by as many symbols with their classes (S above L) as make one number, then by ever twice as many.  Equal
    symbols reach the next seed at the same distance; once they do, the seeds' order is theirs.
    """
    n, bits = len(t), (2 * k).bit_length()
    size = 64 // bits
    wide = np.zeros(n + size, np.uint64)
    wide[:n] = (t.astype(np.uint64) << np.uint64(1)) + smaller + np.uint64(1)
    codes = wide[:n].copy()
    for i in range(1, size):
        codes = (codes << np.uint64(bits)) | wide[i : n + i]
    # the virtual end is the least seed
    known = np.zeros(n + 1, np.int64)
    known[seeds] = np.arange(1, len(seeds) + 1)
    following = np.where(known > 0, np.arange(n + 1), n)
    following = np.minimum.accumulate(following[::-1])[::-1][1:]
    sa = np.argsort(codes)
    codes = codes[sa]
    differs = np.concatenate(([True], codes[1:] != codes[:-1]))
    some = np.arange(n)
    rank = np.zeros(n + 1, np.int64)
    while True:
        # ranks are the first places of equals, from 1
        first = np.maximum.accumulate(np.where(differs, some, 0))
        rank[sa[some]] = first + 1
        equal = ~differs
        equal[:-1] |= ~differs[1:]
        if not equal.any():
            return sa
        some, first = some[equal], first[equal]
        at = sa[some]
        seed = following[at]
        behind = np.where(seed - at < size, known[seed], rank[np.minimum(at + size, n)])
        codes = (first << 32) | behind
        by = np.argsort(codes)
        sa[some], codes = at[by], codes[by]
        differs = np.concatenate(([True], codes[1:] != codes[:-1]))
        size *= 2


def _sorted_substrings(t: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the substrings from each leftmost S suffix through the next, and whether each differs from the one before it.

    A symbol counts with its class (S above L), so that none is a proper prefix of another; the last one ends in the virtual end, zero.
    As many symbols as fit make one number; equal numbers are told apart by the symbols behind, the longest ones by their bytes.
    """
    n, m, bits = len(t), len(leftmost), (2 * k).bit_length()
    wide = np.zeros(n + 1, np.uint64)
    wide[:n] = (t.astype(np.uint64) << np.uint64(1)) + smaller + np.uint64(1)
    length = np.append(np.diff(leftmost) + 1, n + 1 - leftmost[-1])
    each = 64 // bits

    def code(of: np.ndarray, at: int) -> np.ndarray:
        out, begin, left = np.zeros(len(of), np.uint64), leftmost[of] + at, length[of] - at
        for i in range(each):
            out = (out << np.uint64(bits)) | np.where(left > i, wide[np.minimum(begin + i, n)], np.uint64(0))
        return out

    codes = code(np.arange(m), 0)
    order = np.argsort(codes)
    codes = codes[order]
    differs = np.concatenate(([True], codes[1:] != codes[:-1]))
    for at in range(each, ROUNDS * each + 1, each):
        # equal so far, and so as long as each other or both longer
        equal = ~differs
        equal[:-1] |= ~differs[1:]
        some = np.flatnonzero(equal & (length[order] > at))
        if not len(some):
            break
        group = np.cumsum(differs)[some]
        if at < ROUNDS * each:
            codes = code(order[some], at)
            by = np.lexsort((codes, group))
            new = codes[by][1:] != codes[by][:-1]
        else:
            big = wide.astype(">u8")
            rest = [big[a:b].tobytes() for a, b in zip((leftmost[order[some]] + at).tolist(), (leftmost[order[some]] + length[order[some]]).tolist())]
            by = np.array(sorted(range(len(some)), key=lambda i: (group[i], rest[i])))
            new = np.array([rest[i] != rest[j] for i, j in zip(by[1:], by[:-1])], bool)
        order[some] = order[some[by]]
        differs[some[1:]] |= new
    return order, differs


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of symbols 0 to k - 1 (2 ** 32 at most)."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t.astype(np.uint8 if k <= 1 << 8 else np.uint16 if k <= 1 << 16 else np.uint32, copy=False)
    smaller = _classes(t)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induce_buckets if k <= SMALL else _induce_entries
    if len(leftmost) < 2:
        return induce(t, smaller, leftmost, k)
    order, differs = _sorted_substrings(t, smaller, leftmost, k)
    name = np.cumsum(differs) - 1
    if name[-1] + 1 < len(leftmost):
        short = np.empty(len(leftmost), np.int64)
        short[order] = name
        order = suffix_array(short, int(name[-1]) + 1)
    return induce(t, smaller, leftmost[order], k)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int, lane: int = 64, places: np.ndarray | None = None) -> np.ndarray:
    """For each position of a byte text (of rising places, if given), the common prefix (up to `most`) with the suffix before it in sa.

    In text order a prefix is at most one shorter than the one before it; lanes of `lane` places are
    walked side by side, eight bytes at a comparison.  Elsewhere than at the places nothing is told (0).
    """
    n = len(t)
    out = np.zeros(n, np.int64)
    places = np.arange(n) if places is None else places
    if n < 2 or not len(places):
        return out
    partner = np.full(n, -1, np.int64)
    partner[sa[1:]] = sa[:-1]
    wide = np.concatenate((t.astype(np.uint8), np.zeros(most + 16, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(wide, 8).copy().view("<u8").ravel()
    starts = np.arange(0, len(places), lane)
    held, last = np.zeros(len(starts), np.int64), places[starts]
    for step in range(lane):
        if starts[-1] + step >= len(places):
            starts, held, last = starts[:-1], held[:-1], last[:-1]
            if not len(starts):
                break
        at = places[starts + step]
        p = partner[at]
        limit = np.where(p < 0, 0, np.minimum(n - np.maximum(at, p), most))
        held, last = np.minimum(np.maximum(held - (at - last), 0), limit), at
        open_ = np.flatnonzero(held < limit)
        while len(open_):
            h = held[open_]
            x = words[at[open_] + h] ^ words[p[open_] + h]
            low = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            held[open_] = np.minimum(h + low, limit[open_])
            open_ = open_[(low == 8) & (held[open_] < limit[open_])]
        out[at] = held
    return out


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its `length`-byte windows also start elsewhere in the parts.

    One suffix array over all parts, each followed by byte 255, which UTF-8 never has: a window with a
    neighbour in the array that shares `length` bytes with it occurs twice.
    """
    if not parts:
        return []
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    sa = suffix_array(text, 256)
    # only at begins of windows; what such a one shares `length` bytes with is one too
    starts = [(at - len(p) - 1, max(0, len(p) - length + 1)) for p, at in zip(parts, itertools.accumulate(len(p) + 1 for p in parts))]
    places = np.concatenate([np.arange(at, at + windows) for at, windows in starts])
    common = permuted_prefixes(text, sa, length, places=places)[sa] >= length
    twice = np.zeros(len(text), bool)
    twice[sa[common]] = True
    twice[sa[np.flatnonzero(common) - 1]] = True
    return [twice[at : at + windows] for at, windows in starts]
