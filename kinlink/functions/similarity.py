"""String similarities that Spark lacks, over Arrow batches: the Indel ratio family and Jaro-Winkler.

Ratios are 0 to 100, Jaro-Winkler 0 to 1.  Two empty texts are alike (100, 1) for ratio, partial and Jaro;
the token-set forms give 0 where a side has no token.  Distinct pairs of a batch are worked out once, those of ratios side by
side: longest common subsequences are found bit by bit of a machine word, one word for each pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that are compared at a time.
HELD = 1 << 21
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one whole number as wide as a."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & places.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def _codes(texts: list[str], width: int, fill: int) -> np.ndarray:
    """A row of code points for each text, filled up to width."""
    out = np.full((len(texts), width), fill, np.int32)
    sizes = np.array([len(t) for t in texts])
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _masks(a: list[str], b: list[str]) -> np.ndarray:
    """For each character of each b (one row a pair) the places in a that hold it, as bits."""
    wide = max(map(len, a), default=0)
    x, y = _codes(a, wide, -1), _codes(b, max(map(len, b), default=0), -2)
    out = np.zeros(y.shape, np.uint64)
    for i in range(wide):
        out |= np.where(y == x[:, i : i + 1], _BITS[i], np.uint64(0))
    return out


def _walked(masks: np.ndarray) -> np.ndarray:
    """The common subsequences' lengths of rows of masks."""
    free = np.full(len(masks), _ALL)
    for t in range(masks.shape[1]):
        hit = free & masks[:, t]
        free = (free + hit) | (free - hit)
    return np.bitwise_count(~free).astype(np.int64)


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """common_subsequence of each pair; pairs of like length side by side, texts of over 64 characters on both sides one by one."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    out = np.zeros(len(pairs), np.int64)
    narrow = sorted((i for i, (x, _) in enumerate(pairs) if 0 < len(x) <= 64), key=lambda i: len(pairs[i][1]))
    at = 0
    while at < len(narrow):
        n = max(1, HELD // max(len(pairs[narrow[min(at + 4095, len(narrow) - 1)]][1]), 1))
        here = narrow[at : at + min(n, 4096)]
        out[here] = _walked(_masks([pairs[i][0] for i in here], [pairs[i][1] for i in here]))
        at += len(here)
    for i, (x, y) in enumerate(pairs):
        if len(x) > 64:
            out[i] = common_subsequence(x, y)
    return out


def ratios(a: list[str], b: list[str]) -> list[float]:
    """Twice the common subsequence over both lengths, in hundredths."""
    n = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    return np.where(n == 0, 100.0, 200.0 * common_subsequences(a, b) / np.maximum(n, 1)).tolist()


def partial_ratios(a: list[str], b: list[str]) -> list[float]:
    """The best ratio of the shorter text against windows of its length in the longer one, cut windows at both ends included."""
    out, by_size = [0.0] * len(a), {}
    for i, (x, y) in enumerate(zip(a, b)):
        short, long = sorted((x, y), key=len)
        if not short:
            out[i] = 0.0 if long else 100.0
        elif short in long:
            out[i] = 100.0
        elif len(short) > 64:
            m, n = len(short), len(long)
            out[i] = max(200.0 * common_subsequence(short, w) / (m + len(w)) for k in range(1 - m, n) for w in (long[max(0, k) : k + m],))
        else:
            by_size.setdefault(len(short), []).append((i, short, long))
    for m, rows in by_size.items():
        rows.sort(key=lambda r: len(r[2]))
        at = 0
        while at < len(rows):
            here = rows[at : at + max(1, HELD // (m * (m + len(rows[min(at + 1023, len(rows) - 1)][2]))))][:1024]
            at += len(here)
            masks = _masks([r[1] for r in here], [r[2] for r in here])
            edge = np.zeros((len(here), m - 1), np.uint64)
            windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, masks, edge], axis=1), m, axis=1)
            k = np.arange(1 - m, 1 - m + windows.shape[1])
            n = np.array([len(r[2]) for r in here])[:, None]
            inside = np.minimum(k + m, n) - np.maximum(k, 0)
            best = np.where(inside > 0, 200.0 * _walked(windows.reshape(-1, m)).reshape(inside.shape) / (m + np.maximum(inside, 0)), 0.0).max(axis=1)
            for (i, _, _), v in zip(here, best.tolist()):
                out[i] = v
    return out


def token_sort_ratios(a: list[str], b: list[str]) -> list[float]:
    return ratios([" ".join(sorted(x.split())) for x in a], [" ".join(sorted(y.split())) for y in b])


def token_set_ratios(a: list[str], b: list[str]) -> list[float]:
    """The best of: common tokens against either side's, and one side's against the other's."""
    out, left, right, owner = [0.0] * len(a), [], [], []
    for i, (s, t) in enumerate(zip(a, b)):
        x, y = set(s.split()), set(t.split())
        if not x or not y:
            continue
        common = x & y
        if common and (common == x or common == y):
            out[i] = 100.0
            continue
        core = " ".join(sorted(common))
        one, two = (" ".join(filter(None, (core, " ".join(sorted(s - common))))) for s in (x, y))
        for p, q in [(one, two)] + [(core, one), (core, two)] * bool(common):
            left.append(p)
            right.append(q)
            owner.append(i)
    for i, v in zip(owner, ratios(left, right)):
        out[i] = max(out[i], v)
    return out


def partial_token_set_ratios(a: list[str], b: list[str]) -> list[float]:
    out, left, right, owner = [0.0] * len(a), [], [], []
    for i, (s, t) in enumerate(zip(a, b)):
        x, y = set(s.split()), set(t.split())
        if x & y:
            out[i] = 100.0
        elif x and y:
            left.append(" ".join(sorted(x)))
            right.append(" ".join(sorted(y)))
            owner.append(i)
    for i, v in zip(owner, partial_ratios(left, right)):
        out[i] = v
    return out


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for k in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[k] and b[k] == c:
                taken[k] = True
                left.append(c)
                break
    if not left:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken) if t))) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@lru_cache(maxsize=1 << 17)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised for up to four common first characters where it is above 0.7."""
    value = jaro(a, b)
    if value <= 0.7:
        return value
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return value + 0.1 * same * (1 - value)


def monge_elkan(a: str, b: str) -> float:
    """The mean over a's tokens of the best Jaro-Winkler among b's; 0 where a side has none."""
    x, y = a.split(), b.split()
    return sum(max(jaro_winkler(s, t) for t in y) for s in x) / len(x) if x and y else 0.0


def _crossed(lists: list[tuple[list[str], list[str]]]) -> list[list[list[float]]]:
    """For each pair of lists the ratios of each of the first with each of the second."""
    flat = ratios([x for one, two in lists for x in one for _ in two], [y for one, two in lists for _ in one for y in two])
    out, at = [], 0
    for one, two in lists:
        out.append([flat[at + i * len(two) : at + (i + 1) * len(two)] for i in range(len(one))])
        at += len(one) * len(two)
    return out


def component_matches(a: list[str], b: list[str]) -> list[list[float]]:
    """mean, least and largest of the best ratio of each '|' component of b among a's; -1 where a side has none."""
    lists = [tuple([c for c in s.split("|") if c] for s in (y, x)) for x, y in zip(a, b)]
    out = []
    for (one, two), rows in zip(lists, _crossed(lists)):
        best = [max(r) for r in rows] if two else []
        out.append([sum(best) / len(best), min(best), max(best)] if best else [-1.0] * 3)
    return out


def unmatched(a: list[str], b: list[str], least: float = 80.0) -> list[list[str]]:
    """a's components without digits that have no counterpart of at least `least` among b's."""
    lists = [tuple([c for c in s.split("|") if c and not re.search(r"\d", c)] for s in p) for p in zip(a, b)]
    return [[c for c, r in zip(one, rows) if all(v < least for v in r)] for (one, _), rows in zip(lists, _crossed(lists))]


def _each(f: Callable[[str, str], float]) -> Callable[[list[str], list[str]], list[float]]:
    return lambda a, b: list(map(f, a, b))


def _arrow(f: Callable[[list[str], list[str]], list], kind: str) -> Callable[[Column | str, Column | str], Column]:
    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        both = list(zip(a.fillna(""), b.fillna("")))
        distinct = list(dict.fromkeys(both))
        known = dict(zip(distinct, f([x for x, _ in distinct], [y for _, y in distinct])))
        return pd.Series([known[p] for p in both], dtype="object" if "array" in kind else "float64")

    # made at each use: workers import this module too, and have no session
    return lambda a, b: F.pandas_udf(pairs, kind)(a, b)


indel = _arrow(ratios, "double")
partial = _arrow(partial_ratios, "double")
token_sort = _arrow(token_sort_ratios, "double")
token_set = _arrow(token_set_ratios, "double")
partial_token_set = _arrow(partial_token_set_ratios, "double")
jaro_winkler_of = _arrow(_each(jaro_winkler), "double")
monge_elkan_of = _arrow(_each(monge_elkan), "double")
component_matches_of = _arrow(component_matches, "array<double>")
unmatched_of = _arrow(unmatched, "array<string>")
