"""Substrings are sorted by their symbols: the whole array is induced once a level."""

import numpy as np

from kinlink.llm import suffixes


def test_one_round_of_induction_a_level(monkeypatch):
    seen = []
    for name in ("_induce_buckets", "_induce_entries"):
        whole = getattr(suffixes, name)
        monkeypatch.setattr(suffixes, name, lambda t, *rest, whole=whole: seen.append(len(t)) or whole(t, *rest))
    text = np.random.default_rng(7).integers(97, 123, 4000)
    suffixes.suffix_array(np.concatenate([text, text]), 256)
    # each level is a shorter text
    assert len(seen) > 1 and len(set(seen)) == len(seen)


def test_substrings_beyond_all_rounds():
    runs = [np.full(n, s) for n, s in [(900, 1), (1, 2), (700, 1), (1, 0), (900, 1), (1, 2), (899, 1), (1, 2), (3, 1), (900, 0), (1, 3), (900, 0)]]
    for k in (4, 1000, 1 << 20):
        t = np.concatenate(runs)
        raw = t.astype(np.uint8).tobytes()
        assert suffixes.suffix_array(t, k).tolist() == sorted(range(len(t)), key=lambda i: raw[i:])


def test_large_alphabets_equal_brute_force():
    rng = np.random.default_rng(11)
    runs = np.repeat(rng.integers(0, 3, 40), rng.integers(1, 300, 40))
    for t, k in [(rng.integers(0, 700, 3000), 700), (np.tile(rng.integers(0, 1 << 20, 90), 30), 1 << 20), (runs * 1000, 1 << 12), (runs[::-1].copy(), 1 << 16)]:
        smaller = suffixes._classes(t)
        leftmost = set((np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).tolist())
        told = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffixes._induce_entries(t, smaller, np.array([i for i in told if i in leftmost], np.int64), k).tolist() == told


def test_prefixes_only_at_begins_of_windows(monkeypatch):
    rng, seen, whole = np.random.default_rng(5), [], suffixes.permuted_prefixes
    text = rng.integers(97, 100, 900).astype(np.uint8)
    text[500:800] = text[100:400]
    sa = suffixes.suffix_array(text, 256)
    some = np.flatnonzero(rng.random(900) < 0.3)
    every = whole(text, sa, 250)
    for lane in (1, 7, 64):
        assert whole(text, sa, 250, lane, some)[some].tolist() == every[some].tolist()
    monkeypatch.setattr(suffixes, "permuted_prefixes", lambda *a, **b: seen.append(len(b["places"])) or whole(*a, **b))
    a, b = text[:450].tobytes(), text[480:].tobytes()
    marks = suffixes.repeated([a, b"short", b, b""], 200)
    assert seen == [len(a) + len(b) - 2 * 199]
    assert [m.tolist() for m in marks] == [[(a + b"\xff" + b).count(p[i : i + 200]) > 1 for i in range(max(0, len(p) - 199))] for p in (a, b"short", b, b"")]
