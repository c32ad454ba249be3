import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.llm import repeats, simhash, suffixes
from tests.llm.test_text_ops import docs


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\x0b\x1cé", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == [brute_fingerprint(text)]


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (x >> 63 << 64)


def test_links_and_components_of_fingerprints(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:6]:  # chains, and a ball of more members than a list pairs
        at = base
        for _ in range(12):
            at ^= 1 << rng.randrange(64)
            fps.add(at)
    ball = rng.getrandbits(64)
    fps |= {ball ^ (1 << i) ^ (1 << k) for i in range(12) for k in range(12)}
    fps = sorted(fps, key=signed)
    want = brute_components(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for listed in (48, 2):
        simhash.LISTED = listed
        got = {r.fp: r.root for r in simhash.classes(df).collect()}
        for f, w in zip(fps, want):
            assert got.get(signed(f), signed(f)) == signed(fps[w])
    simhash.LISTED = 48


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base + " x", None, "", base.upper(), "other text of its own kind", base]
    df = docs(spark, texts, [5, 6, 9, 8, 7, 10, None]).withColumns({c: F.lit("clash") for c in ("fp", "row", "__row", "root", "component_id")})
    rows = simhash.near_duplicates(df).collect()
    fps = [brute_fingerprint(t) for t in texts]
    got = {(r.doc_id, r.fp) for r in rows}
    assert got == {(i, signed(f)) for i, f in zip([5, 6, 9, 8, 7, 10, None], fps)}
    comp = {r.doc_id: r.component_id for r in rows}
    assert comp[9] == comp[8] == 8 and comp[7] == comp[5] == comp[None] == 5 and comp[10] == 10
    named = docs(spark, texts + [base], [5, 6, 9, 8, 7, 10, None, 5]).withColumns({c: F.lit("clash") for c in ("row", "__row", "node")})
    kept = simhash.keep_one(named).collect()
    assert [(r.doc_id, r.row, r["__row"]) for r in kept].count((5, "clash", "clash")) == 1 and 7 not in {r.doc_id for r in kept}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


def test_keep_one_holds_pairs_against_their_shingles(spark):
    own = lambda k, n: " ".join(f"own{k}x{i}" for i in range(n))
    line = "one line that every page of the site repeats again " * 60
    base = own(9, 200).split()
    # unlike texts whose repeated line outweighs all else; one of a similarity under, and one of over 0.8
    texts = [line + own(k, 40) for k in range(4)] + [" ".join(base), " ".join(base[:175] + own(8, 25).split()), " ".join(base[:190] + own(7, 10).split())]
    assert {r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()} == {0, 1, 2, 3, 4, 5}


def templated(n, shared=320, own=180, changed=5):
    """n texts of one template and words of their own; each text 2k + 1 is text 2k but for `changed` spread words (similarity about 0.9)."""
    rng = random.Random(n)
    template = " ".join(f"site{i}" for i in range(shared))
    out = []
    for k in range(n // 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(own)]
        other = list(words)
        for i in rng.sample(range(10, own - 10), changed):
            other[i] += "x"
        out += [f"{template} {' '.join(words)}", f"{template} {' '.join(other)}"]
    return out


def test_keep_one_of_a_templated_source_is_whole(spark):
    texts = templated(600)
    assert [r.doc_id for r in simhash.keep_one(docs(spark, texts)).orderBy("doc_id").collect()] == list(range(0, 600, 2))


def test_keep_one_of_long_lists(spark):
    # one list holds all members, whose least is similar to its own partner only
    sets = [[1000 * (k // 2) + i for i in range(90)] + [10**6 + k] for k in range(80)]
    texts = docs(spark, [""] * 80)
    first = spark.createDataFrame([(k, [7, 8, 100 + k], [0] * 16) for k in range(80)], "node long, bands array<long>, sketch array<long>")
    held = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    keep, simhash._held_sets = simhash._held_sets, lambda *_: held
    try:
        got = {(r.a, r.b) for r in simhash.linked(texts, first).collect()}
    finally:
        simhash._held_sets = keep
    assert got == {(k, k + 1) for k in range(0, 80, 2)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_suffix_array(symbols):
    t = np.array(symbols)
    want = sorted(range(len(t)), key=lambda i: symbols[i:])
    for small in (512, 0):
        suffixes.SMALL = small
        assert suffixes.suffix_array(t, 4).tolist() == want
    suffixes.SMALL = 512
    common = suffixes.permuted_prefixes(t, np.array(want), 9, lane=5)
    for a, b in zip(want, want[1:]):
        n = 0
        while n < 9 and b + n < len(t) and a + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert common[b] == n


def brute_removal(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        yield len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long = prose(80), prose(400)
    texts = [None, "", "short", "ab" * 400, "x" * 199, "x" * 250, shared, shared]
    texts += [prose(rng.randrange(60)) + shared[rng.randrange(60) : 100 + rng.randrange(300)] + prose(rng.randrange(60)) for _ in range(20)]
    texts += [long[:k] + "#" + long[k:] for k in range(0, 2000, 170)] + [long, long + prose(3), "日本語テキスト" * 40 + shared]
    return texts


def test_segments_hold_each_window_once():
    raws = [(t or "").encode() for t in corpus()]
    keep = repeats.PIECE
    before, after = repeats.sides()
    for piece in (keep, 300):
        repeats.PIECE = piece
        key_of, seen, segs = {}, set(), {}
        for buffer, *columns in repeats.segments(raws):
            for t, b, s, n, key, q, side, seg in zip(*(x.tolist() for x in columns)):
                assert buffer[b : b + n + 199] == raws[t][s : s + n + 199] and n <= after
                assert segs.setdefault(seg, raws[t][s : s + n + 199]) == raws[t][s : s + n + 199]
                size = repeats.GRAM + (after if side else before)
                for i in range(n):
                    assert (t, s + i) not in seen and i <= q and q + size <= i + 200
                    seen.add((t, s + i))
                    assert key_of.setdefault(raws[t][s + i : s + i + 200], (key, q - i)) == (key, q - i)
        assert seen == {(t, i) for t, r in enumerate(raws) for i in range(len(r) - 199)}
    repeats.PIECE = keep


def test_refiled_pieces_hold_each_window_once():
    rng = random.Random(1)
    todo = [(0, bytes(rng.randrange(256) for _ in range(284)), 84, 116)]
    while todo:
        base, s, o, k = todo.pop()
        found = repeats._refiled(s, o, k, 200)
        assert [x for _, first, part, _, _ in found for x in range(first, first + len(part) - 199)] == list(range(len(s) - 199))
        for _, first, part, at, size in found:
            assert part == s[first : first + len(part)] and k < size <= 200 and len(part) - 200 <= at and at + size <= 200
            todo += [(base + first, part, at, size)] if size < 200 else []


def test_repeats_equal_brute_force(spark):
    texts = corpus()
    want = list(brute_removal(texts))
    df = docs(spark, texts).withColumn("tk", F.lit(1))
    for large in (repeats.LARGE, 2):
        repeats.covers.__defaults__ = (200, large)
        got = {r.doc_id: r for r in repeats.digests(df, ["doc_id", "tk"]).collect()}
        for i, w in enumerate(want):
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w, (large, i)
    repeats.covers.__defaults__ = (200, repeats.LARGE)
    assert repeats.digests(df.limit(0), ["doc_id"]).count() == 0


def test_repeats_of_a_very_long_text_and_many_copies(spark):
    rng = random.Random(8)
    long = " ".join(f"{rng.getrandbits(40):x}" for _ in range(30_000))
    texts = [long, "head " + long[100_000:250_000], *["one passage " + long[:400]] * 300, "y" * 70_000]
    got = {r.doc_id: r for r in repeats.digests(docs(spark, texts), ["doc_id"]).collect()}
    for i, w in enumerate(brute_removal(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w, i
    assert got[0].n_removed > 150_000 and got[0].n_spans == 2 and got[2].n_removed == got[2].n_bytes


def test_suffix_arrays_give_every_verdict(spark):
    # without suffix arrays nothing is repeated, whatever the hashes say
    keep, repeats.repeated = repeats.repeated, lambda parts, length: [np.zeros(max(0, len(p) - length + 1), bool) for p in parts]
    try:
        assert repeats.digests(docs(spark, corpus()), ["doc_id"]).where("n_removed > 0").count() == 0
    finally:
        repeats.repeated = keep


def test_cleaned_keeps_whole_characters(spark):
    shared = "日本語の文章" * 30
    rows = {r.doc_id: r for r in repeats.cleaned(docs(spark, ["é" + shared + "b", "本" + shared, None]), ["doc_id"]).collect()}
    assert rows[2].clean == "" and rows[0].spans and "b" in rows[0].clean
    for i in (0, 1):
        assert len(rows[i].clean) < 10


def test_keep_one_takes_the_pairs_of_the_fingerprint_index(spark):
    own = lambda k, n: " ".join(f"own{k}x{i}" for i in range(n))
    rows = simhash.nodes(docs(spark, [own(1, 900), own(1, 900) + " x", own(2, 900)]), ["doc_id"]).orderBy("doc_id").collect()
    assert bin((rows[0].fp ^ rows[1].fp) & (1 << 64) - 1).count("1") <= 2
    got = {(r.a, r.b) for r in simhash.proposed(spark.createDataFrame(rows).select("node", "fp")).collect()}
    assert got == {tuple(sorted((rows[0].node, rows[1].node)))}


def test_across_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(100), rng.randrange(84, 100))) for _ in range(60)] + [list(range(500 + k, 600 + k)) for k in (0, 3)]
    alike = lambda a, b: 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))
    left = spark.createDataFrame([(k, k, [1, 2]) for k in range(62)], "node long, root long, keys array<long>")
    held = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    want = {(a, b) for a in range(62) for b in range(a + 1, 62) if alike(sets[a], sets[b])}
    assert 0 < len(want) < 61 * 31
    for size in (4096, 9):
        monkeypatch.setattr(simhash, "BLOCK", size)
        assert {(r.a, r.b) for r in simhash._across(left, held).collect()} == want
