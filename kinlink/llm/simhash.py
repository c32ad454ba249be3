"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes.  Two fingerprints that differ in at most two bits agree
in at least six of them.  The index posts each distinct fingerprint under combinations of four positional
bytes: with the positions dealt into four pairs, two differing positions touch two pairs at most, so the
other two pairs agree and one of the six combinations of two pairs is shared by every pair that can reach
the six matches.  For pairs that meet in a posting list the shared positional bytes are tallied, pairs
below the guaranteed minimum are dropped, and the rest are verified by their differing bits.

A posting list longer than LISTED would give a square of pairs.  Its members are linked in an exact linear way instead:
each posts itself and its 64 one-bit neighbours, and members that share a post are within two bits of
each other, and the other way round; each post links its members to their smallest one.

Similarity search (keep_one) takes the pairs of this index over the fingerprints of the five-word shingle sets.  Sets of a similarity
of 0.8 differ in some ten bits of 64, so it also indexes positions of another signature, the sets' least hashes, in the same way:
it posts combinations of eight positions, tallies the shared positional bytes of each pair that meets and drops pairs below the
minimum.  All pairs of both are verified by their sets; see linked().

Texts of any length count as a whole; a worker holds some 30 bytes for each word of the text at hand.
"""

from __future__ import annotations

import random
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import delete, new_path, scratch, stored, text_pass

SEED = 42
SHINGLE = 3
BITS = 2
#: Positional bytes that two fingerprints within BITS bits share at least.
LEAST = 8 - BITS
#: Members of a posting list that are paired; longer lists are linked through one-bit neighbours.
LISTED = 48
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 14


def _shingle_hashes(text: str | None, shingle: int):
    """Yields the shingles' hashes, some at a time.  Fewer words than a shingle: the whole sequence is one; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    behind = min(shingle, len(words)) - 1
    starts, stops = begins[: len(words) - behind].tolist(), ends[behind:].tolist()
    for a in range(0, len(starts), COUNTED):
        cut = map(joined.__getitem__, map(slice, starts[a : a + COUNTED], stops[a : a + COUNTED]))
        yield np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, min(COUNTED, len(starts) - a))


#: For each byte eight counters of eight bits, one for each of its bits.
_LANES = np.array([sum((v >> b & 1) << 8 * b for b in range(8)) for v in range(256)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set; up to 255 are summed in eight-bit counters."""
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, parts: int = 1) -> list[int]:
    """The SimHash of a text's word shingles (A-Z lower-cased, repeats included), as `parts` unsigned 64-bit numbers.

    The first is of the shingles' hashes, the others of those hashes mixed again.  No word or null: zero.
    """
    n, ones = 0, np.zeros((parts, 64), np.int64)
    for h in _shingle_hashes(text, shingle):
        n += len(h)
        for k in range(parts):
            ones[k] += _ones(h)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return [sum(1 << int(b) for b in np.flatnonzero(2 * o > n)) for o in ones]


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE, parts: int = 1) -> DataFrame:
    """keep and fp (with more parts fp, fp1, ...), the fingerprint as signed longs."""

    def begin():
        return lambda texts: list(zip(*[[f - (f >> 63 << 64) for f in fingerprint(t, shingle, parts)] for t in texts])) or [[]] * parts

    return text_pass(docs, keep, "text", [("fp" if k == 0 else f"fp{k}", "long") for k in range(parts)], begin)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _lists(fp: Column) -> Column:
    """The six posting lists of a fingerprint: which two pairs of positions, and their four bytes."""
    pairs = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)]
    return F.array(*[F.lit(n << 32) + pairs[i] * 65536 + pairs[k] for n, (i, k) in enumerate(combinations(range(4), 2))])


def links(fps: DataFrame) -> DataFrame:
    """Links (a < b) between the distinct fingerprints of fps (column fp): enough to give its components at BITS bits.

    All pairs within BITS bits that share a list of up to LISTED members are returned; those of longer
    lists are replaced by links of the same components.
    """
    posts = fps.select("fp", F.explode(_lists(F.col("fp"))).alias("key"))
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(posts.join(sizes, "key"), "posts")
    few, many = met.where(F.col("n") <= LISTED), met.where(F.col("n") > LISTED).select("fp").distinct()
    pair = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b")
    other = F.col("a").bitwiseXOR(F.col("b"))
    tally = reduce(lambda x, y: x + y, [F.when(_byte(other, i) == 0, 1).otherwise(0) for i in range(8)])
    near = pair.where(tally >= LEAST).where(F.bit_count(other) <= BITS).select("a", "b")
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64)])
    posted = many.select("fp", F.explode(around).alias("post"))
    least = posted.groupBy("post").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("post", "a")
    star = posted.join(least, "post").where("a < fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node in edges (a, b), by alternating stars.

    A large star links every larger neighbour of a node to the smallest node around it; a small star
    does so for smaller neighbours.  Each round is stored, as small files are read together, and the one before it deleted; only counts
    and sums reach the driver.
    """
    spark, before, path = edges.sparkSession, None, ""
    left = edges.select("a", "b").where("a <> b").distinct()
    while True:
        last, path = path, new_path(spark, "edges")
        now = stored(left, "edges", path)
        if last:
            delete(spark, last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).select("col.a", "col.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")
        # here a < b: the smaller neighbours of b are its a
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        left = large.join(small, "b").select(F.col("m").alias("r"), "a", "b").select("r", F.explode(F.array("a", "b")).alias("x")).where("r <> x").select(F.col("r").alias("a"), F.col("x").alias("b")).distinct()
    return now.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("root")).distinct()


def classes(fps: DataFrame) -> DataFrame:
    """fp and root (the smallest linked fingerprint) of the distinct fingerprints of fps that have a link."""
    return components(links(fps.select("fp").distinct())).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, fp and component_id (the smallest key reachable over links, itself included) of every row.

    Equal fingerprints, zero ones included, are one class.  Null and empty texts have fingerprint zero.  Repeated rows each get a row; null keys are
    never a component_id unless a component has no other.  An empty table stays empty, a text of any length counts as a whole,
    and other columns of docs, whatever their names, play no part.
    """
    rows = stored(fingerprints(docs, [key], shingle), "fingerprints")
    first = rows.groupBy("fp").agg(F.min(key).alias("first"))
    rooted = first.join(classes(first), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(key, "fp", "component_id")


#: Similarity search: words of a shingle, bands of a set's signature and least hashes in a band.  Two sets of similarity 0.8
#: agree in no band with a chance of (1 - 0.8 ** 8) ** 48, about 1 in 6,800.
WORDS, BANDS, ROWS = 5, 48, 8
#: Positional bytes of a sketch, eight in a long, each from one of the least hashes, and how many a pair must share: two sets of
#: similarity 0.8 share 102 with a deviation of 4.5, and so fewer than this with a chance under one in a million.
SKETCHED, SHARED = 128, 80
#: The least Jaccard similarity of two documents' shingle sets, as a fraction.
ALIKE = (4, 5)
#: Members of a band's list that are paired at once; longer lists are linked through central members first, see linked().
PAIRED = 32
#: How many members of a longer list all others are held against, one after another, before the rest is paired.
CENTRES = 3
#: Sets of a cluster that a task holds against as many.
BLOCK = 4096
#: Shingles whose hashes are mixed at a time.
MIXED = 512
_MIX = np.array([random.Random(i).getrandbits(32) | 1 for i in range(BANDS * ROWS)], np.uint32)


def _hash_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingle_hashes(text, shingle)]))


def shingle_sets(docs: DataFrame, keep: list[str], shingle: int = WORDS) -> DataFrame:
    """keep and shingles, the distinct shingles' 64-bit hashes as signed longs in order of their unsigned values."""
    return text_pass(docs, keep, "text", [("shingles", "array<long>")], lambda: lambda texts: [[_hash_set(t, shingle).view(np.int64) for t in texts]])


def _signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each band of a set, of the band and the set's least hashes under ROWS mixings, and the set's sketch."""
    least, high = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(high), MIXED):
        np.minimum(least, (high[a : a + MIXED, None] * _MIX).min(axis=0), out=least)
    bands, wide = np.arange(1, BANDS + 1, dtype=np.uint64), least.astype(np.uint64)
    for row in wide.reshape(BANDS, ROWS).T:
        bands = (bands ^ row) * np.uint64(0x9E3779B97F4A7C15)
        bands ^= bands >> np.uint64(29)
    # the low bits of a product are those of few bits of its factors: the high byte of another product
    high = wide[:SKETCHED] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
    return bands, np.bitwise_or.reduce(high.reshape(-1, 8) << np.arange(0, 64, 8, dtype=np.uint64), axis=1)


def nodes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, node (the hash of a text's shingle set, equal for equal sets), fp (the set's SimHash), bands and sketch of that set."""

    def told(text):
        h = _hash_set(text, WORDS)
        node = xxhash.xxh64_intdigest(h.tobytes(), SEED)
        ones = sum((_ones(h[a : a + COUNTED]) for a in range(0, len(h), COUNTED)), np.zeros(64, np.int64))
        fp = sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(h)))
        return node - (node >> 63 << 64), fp - (fp >> 63 << 64), *(x.view(np.int64) for x in _signature(h))

    made = [("node", "long"), ("fp", "long"), ("bands", "array<long>"), ("sketch", "array<long>")]
    return text_pass(docs, keep, "text", made, lambda: lambda texts: list(zip(*map(told, texts))) or [[]] * 4)


def proposed(first: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of first (node, fp) by links(): those of one fingerprint with its least node, and the least nodes of linked ones."""
    least = stored(first.groupBy("fp").agg(F.min("node").alias("h")), "least")
    equal = first.join(least, "fp").where("h <> node").select("h", "node")
    side = lambda k: least.select(F.col("fp").alias(k), F.col("h").alias(f"{k}h"))
    near = links(least.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.col("ah").alias("h"), F.col("bh").alias("node"))
    return equal.unionByName(near).select(F.least("h", "node").alias("a"), F.greatest("h", "node").alias("b"))


def tallied(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of first (node, sketch) whose sketches share SHARED positional bytes at least."""
    side = lambda k: first.select(F.col("node").alias(k), F.col("sketch").alias(f"{k}k"))

    def differing(i: int) -> Column:
        x = F.col("ak")[i].bitwiseXOR(F.col("bk")[i])
        for k in (4, 2, 1):  # the lowest bit of each byte that is not zero
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(sum((differing(i) for i in range(SKETCHED // 8)), F.lit(0)) <= SKETCHED - SHARED).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ALIKE at least; sets has node and shingles."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}s"), F.size("shingles").alias(f"{k}n"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common, total = F.size(F.array_intersect("as", "bs")), F.col("an") + F.col("bn")
    up, down = ALIKE
    # |A and B| / (|A| + |B| - |A and B|) >= up / down, in whole numbers; sizes alone decide most of the unlike
    fits = F.least("an", "bn") * down >= F.greatest("an", "bn") * up
    return both.where(F.when(fits, common * (up + down) >= total * up).otherwise(False)).select("a", "b")


def _held_sets(own: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and shingles of the nodes in pairs, read again from the text of each node's first row (own: id, row, text)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    at = first.join(wanted, "node").select("node", F.col("first.id").alias("other"), F.col("first.row").alias("row"))
    texts = own.select("id", "row", "text").join(at, "row").where(F.col("id").eqNullSafe(F.col("other"))).select("node", "text")
    return stored(shingle_sets(texts, ["node"]).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def linked(own: DataFrame, first: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of first (node, bands, sketch, first): enough to give the components of the similar nodes that share bands.

    Nodes that share a band are in its list.  All pairs of a list of up to PAIRED members that share enough positional bytes are held against
    their sets.  Members of a longer one are held against its central members, those whose lists are the longest, as the text is that
    others are copies of: against one after another, as long as more than one component is left in the list.  Where that leaves more
    than one, its members that are in another such list too are held against all of their cluster, however many they are; see _across().  Two similar nodes are passed over only where they share no band, or a single one of a
    long list: at 0.8 with a chance of about 1 in 600, whatever the size of the table, and less above.
    """
    posts = first.select("node", F.explode("bands").alias("key"))
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # stored: joins of plain shuffles can be split where a list is very long
    met = stored(posts.join(sizes, "key"), "lists")
    few, many = met.where(F.col("n") <= PAIRED), met.where(F.col("n") > PAIRED)
    if not many.isEmpty():
        many = stored(many.join(many.groupBy("node").agg(F.sum("n").alias("c")), "node").select("key", "node", F.struct("c", "node").alias("m")), "long")
    else:
        many = many.select("key", "node", F.struct(F.lit(0).cast("long").alias("c"), "node").alias("m"))
    pair = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    hubs = many.groupBy("key").agg(F.max("m").alias("hub"))
    star = _stars(many, hubs)
    found = tallied(pair.unionByName(star).distinct(), first)
    if "fp" in first.columns:
        found = found.unionByName(proposed(first)).distinct()
    found = stored(found, "pairs")
    sets = _held_sets(own, first, found)
    near = stored(verified(found, sets), "near")
    held = stored(many.groupBy("node").agg(F.collect_list(F.struct("key", "m")).alias("ms")), "held")
    for left_ in reversed(range(CENTRES)):
        # a row for each node, not for each of its lists
        rooted = held.join(components(near), "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("ms").alias("l")).select("node", "root", "l.key", "l.m")
        # a list needs another centre only where members of other components are left, and so do these only
        mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        rooted = stored(rooted.join(mixed, "key"), "rooted")
        if not left_ or rooted.isEmpty():
            break
        last = hubs.join(mixed, "key")
        hubs = stored(rooted.join(last, "key").where("m < hub").groupBy("key").agg(F.max("m").alias("hub")), "hubs")
        fresh = _stars(rooted, hubs, True).join(found, ["a", "b"], "left_anti").distinct()
        found_, more = found, stored(tallied(fresh, first), "pairs")
        found = found_.unionByName(more)
        sets = sets.unionByName(_held_sets(own, first, more).join(sets.select("node"), "node", "left_anti"))
        near = stored(near.unionByName(verified(more, sets)), "near")
    left = stored(rooted.groupBy("node", "root").agg(F.sort_array(F.collect_list("key")).alias("keys")).where(F.size("keys") > 1), "left")
    if left.isEmpty():
        return near
    sets = sets.unionByName(_held_sets(own, first, left.select(F.col("node").alias("a"), F.col("node").alias("b"))).join(sets.select("node"), "node", "left_anti"))
    return near.unionByName(_across(left, sets))


def _across(left: DataFrame, sets: DataFrame) -> DataFrame:
    """One link (a, b) for each two components of left (node, root, keys) in a block that have similar nodes, by the exact sets.

    Nodes that are joined by lists are a cluster; all of a cluster are held against each other, a block of them against a block at a
    time, over the shingles that nodes of other components have too.  The work for a cluster of unlike members grows with its
    square, what is written does not: each set once for each of its cluster's blocks, and the links.
    """
    own = left.select("node", "root").join(sets, "node")
    each = stored(own.select("node", "root", F.explode("shingles").alias("g")), "shingles")
    common = each.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("g")
    known = each.join(common, "g").groupBy("node").agg(F.collect_list("g").alias("gs"))
    up, down = ALIKE
    # a set shares at least this part of itself with any similar one
    able = own.select("node", "root", F.size("shingles").alias("n")).join(known, "node").where(F.size("gs") * down >= F.col("n") * up)
    posts = left.select("node", F.explode("keys").alias("key"))
    meets = posts.join(posts.groupBy("key").agg(F.min("node").alias("h")), "key").select(F.col("h").alias("a"), F.col("node").alias("b")).distinct()
    able = stored(able.join(components(meets).withColumnRenamed("root", "cluster"), "node"), "able")
    n = able.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = able.join(n, "cluster").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def side(k: str, q, x) -> DataFrame:
        made = dealt.select("cluster", "node", "root", "n", "gs", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        return made.where("at <= other" if k == "q" else "other <= at").select(*[F.col(c).alias(f"{k}_{c}") for c in ("node", "root", "n", "gs", "cluster")], F.col(q).alias(f"{k}_q"), F.col(x).alias(f"{k}_x"))

    on = lambda k: [f"{k}_cluster", f"{k}_q", f"{k}_x"]
    pairs = side("q", "at", "other").groupBy(*on("q")).cogroup(side("x", "other", "at").groupBy(*on("x")))
    return stored(pairs.applyInArrow(_similar, "a long, b long"), "across")


def _similar(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links (a, b) of two blocks of sets (node, root, n, gs), one for each two roots with a pair of ALIKE at least."""
    (qn, qr, qs), (xn, xr, xs) = ([t.column(f"{k}_{c}").to_numpy() for c in ("node", "root", "n")] for k, t in (("q", left), ("x", right)))
    made = {"a": [], "b": []}
    if len(qn) and len(xn):
        (qg, qi), (xg, xi) = ((pc.list_flatten(t.column(f"{k}_gs")).to_numpy(), pc.list_parent_indices(t.column(f"{k}_gs")).to_numpy()) for k, t in (("q", left), ("x", right)))
        both = np.intersect1d(qg, xg)
        held = []
        for g, i in ((qg, qi), (xg, xi)):
            at = np.searchsorted(both, g)
            kept = both[np.minimum(at, len(both) - 1)] == g if len(both) else np.zeros(len(g), bool)
            at, i = at[kept], i[kept]
            by = np.argsort(at, kind="stable")
            held.append((i[by], np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(both)))))))
        (qi, qe), (xi, xe) = held
        counts = np.zeros((len(qn), len(xn)), np.float32)
        wide = np.flatnonzero(np.diff(qe) * np.diff(xe) > 4096)
        for g in np.setdiff1d(np.arange(len(both)), wide).tolist():
            counts[np.ix_(qi[qe[g] : qe[g + 1]], xi[xe[g] : xe[g + 1]])] += 1
        # shingles of many sets by matrix products, some at a time
        for a in range(0, len(wide), 1024):
            part = wide[a : a + 1024].tolist()
            one, two = np.zeros((len(qn), len(part)), np.float32), np.zeros((len(xn), len(part)), np.float32)
            for c, g in enumerate(part):
                one[qi[qe[g] : qe[g + 1]], c] = 1
                two[xi[xe[g] : xe[g + 1]], c] = 1
            counts += one @ two.T
        up, down = ALIKE
        seen = set()
        for i in range(len(qn)):
            for j in np.flatnonzero((counts[i] * (up + down) >= (qs[i] + xs) * up) & (xr != qr[i])).tolist():
                roots = (min(qr[i], xr[j]), max(qr[i], xr[j]))
                if roots not in seen:
                    seen.add(roots)
                    made["a"].append(min(qn[i], xn[j]))
                    made["b"].append(max(qn[i], xn[j]))
    return pa.table({k: pa.array(v, pa.int64()) for k, v in made.items()})


def _stars(members: DataFrame, hubs: DataFrame, apart: bool = False) -> DataFrame:
    """The distinct pairs (a, b) of each list's hub and its other members; apart: only those of other components (root) than the hub's."""
    hub = hubs.select("key", F.col("hub.node").alias("h"))
    met = members.join(hub, "key")
    if apart:
        own = members.select("key", F.col("node").alias("h"), F.col("root").alias("hr"))
        met = met.join(own, ["key", "h"]).where("root <> hr")
    return met.where("h <> node").select(F.least("h", "node").alias("a"), F.greatest("h", "node").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of similar texts (of one set of five-word shingles, or linked by pairs with a Jaccard
    similarity of 0.8 at least): that of the smallest doc_id (null ones last), then of the smallest row hash.

    Bands only propose pairs; each is held against its shingle sets before it links anything.
    A text without five words has the set of its whole sequence, one without words the empty set; null counts as empty.
    Repeated rows leave one; an empty table stays empty; no column's name clashes.
    """
    cells = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.struct(*cells).alias("rest"), F.col("doc_id").alias("id"), F.col("text"), F.xxhash64(*cells).alias("row"))
    spark = docs.sparkSession
    path = new_path(spark, "kept")
    with scratch(spark):
        rows = stored(nodes(own, ["id", "row"]), "nodes")
        order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))
        first = stored(rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"), F.min(order).alias("first")), "first")
        rooted = first.select("node", "first").join(components(linked(own, first)), "node", "left").withColumn("root", F.coalesce("root", "node"))
        kept = stored(rooted.groupBy("root").agg(F.min("first").alias("k")).select(F.col("k.id").alias("other"), F.col("k.row").alias("row")).distinct(), "kept", path)
        ties = rows.groupBy("id", "row").count().where("count > 1").limit(1).count()
    out = own.join(kept, "row").where(F.col("id").eqNullSafe(F.col("other")))
    return (out.dropDuplicates(["row", "id"]) if ties else out).select("rest.*")
