"""Removal of byte strings that occur more than once in a corpus, by suffix arrays over shards.

A shard holds every window (string of `length` bytes) that can equal one of its own.  To deal windows out
so, each is filed under a key that depends on its bytes alone.  Its anchor is the gram of GRAM bytes in it with
the smallest hash; half of the bytes beside the anchor, or more, stand on one side of it, and the key is the hash of the anchor with
that half.  Neighbouring windows with one key form a segment, kept as one string.  Keys that occur once need no more work.

Whether windows repeat is what suffix arrays (induced sorting, permuted common prefixes) say, each over a shard:
* Equal segments are found by their hashes.  Two of each, from different places, go into a shard, joined to runs where their
  neighbours do so too.  The verdict on the two holds for all of them.
* Segments that share a key but differ may share windows.  All distinct ones of a key go into one shard, once each.
* A key of more than LARGE distinct segments is split: its windows are filed again under longer keys, each with half of
  the bytes that the shorter one leaves out, until the segments of a key fit a shard; equal ones are put
  together first.  A key of `length` bytes is a window itself and has one segment.

Texts meet their lists by a 64-bit hash and a further 12 bits in every entry.  Lists are made once for each
distinct text, however many copies it has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinlink.llm.common import bounded_batches, delete, new_path, scratch, steps, stored, text_pass
from kinlink.llm.suffixes import repeated

LENGTH = 200
GRAM = 32
#: Distinct segments of one key in a shard; beyond that the key is split.
LARGE = 256
#: Bytes of a shard's text, beyond which a new one begins (a key's segments stay together).
SHARD_BYTES = 1 << 20
#: Bytes of text that are hashed at a time.
PIECE = 1 << 16
#: Equal segments are joined to runs inside stretches of 2 to this power bytes.
STRETCH = 16

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """A 64-bit hash of the bytes at each place, for each size (rising powers of two, 8 at least), by doubling from eight."""
    h = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view("<u8").ravel()
    h, size, out = _mix(h * _M1), 8, []
    for wanted in sizes:
        while size < wanted:
            h = _mix(h[:-size] * _M1 + h[size:] * _M3)
            size *= 2
        out.append(h)
    return out


def sides(length: int = LENGTH, gram: int = GRAM) -> tuple[int, int]:
    """Bytes of the key before the anchor for windows that have as many there, and behind it for all others."""
    rest = length - gram
    half = -(-rest // 2)
    return half, rest - half + 1


def segments(raws: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Yields, buffer by buffer, the segments of texts: (buffer, text, begin in the buffer, begin in the text, windows, key, key's offset, side, hash).

    Texts are joined to buffers of about PIECE bytes, and longer texts cut into pieces that overlap by a window less a
    byte.  The smallest hash of each stretch of places is found from running minima in both directions
    over blocks of the stretch's size; of equal hashes the leftmost counts.
    """
    held, size = [], 0
    for text, raw in enumerate(raws):
        for base in range(0, len(raw) - length + 1, PIECE):
            part = raw[base : base + PIECE + length - 1]
            held.append((text, base, part))
            size += len(part)
            if size >= PIECE:
                yield _cut(held, length, gram)
                held, size = [], 0
    if held:
        yield _cut(held, length, gram)


def _cut(parts: list[tuple[int, int, bytes]], length: int, gram: int):
    span = length - gram + 1
    buffer = b"".join([p[2] for p in parts])
    h = gram_hashes(np.frombuffer(buffer, np.uint8), gram)[0]
    # hashes of twice and four times as many bytes, as gram_hashes() makes them, only where they are asked for
    wide = lambda at: _mix(h[at] * _M1 + h[at + gram] * _M3)
    wider = lambda at: _mix(wide(at) * _M1 + wide(at + 2 * gram) * _M3)
    n = len(h)
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n]) & np.uint64(0xFFFFFFFF)
    # windows that lie inside one part
    counts = np.array([len(p[2]) - length + 1 for p in parts])
    begins = np.cumsum(counts + length - 1) - (counts + length - 1)
    owner = np.repeat(np.arange(len(parts)), counts)
    at = np.arange(len(owner)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    anchor = least[at].astype(np.int64)
    before, after = sides(length, gram)
    # windows of one anchor with `before` bytes ahead of it come first
    side = anchor - at < before
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (side[1:] != side[:-1]))))
    own, begin, anchor, side = owner[first], at[first], anchor[first], side[first]
    windows = np.diff(np.append(first, len(owner)))
    place = anchor - np.where(side, 0, before)
    last = anchor + gram + np.where(side, after, 0) - 2 * gram
    key = _mix(wide(place) * _M1 + wide(last) * _M3 + side)
    end = begin + windows + length - 1
    seg = _mix(wider(begin) * _M1 + wider((begin + end) // 2 - 2 * gram) * _M3 + wider(end - 4 * gram) * _M2 + windows.astype(np.uint64))
    texts, bases = (np.array([p[i] for p in parts])[own] for i in (0, 1))
    return buffer, texts, begin, begin - begins[own] + bases, windows, key.view(np.int64), place - begin, side, seg.view(np.int64)


def text_key(raw: bytes) -> tuple[int, int]:
    """A signed 64-bit key of a text, and 12 further bits."""
    h = xxhash.xxh3_128_intdigest(raw)
    return (h & (1 << 64) - 1) - ((h >> 63 & 1) << 64), h >> 64 & 0xFFF


def _pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray, side: np.ndarray, check: np.ndarray) -> np.ndarray:
    return ((((start << 8 | (windows - 1)) << 7 | offset) << 1 | side) << 12) | check


def _unpack(at: np.ndarray, check: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which entries are of the text with these 12 bits, and their starts, windows, keys' offsets and sides."""
    return (at & 0xFFF) == check, at >> 28, (at >> 20 & 0xFF) + 1, at >> 13 & 0x7F, at >> 12 & 1


#: Bits of a packed place behind the start.
_PLACE = 28


def occurrences(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, seg (hash of the segment's bytes), tk (the text's key) and at (the packed place) of every segment."""
    bounded_batches(docs.sparkSession)
    kinds = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("tk", pa.int64()), ("at", pa.int64())])

    def work(batches):
        for batch in batches:
            for a, b in steps(batch.column(0)):
                raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(0).slice(a, b - a)]
                keyed = [text_key(r) if len(r) >= length else (0, 0) for r in raws]
                keys, checks = np.array([k for k, _ in keyed], np.int64), np.array([c for _, c in keyed], np.int64)
                for _, text, _, start, windows, key, offset, side, seg in segments(raws, length):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, seg, keys[text], _pack(start, windows, offset, side, checks[text]))], schema=kinds)

    return docs.select(F.col("text").cast("string")).mapInArrow(work, "key long, seg long, tk long, at long")


def _packed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """k0, k1, ... (keep), tk and z: the text's key, and the text itself for a shuffle."""

    def begin():
        shrink = zstandard.ZstdCompressor(level=3).compress

        def apply(texts):
            raw = [(t or "").encode() for t in texts]
            return [[text_key(r)[0] for r in raw], [shrink(r) for r in raw]]

        return apply

    own = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], "text")
    return text_pass(own, own.columns[:-1], "text", [("tk", "long"), ("z", "binary")], begin)


#: Whole segments that share a key, or (with `whole`) runs of equal ones from one of two places: grp deals them to shards, and parts
#: are the segments whose windows begin in the string at `first`, in the first of the two places only.
_STRINGS = "grp long, whole boolean, s binary, o int, k int, parts array<struct<key:long,seg:long,first:int,windows:int>>"


def _strings(packed: DataFrame, wanted: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """The strings of the wanted places (tk, at, grp, role, key, seg); role 0: a segment, 1 and 2: of equal ones the first and second place."""
    # stored: a join of two plain shuffles can be split where a text has very many copies
    lists = stored(wanted.groupBy("tk").agg(F.collect_list(F.struct("at", "grp", "role", "key", "seg")).alias("l")), "wanted")
    kinds = to_arrow_schema(T._parse_datatype_string(_STRINGS))
    before, after = sides(length, gram)

    def work(batches):
        grow, seen = zstandard.ZstdDecompressor().decompress, set()
        for batch in batches:
            for tk, z, entries in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if tk in seen:  # a copy
                    continue
                raw = grow(z.as_buffer())
                rows = entries.values
                mine, start, windows, offset, side = _unpack(rows.field(0).to_numpy(), text_key(raw)[1])
                if not mine.any():
                    continue
                seen.add(tk)
                grp, role, key, seg = (rows.field(i).to_numpy()[mine] for i in (1, 2, 3, 4))
                start, windows, offset, side = start[mine], windows[mine], offset[mine], side[mine]
                order = np.lexsort((start, grp, role))
                out = []
                for r, g, a, w, q, d, y, h in zip(*(c[order].tolist() for c in (role, grp, start, windows, offset, side, key, seg))):
                    if r and out and out[-1][0] == (r, g) and a <= out[-1][2]:
                        last = out[-1]
                        last[2] = max(last[2], a + w)
                    else:
                        out.append(last := [(r, g), a, a + w, q, gram + (after if d else before), []])
                    if r < 2:
                        last[5].append({"key": y, "seg": h, "first": a - last[1], "windows": w})
                columns = [[x[0][1] for x in out], [x[0][0] > 0 for x in out], [raw[x[1] : x[2] + length - 1] for x in out], [x[3] for x in out], [x[4] for x in out], [x[5] for x in out]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return packed.select("tk", "z").join(lists, "tk").select("tk", "z", "l").mapInArrow(work, _STRINGS)


def _runs(marks: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate(([0], marks.view(np.int8), [0])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


#: A verdict on a segment (runs of repeated windows, null for all of them), or, where s is not null, a piece of one whose
#: windows begin there at `first`, filed again under grp.
_VERDICT = "key long, seg long, runs array<struct<a:int,b:int>>, grp long, hash binary, first int, s binary, o int, k int"


def _refiled(s: bytes, o: int, k: int, length: int) -> list[tuple[int, int, bytes, int, int]]:
    """A segment's windows under longer keys: for each side that has any (grp, first window, string, key's offset, key's bytes).

    Windows with half of the bytes that the key s[o : o + k] leaves out before it take those into the key, the others the rest behind it.
    """
    rest = length - k
    half = -(-rest // 2)
    windows = len(s) - length + 1
    cut = min(max(o - half + 1, 0), windows)
    out = []
    for first, stop, a, b in ((0, cut, o - half, o + k), (cut, windows, o, o + k + rest - half + 1)):
        if stop > first:
            h = xxhash.xxh3_64_intdigest(s[a:b], seed=2 * k + (first > 0 or cut == 0))
            out.append((h - (h >> 63 << 64), first, s[first : stop + length - 1], a - first, b - a))
    return out


def _solved(strings: DataFrame, length: int, large: int) -> DataFrame:
    """The verdicts of shards (see _VERDICT) on strings (see _STRINGS)."""
    kinds = to_arrow_schema(T._parse_datatype_string(_VERDICT))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    def solve(shard: list[tuple]) -> list[tuple]:
        out = []
        for (_, parts), marks in zip(shard, repeated([s for s, _ in shard], length)):
            for key, seg, first, windows in parts:
                own = marks[first : first + windows]
                if own.any():
                    out.append((key, seg, None if own.all() else _runs(own), *[None] * 6))
        return out

    def refiled(rows: list[tuple]) -> list[tuple]:
        return [
            (key, seg, None, grp, hashlib.blake2b(part, digest_size=16).digest(), first, part, at, size)
            for s, o, k, parts in rows
            for key, seg, _, _ in parts
            for grp, first, part, at, size in _refiled(s, o, k, length)
        ]

    def work(batches):
        shard, held, now, rows, crowded = [], 0, None, [], False
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for grp, whole, s, o, k, parts in zip(*columns, batch.column(5).to_pylist()):
                if (grp, whole) != now:
                    if len(rows) > 1 and not crowded:
                        shard += [(x[0], x[3]) for x in rows]
                        held += sum(len(x[0]) for x in rows)
                        if held >= SHARD_BYTES:
                            if out := solve(shard):
                                yield made(out)
                            shard, held = [], 0
                    now, rows, crowded = (grp, whole), [], False
                rows.append((s, o, k, [tuple(p.values()) for p in parts]))
                if not whole and k < length and (crowded or len(rows) > large):
                    crowded = True
                    if out := refiled(rows):
                        yield made(out)
                    rows = []
        if len(rows) > 1 and not crowded:
            shard += [(x[0], x[3]) for x in rows]
        if shard and (out := solve(shard)):
            yield made(out)

    return strings.repartition("grp", "whole").sortWithinPartitions("grp", "whole").mapInArrow(work, _VERDICT)


def verdicts(strings: DataFrame, length: int, large: int = LARGE) -> DataFrame:
    """key, seg and runs (null: all windows) of the segments in strings with repeated windows, keys of many segments split as often as it takes."""
    found = stored(_solved(strings, length, large), "verdicts")
    judged, pieces = found.where("s is null").select("key", "seg", "runs"), found.where("s is not null")
    if pieces.isEmpty():
        return judged
    # equal pieces are one, of two copies, whatever their number: shared ones are told by their hash
    one = pieces.groupBy("grp", "hash").agg(F.count(F.lit(1)).alias("n"), *[f(F.struct("key", "seg", "first", "s", "o", "k")).alias(a) for a, f in (("lo", F.min), ("hi", F.max))])
    shared = pieces.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("grp")
    one = stored(one.join(shared, "grp"), "pieces")
    number = F.xxhash64("hash")
    part = F.array(F.struct(F.col("grp").alias("key"), number.alias("seg"), F.lit(0).alias("first"), (F.octet_length("lo.s") - (length - 1)).alias("windows")))
    none = part.cast("array<struct<key:long,seg:long,first:int,windows:int>>")
    row = lambda df, grp, whole, side, parts: df.select(grp.alias("grp"), F.lit(whole).alias("whole"), F.col(f"{side}.s").alias("s"), F.col(f"{side}.o").alias("o"), F.col(f"{side}.k").alias("k"), parts.alias("parts"))
    equal, pair = one.where("n > 1"), F.xxhash64("grp", "hash")
    again = row(one, F.col("grp"), False, "lo", none).unionByName(row(equal, pair, True, "lo", none)).unionByName(row(equal, pair, True, "hi", F.slice(none, 1, 0)))
    deeper = verdicts(again, length, large).select(F.col("key").alias("grp"), F.col("seg").alias("number"), F.col("runs").alias("inner"))
    # stored: skewed joins can be split
    back = pieces.select("grp", number.alias("number"), "key", "seg", "first", (F.octet_length("s") - (length - 1)).alias("windows")).join(stored(deeper.distinct(), "deeper"), ["grp", "number"])
    shifted = F.transform(F.coalesce("inner", F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))), lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b")))
    return judged.unionByName(back.select("key", "seg", shifted.alias("runs")))


def covers(docs: DataFrame, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """tk and l: for each text with repeated windows the packed places of its segments and their runs (null: all windows)."""
    path = new_path(docs.sparkSession, "covers")
    with scratch(docs.sparkSession):
        # stored: texts are cut once, for the count and for the places
        cut = new_path(docs.sparkSession, "occurrences")
        found = stored(occurrences(docs, length), "occurrences", cut)
        shared = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
        # each place of a text once, however many copies the text has
        places = found.join(shared, "key").repartition("key", "seg", "tk", "at").groupBy("key", "seg", "tk", "at").agg(F.count(F.lit(1)).alias("m"))
        places = stored(places, "places")
        delete(docs.sparkSession, cut)
        place = F.struct("tk", "at", "m")
        each = stored(places.groupBy("key", "seg").agg(F.sum("m").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi")), "each")
        mixed = each.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select("key")
        equal = each.where("n > 1")
        pair = F.xxhash64("lo.tk", F.shiftright("lo.at", _PLACE + STRETCH), "hi.tk", F.lit(1))
        ask = lambda df, side, grp, role: df.select(f"{side}.tk", f"{side}.at", grp.alias("grp"), F.lit(role).alias("role"), "key", "seg")
        wanted = ask(each.join(mixed, "key"), "lo", F.col("key"), 0).unionByName(ask(equal, "lo", pair, 1)).unionByName(ask(equal, "hi", pair, 2))
        judged = verdicts(_strings(_packed(docs, []), wanted, length), length, large)
        return stored(places.join(judged, ["key", "seg"]).groupBy("tk").agg(F.collect_set(F.struct("at", "runs")).alias("l")), "covers", path)


def removed(raw: bytes, entries, length: int = LENGTH) -> np.ndarray:
    """Which bytes of a text its list of covers removes."""
    depth = np.zeros(len(raw) + 1, np.int64)
    if entries is not None and len(entries):
        at = entries.field(0).to_numpy()
        mine, start, windows, _, _ = _unpack(at, text_key(raw)[1])
        runs = entries.field(1)
        whole = runs.is_null().to_numpy(zero_copy_only=False)
        all_ = mine & whole
        np.add.at(depth, start[all_], 1)
        np.add.at(depth, (start + windows + length - 1)[all_], -1)
        if (some := mine & ~whole).any():
            n = np.diff(runs.offsets.to_numpy())
            flat, base = runs.flatten(), np.repeat(start, n)[np.repeat(some, n)]
            keep = np.repeat(some, n)
            np.add.at(depth, base + flat.field(0).to_numpy()[keep], 1)
            np.add.at(depth, base + flat.field(1).to_numpy()[keep] + length - 1, -1)
    return np.cumsum(depth[:-1]) > 0


def _covered(docs: DataFrame, keep: list[str], made: list[tuple[str, str]], each, length: int) -> DataFrame:
    """keep, and what each(raw bytes, removed bytes) gives, for every row of docs."""
    kept = [f"k{i}" for i in range(len(keep))]
    packed = _packed(docs, keep)
    joined = packed.join(covers(docs, length), "tk", "left").select(*kept, "z", "l")
    out = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in made])
    kinds = to_arrow_schema(out)

    def work(batches):
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for z, entries in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
                raw = grow(z.as_buffer())
                rows.append(each(raw, removed(raw, entries.values if entries.is_valid else None, length)))
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(kinds[i].type) for i in range(len(keep))] + [pa.array([r[i] for r in rows], kinds[len(keep) + i].type) for i in range(len(made))], schema=kinds)

    return joined.mapInArrow(work, out)


def digests(docs: DataFrame, keep: list[str], length: int = LENGTH) -> DataFrame:
    """keep, n_bytes, n_removed, n_spans and kept_sha256 of every document.  Null: the empty text.  Texts below `length` bytes lose nothing."""

    def each(raw, gone):
        spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).view(np.int8)) == 1))
        return len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()

    return _covered(docs, keep, [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")], each, length)


def cleaned(docs: DataFrame, keep: list[str], text: str = "clean", length: int = LENGTH) -> DataFrame:
    """keep, the text without its repeated bytes (characters cut by a removal stay whole), and spans (start and end in bytes)."""

    def each(raw, gone):
        if not gone.any():
            return raw.decode(), []
        data = np.frombuffer(raw, np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        whole = np.bincount(char, ~gone) == 0
        out = data[~whole[char]].tobytes().decode()
        edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        return out, [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]

    return _covered(docs, keep, [(text, "string"), ("spans", "array<struct<start:long,end:long>>")], each, length)
