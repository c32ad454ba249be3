"""Media columns as ISO base media files.

A payload is stored as a track of uncompressed 8-bit grey frames of 24 x 24 pixels, 576 bytes a sample.
Reading walks the nested boxes, decodes the sample tables (stsd, stts, stsc, stsz, stco or co64, stss) and those of
movie fragments (trex, tfhd, trun), and gives codec, duration and the byte ranges of samples and keyframes; sample
payloads are never decoded, only located.  Every count is held against the bytes there are before anything is allocated for it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import stored, text_pass

SIDE = 24
SAMPLE = SIDE * SIDE
TIMESCALE = 25
#: Frames in a chunk; the first of each chunk is marked as a sync sample.
CHUNK = 16
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}


class MediaError(ValueError):
    """The bytes are no readable container."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 0xFFFFFFF8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 appended up to a positive multiple of the sample size."""
    return raw + b"\xff" * (max(SAMPLE, -(-len(raw) // SAMPLE) * SAMPLE) - len(raw))


def store(raw: bytes) -> bytes:
    """The container of a payload: ftyp, moov with one track, mdat."""
    data = padded(raw)
    n = len(data) // SAMPLE
    chunks = -(-n // CHUNK)
    unit = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIIIHHIIIH", 1, 0, 0, 0, 0, 0, SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1), (chunks, last, 1)] if chunks > 1 and last != CHUNK else [(1, min(n, CHUNK), 1)]
    wide = len(data) + 4096 + 12 * chunks > 0xFFFFFFFF

    def moov(at: int) -> bytes:
        places = at + np.arange(chunks, dtype=np.int64) * (SAMPLE * CHUNK)
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
            _full(b"stss", struct.pack(">I", chunks), (1 + np.arange(chunks, dtype=np.int64) * CHUNK).astype(">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIIIIIHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0, 0, 0), unit, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), unit, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    head = len(ftyp) + len(moov(0)) + (16 if len(data) >= 0xFFFFFFF8 else 8)
    return ftyp + moov(head) + _box(b"mdat", data)


def walk(media, start: int = 0, stop: int | None = None, path: tuple[bytes, ...] = ()):
    """Yields (path, first payload byte, end) of every box, containers before what they hold."""
    stop = len(media) if stop is None else stop
    while start < stop:
        if stop - start < 8:
            raise MediaError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", media, start)
        head = 8
        if size == 1:
            if stop - start < 16:
                raise MediaError("a long box header is cut off")
            (size,) = struct.unpack_from(">Q", media, start + 8)
            head = 16
        elif size == 0:
            size = stop - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > stop:
            raise MediaError(f"box {kind!r} leaves its container")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS and len(here) < 12:
            yield from walk(media, start + head, start + size, here)
        start += size


def _table(media, at: int, end: int, width: str, columns: int = 1, skip: int = 4) -> np.ndarray:
    (n,) = struct.unpack_from(">I", media, at + skip)
    kind = np.dtype(width)
    if at + skip + 4 + n * columns * kind.itemsize > end:
        raise MediaError("a sample table is cut off")
    return np.frombuffer(media, kind, n * columns, at + skip + 4).astype(np.int64).reshape(n, columns)


def _boxes(media, start: int, end: int) -> dict[bytes, tuple[int, int]]:
    """The first box of each kind below a container."""
    found: dict[bytes, tuple[int, int]] = {}
    for path, a, b in walk(media, start, end):
        found.setdefault(path[-1], (a, b))
    return found


class Track:
    """Codec, timing and byte ranges of one track: the given one, or of a container's tracks the first video one with
    samples, else the first with samples, else the first."""

    def __init__(self, media: bytes, boxes: dict[bytes, tuple[int, int]] | None = None, fragments: list | None = None):
        if boxes is None:
            found = tracks(media)
            if not found:
                raise MediaError("no track")
            best = min(range(len(found)), key=lambda i: (not len(found[i].sizes), found[i].handler != b"vide", i))
            self.__dict__ = found[best].__dict__
            return
        try:
            self._read(media, boxes)
            self._append(media, boxes, fragments or [])
        except (KeyError, struct.error, IndexError) as error:
            raise MediaError(f"no readable sample tables: {error}") from error
        if len(self.sizes) and (self.starts + self.sizes).max() > len(media):
            raise MediaError("samples lie behind the end")

    def _read(self, media, found) -> None:
        a, _ = found[b"mdhd"]
        self.timescale, self.duration = struct.unpack_from(">IQ", media, a + 20) if media[a] == 1 else struct.unpack_from(">II", media, a + 12)
        a, b = found.get(b"hdlr", (0, 0))
        self.handler = bytes(media[a + 8 : a + 12]) if b - a >= 12 else b""
        a, b = found[b"stsd"]
        if b - a < 16:
            raise MediaError("no sample description")
        self.codec = bytes(media[a + 12 : a + 16]).decode("latin-1")
        a, b = found[b"stsz"]
        one, n = struct.unpack_from(">II", media, a + 4)
        if one and n * one > len(media):
            raise MediaError("samples lie behind the end")
        sizes = np.full(n, one, np.int64) if one else _table(media, a, b, ">u4", skip=8).ravel()
        places = (_table(media, *found[b"co64"], ">u8") if b"co64" in found else _table(media, *found[b"stco"], ">u4")).ravel()
        runs = _table(media, *found[b"stsc"], ">u4", 3)
        times = _table(media, *found[b"stts"], ">u4", 2)
        self.keys = _table(media, *found[b"stss"], ">u4").ravel() - 1 if b"stss" in found else np.arange(n)
        if ((places < 0) | (places > len(media))).any():
            raise MediaError("chunks lie behind the end")
        chunks = np.diff(np.append(runs[:, 0] - 1, len(places))) if len(runs) else np.zeros(0, np.int64)
        if (len(runs) and runs[0, 0] != 1) or (chunks < 0).any() or (runs[:, 1] > n).any() or (times[:, 0] > n).any():
            raise MediaError("the sample tables disagree")
        if (chunks * runs[:, 1]).sum() != n or times[:, 0].sum() != n or chunks.sum() != len(places) or ((self.keys < 0) | (self.keys >= n)).any():
            raise MediaError("the sample tables disagree")
        in_chunk = np.repeat(runs[:, 1], chunks)
        before = np.concatenate(([0], np.cumsum(sizes)))
        first = np.concatenate(([0], np.cumsum(in_chunk)))[:-1]
        self.chunks = np.stack([places, before[first + in_chunk] - before[first]], axis=1) if n else np.zeros((0, 2), np.int64)
        self.starts = np.repeat(places, in_chunk) + before[:-1] - np.repeat(before[first], in_chunk) if n else np.zeros(0, np.int64)
        self.sizes = sizes

    def _append(self, media, boxes, fragments) -> None:
        """Adds the samples of movie fragments: (track's number, defaults, data's base, tfhd and its truns)."""
        a, _ = boxes.get(b"tkhd", (0, 0))
        own = struct.unpack_from(">I", media, a + (20 if media[a] == 1 else 12))[0] if a else 0
        for number, (duration, size, flags), base, runs in fragments:
            if number != own:
                continue
            at = base
            for start, end in runs:
                given = int.from_bytes(media[start + 1 : start + 4], "big")
                (n,) = struct.unpack_from(">I", media, start + 4)
                place, first = start + 8, None
                if given & 1:
                    at, place = base + struct.unpack_from(">i", media, place)[0], place + 4
                if given & 4:
                    (first,), place = struct.unpack_from(">I", media, place), place + 4
                columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if given & bit]
                if n > len(media) or place + 4 * n * len(columns) > end or at < 0:
                    raise MediaError("a fragment's table is cut off")
                table = np.frombuffer(media, ">u4", n * len(columns), place).astype(np.int64).reshape(n, len(columns))
                told = {bit: table[:, i] for i, bit in enumerate(columns)}
                sizes, marks = told.get(0x200, np.full(n, size, np.int64)), told.get(0x400, np.full(n, flags, np.int64)).copy()
                if n and first is not None:
                    marks[0] = first
                self.duration += int(told.get(0x100, np.full(n, duration, np.int64)).sum())
                self.keys = np.concatenate([self.keys, len(self.sizes) + np.flatnonzero(marks & 0x10000 == 0)])
                self.starts = np.concatenate([self.starts, at + np.cumsum(sizes) - sizes])
                self.sizes = np.concatenate([self.sizes, sizes])
                self.chunks = np.concatenate([self.chunks, [[at, int(sizes.sum())]]])
                at += int(sizes.sum())

    def keyframes(self) -> list[tuple[int, int]]:
        return list(zip(self.starts[self.keys].tolist(), self.sizes[self.keys].tolist()))

    def payload(self, media: bytes) -> bytes:
        return b"".join([media[a : a + n] for a, n in self.chunks.tolist()])

    def feature(self) -> str:
        """codec, seconds, samples, keyframes, and the crc32 of the keyframes' byte ranges."""
        ranges = ",".join(f"{a}+{n}" for a, n in self.keyframes())
        return f"{self.codec}|{self.duration / self.timescale:.2f}s|{len(self.sizes)}|{len(self.keys)}|{zlib.crc32(ranges.encode()):08x}"


def tracks(media: bytes) -> list[Track]:
    """All tracks of a container, samples of movie fragments included."""
    found, defaults, fragments, own = [], {}, [], 0
    for path, a, b in walk(media):
        if path == (b"moov", b"trak"):
            found.append(_boxes(media, a, b))
        elif path == (b"moov", b"mvex", b"trex") and b - a >= 24:
            number, _, *rest = struct.unpack_from(">IIIII", media, a + 4)
            defaults[number] = rest
        elif path == (b"moof",):
            own = a - (8 if media[a - 4 : a] == b"moof" else 16)
        elif path == (b"moof", b"traf"):
            fragments.append(_fragment(media, a, b, own, defaults))
    return [Track(media, f, fragments) for f in found]


def _fragment(media, start: int, end: int, moof: int, defaults: dict) -> tuple:
    """The track's number, its defaults (duration, size, flags), where its data's offsets begin, and the places of its truns."""
    number, told, base, runs = -1, (0, 0, 0), moof, []
    try:
        for path, a, b in walk(media, start, end):
            if path == (b"tfhd",):
                given = int.from_bytes(media[a + 1 : a + 4], "big")
                (number,) = struct.unpack_from(">I", media, a + 4)
                told, place = list(defaults.get(number, (0, 0, 0))), a + 8
                if given & 1:
                    (base,), place = struct.unpack_from(">Q", media, place), place + 8
                place += 4 if given & 2 else 0
                for i, bit in enumerate((8, 16, 32)):
                    if given & bit:
                        (told[i],), place = struct.unpack_from(">I", media, place), place + 4
            elif path == (b"trun",):
                runs.append((a, b))
    except struct.error as error:
        raise MediaError(f"a fragment's header is cut off: {error}") from error
    return number, told, min(base, len(media)), runs


def store_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_bytes and media: each text's UTF-8 bytes as a container, written to the shared folder and read back.

    Null and empty texts are one sample of padding; equal texts give equal bytes; a text of any length is stored whole.
    """

    def begin():
        def apply(texts):
            raw = [(t or "").encode() for t in texts]
            return [[len(r) for r in raw], [store(r) for r in raw]]

        return apply

    return stored(text_pass(docs, keep, "text", [("n_bytes", "long"), ("media", "binary")], begin), "media")


def _media_pass(df: DataFrame, keep: list[str], column: str, made: list[tuple[str, str]], each) -> DataFrame:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in keep if c not in {n for n, _ in made}]
    out = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in made])
    kinds = to_arrow_schema(out)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows = [each(m) for m in part.column(part.num_columns - 1).to_pylist()]
                kept = [part.column(i).cast(kinds[i].type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array([r[i] for r in rows], kinds[len(keep) + i].type) for i in range(len(made))], schema=kinds)

    return df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").alias("m")).mapInArrow(work, out)


def probe(df: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """keep, codec, seconds, samples, keyframes (byte ranges) and error of a column of containers.

    Of several tracks see Track.  Null or unreadable bytes: error says why, the other columns are null.  Repeated rows are
    read alike, an empty table stays empty; a kept column called like a new one gives way to it.
    """

    def each(media):
        try:
            t = Track(media if media is not None else b"")
            return t.codec, t.duration / t.timescale if t.timescale else None, len(t.sizes), [{"start": a, "length": n} for a, n in t.keyframes()], None
        except MediaError as error:
            return None, None, None, None, str(error)

    return _media_pass(df, keep, column, [("codec", "string"), ("seconds", "double"), ("samples", "long"), ("keyframes", "array<struct<start:long,length:long>>"), ("error", "string")], each)


def digests(df: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """keep, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, all from the stored bytes."""

    def each(media):
        track = Track(media)
        data = track.payload(media)
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), track.feature()

    made = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    return _media_pass(df, keep, column, made, each)
