"""Benchmark decontamination: one Aho-Corasick automaton over the normalised words of all items.

A text is normalised byte by byte: A-Z become a-z, and every ASCII byte that is neither letter nor
digit becomes a space.  Words are what stands between spaces.  Every word of the items has a number, written as
two characters, so that a text is a string of two characters a word.

The automaton holds the items' blocks of half a window, one after another, so that it has at most two nodes for each
word of the items.  Any window of an item has such a block whole in it: a text is scanned once, and each block that it
holds is extended word by word on both sides in every item that has it there.  Where a window's worth of words agrees
the words are hit.  Items shorter than a window are one pattern each.  Hits are mapped to offsets of the original text
by the words' places there.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import text_pass

WINDOW = 10
#: Bytes of items in one automaton, which every worker holds with some 50 bytes for each of these.  More items than that
#: are scanned for in further passes.
BLOCK_BYTES = 8 << 20

TO = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO).split()


class Scanner:
    """Scans texts against items (id or None, text)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        import ahocorasick

        self.reach = window - (half := (window + 1) // 2)
        self.ids = [i for i, _ in items]
        number: dict[bytes, int] = {}
        # every item behind places that agree with nothing
        gap = [-1] * (self.reach + 1)
        told, self.begins, self.needs = list(gap), [], []
        for _, text in items:
            ws = words(text)
            self.begins.append(len(told))
            self.needs.append(min(window, len(ws)))
            told += [number.setdefault(w, len(number) + 1) for w in ws] + gap
        self.told, self.begins, self.needs = np.array(told, np.int32), np.array(self.begins), np.array(self.needs)
        base = int(len(number) ** 0.5) + 1
        # first and second characters of words differ, so that no match begins inside a word
        signs = ["  "] + [chr(0x100 + n // base) + chr(0x102 + base + n % base) for n in range(1, len(number) + 1)]
        self.known = {w: (signs[n], n) for w, n in number.items()}
        places: dict[str, list[int]] = {}
        for begin, (_, text), need in zip(self.begins.tolist(), items, self.needs.tolist()):
            n, size = len(words(text)), half if need == window else need
            for a in range(begin, begin + n - size + 1, size) if need else ():
                places.setdefault("".join(map(signs.__getitem__, told[a : a + size])), []).append(a)
        self.auto = None
        if places:
            self.auto = ahocorasick.Automaton()
            for key, at in places.items():
                self.auto.add_word(key, (len(key) // 2, np.array(at)))
            self.auto.make_automaton()

    def scan(self, texts: list[str | None]) -> list[tuple[list[bytes], list[tuple[int, int]], set[int]]]:
        """For each text its words, the maximal runs of hit words (first, behind the last), and the numbers of the items that occur."""
        out, unknown, pad = [], ("  ", 0), [-2] * self.reach
        for text in texts:
            ws, runs, items = words(text), [], set()
            if self.auto is not None and ws:
                told = [self.known.get(w, unknown) for w in ws]
                hits = list(self.auto.iter("".join([t for t, _ in told])))
                if hits:
                    own = np.array(pad + [n for _, n in told] + pad, np.int32)
                    for end, (size, at) in hits:
                        self._extend(own, end // 2 - size + 1, size, at, runs, items)
            out.append((ws, merged(runs), items))
        return out

    def _extend(self, own: np.ndarray, first: int, size: int, at: np.ndarray, runs: list, items: set) -> None:
        """Adds the run around words first to first + size of a text, and the items, where enough words agree with the items' at `at`."""
        here, step = first + self.reach, np.arange(self.reach)
        left = np.cumprod(self.told[at[:, None] - 1 - step] == own[here - 1 - step], axis=1).sum(axis=1)
        right = np.cumprod(self.told[at[:, None] + size + step] == own[here + size + step], axis=1).sum(axis=1)
        item = np.searchsorted(self.begins, at, "right") - 1
        fits = left + size + right >= self.needs[item]
        if fits.any():
            runs += set(zip((first - left[fits]).tolist(), (first + size + right[fits]).tolist()))
            items.update(item[fits].tolist())


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words."""
    if not runs:
        return []
    raw = text.encode()
    word = np.frombuffer(raw.translate(TO), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[begins[a]]), int(chars[ends[b - 1]])) for a, b in runs]


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark's distinct items in blocks of at most block_bytes, or of one item; an empty one without items."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").distinct().orderBy("i", "t")
    block, held, some = [], 0, False
    for r in rows.toLocalIterator():
        size = len(r.t.encode())
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held, some = held + size, True
    if block or not some:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keep, and n_words, n_hit, n_items, items_sha256, contaminated, spans (character offsets of hit runs).

    Items of up to block_bytes are one automaton, broadcast and scanned for in one pass; larger benchmarks
    take a pass for each block, whose findings are put together by row.  Null or empty text: no words, not
    contaminated.  Items with no word never occur; equal items all count; items without an item_id hit words, but are in
    no list; ids may be of any type and are listed as text.  An empty benchmark leaves every document clean.  Repeated
    documents are told alike, an empty table stays empty, texts of any length are scanned as a whole, and a kept column
    called like a new one stays beside it.
    """
    rest = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col("text"))
    found, blocks = [], _blocks(benchmark, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        found.append(f"__p{len(found)}")
        kept = [c for c in rest.columns if c != "text" or following is not None]
        rest = _scanned(rest, kept, docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block)), found[-1], window)
        block = following
    every = lambda field: F.flatten(F.array(*[F.col(f"{p}.{field}") for p in found]))
    hits = F.size(F.array_distinct(F.flatten(F.transform(every("runs"), lambda r: F.sequence(r["a"], r["b"] - 1)))))
    items = F.array_sort(F.array_distinct(every("items")))
    made = {
        "n_words": F.col("__p0.n"), "n_hit": hits.cast("long"), "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256),
        "contaminated": F.size(every("runs")) > 0, "spans": F.array_sort(F.array_distinct(every("spans"))),
    }
    return rest.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *[v.alias(k) for k, v in made.items()])


_SCANNER: list = [None, None]


def scanner_of(key: str, items: list[tuple[str | None, str]], window: int) -> Scanner:
    """This process's scanner: a worker's next task finds the one that an earlier task made."""
    if _SCANNER[0] != (key, window):
        _SCANNER[:] = [None, None]
        _SCANNER[:] = [(key, window), Scanner(items, window)]
    return _SCANNER[1]


def _scanned(rest: DataFrame, kept: list[str], items, name: str, window: int) -> DataFrame:
    """kept, with one block's findings as the column `name`."""

    def begin():
        scanner = scanner_of(*items.value, window)

        def apply(texts):
            out = []
            for text, (ws, runs, found) in zip(texts, scanner.scan(texts)):
                ids = sorted({scanner.ids[i] for i in found} - {None})
                out.append({"n": len(ws), "runs": [{"a": a, "b": b} for a, b in runs], "items": ids, "spans": [{"start": a, "end": b} for a, b in offsets(text or "", runs)]})
            return [out]

        return apply

    kind = "struct<n:long,runs:array<struct<a:int,b:int>>,items:array<string>,spans:array<struct<start:int,end:int>>>"
    return text_pass(rest, kept, "text", [(name, kind)], begin)
