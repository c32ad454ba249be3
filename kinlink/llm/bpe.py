"""Byte-level BPE with the tokenizers library over Arrow batches, from a file of ranks.

A rank file lists byte strings and their ranks.  Bytes become printable characters by the byte-to-character
mapping that byte-level vocabularies share; merges are every split of a token into two tokens, in the
order of the token's rank, so that the library merges by rank as a rank encoder does.  Decoding reverses
the byte table; characters cut between tokens are joined again before UTF-8 is read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from kinlink.llm.common import text_pass

#: Bytes of distinct pieces that a worker remembers, and what each takes beside its characters; beyond that it forgets and begins again.
REMEMBERED, ENTRY = 32 << 20, 120


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """The tokenizers library's form of a rank table."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for t in sorted(ranks, key=ranks.get):
        for cut in range(1, len(t)):
            a, b = t[:cut], t[cut:]
            if a in ranks and b in ranks:
                merges.append((shown[a], shown[b]))
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made.to_str()


class ByteBPE:
    """Encodes and decodes in one worker.  Equal pieces are encoded once while remembered."""

    def __init__(self, described: str, ranks: dict[bytes, int], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(described)
        # white space as the Unicode property has it: without U+001C to U+001F
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.bytes[r] = t
        self.names = [str(i) for i in range(len(self.bytes))]
        #: Ids as bytes: small, and joined without a list for each piece.
        self.wide = np.dtype("<u2" if len(self.bytes) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.find(t) for t in texts]
        known = self.known
        if new := list(set(chain.from_iterable(pieces)).difference(known)):
            taken = sum(map(len, new)) + ENTRY * len(new)
            if self.held + taken > REMEMBERED:
                known.clear()
                new = list(set(chain.from_iterable(pieces)))
                self.held, taken = 0, sum(map(len, new)) + ENTRY * len(new)
            self.held += taken
            for a in range(0, len(new), 20_000):
                part = new[a : a + 20_000]
                known.update(zip(part, [np.array(e.ids, self.wide).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]))
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), self.wide).tolist() for p in pieces]

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        """For each id the characters it touches (start, end); ids that share a split character overlap there."""
        out, byte, char = [], 0, 0
        raw = self.decode(ids)
        for i in ids:
            piece = self.bytes[i]
            start = char - 1 if piece and piece[0] & 0xC0 == 0x80 else char
            char += sum(b & 0xC0 != 0x80 for b in piece)
            byte += len(piece)
            out.append((max(start, 0), char))
        assert byte == len(raw)
        return out

    def text(self, ids: list[int]) -> str:
        """The decoded text; bytes that are no whole character, as at the edges of a cut list of ids, become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")


_CODER: list = [None, None]


def coder_of(described: str, ranks: dict[bytes, int], pattern: str) -> ByteBPE:
    """This process's coder: a worker's next task finds the pieces that earlier ones encoded."""
    if _CODER[0] != (described, pattern):
        _CODER[:] = [(described, pattern), ByteBPE(described, ranks, pattern)]
    return _CODER[1]


def _spread(spark, path: str):
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((tokenizer_json(ranks), ranks))


def encode(docs: DataFrame, keep: list[str], path: str, pattern: str, with_offsets: bool = False) -> DataFrame:
    """keep and ids (array of int); with_offsets adds offsets (array of start and end characters).  Null text: no ids."""
    shared = _spread(docs.sparkSession, path)

    def begin():
        bpe = coder_of(*shared.value, pattern)

        def apply(texts):
            ids = bpe.encode([t or "" for t in texts])
            return [ids, [[{"start": a, "end": b} for a, b in bpe.offsets(x)] for x in ids]] if with_offsets else [ids]

        return apply

    return text_pass(docs, keep, "text", [("ids", "array<int>")] + [("offsets", "array<struct<start:int,end:int>>")] * with_offsets, begin)


def digests(docs: DataFrame, keep: list[str], path: str, pattern: str) -> DataFrame:
    """keep, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 (the bytes that the ids decode to).

    Null or empty text: no ids, the digests of no bytes.  Repeated rows are encoded alike, an empty table stays empty, a text of
    any length is encoded as a whole, and a kept column called like a new one gives way to it.
    """
    shared = _spread(docs.sparkSession, path)

    def begin():
        bpe = coder_of(*shared.value, pattern)

        def apply(texts):
            n, a, b = [], [], []
            for ids in bpe.encode([t or "" for t in texts]):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([bpe.names[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [n, a, b]

        return apply

    return text_pass(docs, keep, "text", [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], begin)
