"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their ranks by frequency over the whole corpus (ties: the smaller id first).  A rank takes
one to four bytes, little endian; two bits for each, four ranks to a control byte, stand in a stream of
their own.  A table with a row for each control byte gives the four lengths, so that a block is decoded
with a few numpy operations.

Files are Parquet tables of blocks in ascending document order: each has the range partition it
belongs to, its place there, the ids that stand before it in that partition, its documents and their
counts, the control bytes and the data bytes.  A file needs the table of ranks, stored beside it.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import BATCH_BYTES, bounded_batches, new_path, steps, stored

END = 1
#: Ids after which a block ends; a document is never cut.
BLOCK = 1 << 18
#: Bytes of distinct words that a worker remembers, and what each takes beside its characters.
REMEMBERED, ENTRY = 128 << 20, 120

#: Normaliser and pattern of descriptions whose words may be encoded one by one.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch

#: Lengths (1 to 4) of the four ranks that a control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """The control and data bytes of ranks (0 to 2**32 - 1)."""
    r = ranks.astype(np.uint32)
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = extra
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= extra[:, None]
    return control.tobytes(), r.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block: lengths by table lookup, then one gather for each byte place."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data + bytes(4), np.uint8)
    first = np.cumsum(lengths) - lengths
    out = raw[first].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[first[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def by_words(described: str) -> bool:
    """Whether a tokenizer's description lets words be encoded one by one: BY_WORDS, and a BPE model without dropout or prefixes."""
    d = json.loads(described)
    model = d["model"]
    return {k: d.get(k) for k in BY_WORDS} == BY_WORDS and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not d.get("truncation") and not d.get("padding")


def _taken(words: list[str]) -> int:
    return sum(map(len, words)) + ENTRY * len(words)


class WordEncoder:
    """Ids of texts by the tokenizers library, as it encodes whole texts; each distinct word is encoded once while remembered.

    A normaliser and pattern as in BY_WORDS treat white-space-separated words apart, and a mark after a
    letter of Latin-1 always begins a new piece, so a text's ids are its words' ids in turn.  Only lower-casing of
    A-Z is done before; everything else is the library's.  Words of Latin-1 letters are one piece each, so
    that many are encoded as one text and cut behind the ids that end a word.  Texts that hold the string of an added
    token, whatever the case, and all texts under another description go to the library whole and unchanged.
    """

    def __init__(self, described: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(described)
        self.by_words = by_words(described)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.wide = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(size, bool)
        if suffix:
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        added = [t["content"].lower() for t in json.loads(described).get("added_tokens") or []]
        # characters that only some take for white space, and added tokens: such texts stay whole
        self.odd = "|".join(["[\x1c-\x1f]", *map(re.escape, added)])
        self.known: dict[str, bytes] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.wide).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        plain = list(filter(_PLAIN, new)) if self.last.any() else []
        for a in range(0, len(plain), 5_000):
            part = plain[a : a + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.wide)
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.wide.itemsize
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))
        rest = [w for w in new if w not in self.known]
        for a in range(0, len(rest), 20_000):
            self.known.update(zip(rest[a : a + 20_000], self.whole(rest[a : a + 20_000])))
        self.held += _taken(new)

    def encoded(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, pa.Buffer]:
        """Where each text's ids begin (and the last end), in bytes, and the ids' bytes; `end` follows each text."""
        texts = texts.fill_null("")
        lower = pc.ascii_lower(texts)
        odd = pc.match_substring_regex(lower, self.odd) if self.by_words else pa.array([True] * len(texts), pa.bool_())
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(lower, r"([a-zÀ-ÖØ-öø-ÿ])([.,;:!?]+)", r"\1 \2"))
        whole: dict[str, bytes] = {}
        if pc.any(odd).as_py():
            own = texts.filter(odd).unique().to_pylist()
            # no word holds a space: such keys meet none
            whole = {f" {t}": w for t, w in zip(own, self.whole(own))}
            lists = pa.array([[f" {t}"] if o else x for t, o, x in zip(texts.to_pylist(), odd.to_pylist(), lists.to_pylist())], pa.list_(pa.string()))
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        if new := [w for w in words if w not in self.known and w not in whole]:
            if self.held + _taken(new) > REMEMBERED:
                self.known, self.held = {}, 0
                new = [w for w in words if w not in whole]
            self.learn(new)
        ids = [whole[w] if w in whole else self.known[w] for w in words] if whole else list(map(self.known.__getitem__, words))
        rows = lists.offsets.to_numpy().astype(np.int64)
        rows = rows - rows[0]
        codes = flat.indices.to_numpy()
        if end is not None:
            codes = np.insert(codes, rows[1:], len(ids))
            ids.append(np.array([end], self.wide).tobytes())
            rows = rows + np.arange(len(rows))
        taken = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :] if len(taken) else np.zeros(1, np.int64)
        return places[rows], taken.buffers()[2] or pa.py_buffer(b"")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, and the count of each text's ids."""
        ends, data = self.encoded(texts)
        return np.frombuffer(data, self.wide, int(ends[-1]) // self.wide.itemsize), np.diff(ends) // self.wide.itemsize


_ENCODER: list = [None, None]


def encoder_of(described: str) -> WordEncoder:
    """This process's encoder: a worker's next task finds the words that earlier ones learned."""
    if _ENCODER[0] != described:
        _ENCODER[:] = [described, WordEncoder(described)]
    return _ENCODER[1]


def encode(docs: DataFrame, tokenizer_json: str, end: int = END) -> DataFrame:
    """doc_id and ids (16 bits each where the vocabulary fits, else 32, the end id last) of every document.

    Null or empty text: the end id alone.  Strings of added tokens in a text become those tokens, as in the library.
    Repeated rows each get their ids; a text of any length is encoded as a whole.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches):
        encoder = encoder_of(shared.value)
        for batch in batches:
            for a, b in steps(batch.column(1), BATCH_BYTES):
                ends, data = encoder.encoded(batch.column(1).slice(a, b - a), end)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.tobytes()), data])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids.cast(pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {kind}, ids binary")


def frequencies(encoded: DataFrame, kind: np.dtype) -> DataFrame:
    """id and n over all encoded documents; a row for each id of the vocabulary at most."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids, ends = batch.column(0), np.frombuffer(batch.column(0).buffers()[1], np.int32)
            first, last = ends[ids.offset], ends[ids.offset + len(ids)]
            n = np.bincount(np.frombuffer(ids.buffers()[2], np.uint8, last - first, first).view(kind)) if last > first else total[:0]
            if len(n) > len(total):
                total, n = n, total
            total[: len(n)] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, tokenizer_json: str, path: str, end: int = END, block_ids: int = BLOCK) -> None:
    """Writes path/ranks and path/blocks.

    The encoded documents are kept in the shared folder, their ids are counted, and they are dealt by ranges
    of (doc_id, ids' hash, a number of each row), so that repeated ids and rows spread over partitions.
    """
    encoded = stored(encode(docs, tokenizer_json, end).withColumn("h", F.xxhash64("ids")), "encoded")
    wide = encoder_of(tokenizer_json).wide
    ranked = frequencies(encoded, wide).orderBy(F.desc("n"), "id")
    # one row for each id of the vocabulary at most
    order = ranked.toPandas()["id"].to_numpy(np.int64)
    spark = docs.sparkSession
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(order))), "id": pa.array(order)})).coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(rank)
    kind = dict(docs.dtypes)["doc_id"]
    dealt = encoded.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("doc_id", "h", "salt").sortWithinPartitions("doc_id", "h", "salt")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(f"part int, place long, before long, doc_ids array<{kind}>, counts array<int>, control binary, data binary")
    kinds = to_arrow_schema(schema)

    def blocks(batches):
        place = before = held = 0
        docs_, parts, part = [], [], 0

        def block():
            ids = np.concatenate(parts)
            control, data = pack(shared.value[ids])
            return pa.RecordBatch.from_arrays([pa.array([x], k.type) for x, k in zip((part, place, before, docs_, [len(p) for p in parts], control, data), kinds)], schema=kinds)

        for batch in batches:
            for part, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs_.append(doc_id)
                parts.append(np.frombuffer(ids.as_buffer(), wide))
                held += len(parts[-1])
                if held >= block_ids:
                    yield block()
                    place, before, held, docs_, parts = place + 1, before + held, 0, [], []
        if parts:
            yield block()

    dealt.mapInArrow(blocks, schema).write.parquet(f"{path}/blocks")


def _ids(spark, path: str) -> np.ndarray:
    """The id of each rank."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()
    return ranks["id"].to_numpy(np.uint32)


def read(spark, path: str) -> DataFrame:
    """doc_id, start and ids (array of long) of every document of a written corpus."""
    return _decoded(spark, path, [("ids", "array<long>")], lambda ids: (ids.tolist(),))


def digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    return _decoded(spark, path, [("n_tokens", "long"), ("ids_crc32", "long")], lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


def _decoded(spark, path: str, made: list[tuple[str, str]], each) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    # a number for each range partition: where it starts
    ends = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.max(F.col("before") + F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n")).collect())
    starts, at = {}, 0
    for part, n in ends:
        starts[part] = at
        at += n
    shared = spark.sparkContext.broadcast((starts, _ids(spark, path)))
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = blocks.schema["doc_ids"].dataType.elementType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType())] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in made])
    kinds = to_arrow_schema(out)

    def work(batches):
        first, ids = shared.value
        for batch in batches:
            for part, before, doc_ids, counts, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.array(counts, np.int64)
                ends = np.cumsum(n)
                full = ids[unpack(control, data, int(ends[-1]))]
                rows = [each(full[b - m : b]) for b, m in zip(ends.tolist(), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, kinds[0].type), pa.array(ends - n + before + first[part])] + [pa.array([r[i] for r in rows], kinds[2 + i].type) for i in range(len(made))], schema=kinds)

    return blocks.select("part", "before", "doc_ids", "counts", "control", "data").mapInArrow(work, out)
