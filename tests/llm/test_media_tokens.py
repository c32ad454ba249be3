import hashlib
import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinlink.llm import media, queries, tokens
from kinlink.llm.common import new_path
from tests.llm.test_text_ops import ODD, docs


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 16, 576 * 16 + 1, 576 * 41 + 7])
def test_container_round_trip(n):
    raw = os.urandom(n)
    stored = media.store(raw)
    track = media.Track(stored)
    assert track.payload(stored) == media.padded(raw) and track.codec == "raw " and track.duration == len(media.padded(raw)) // 576
    assert [stored[a : a + 576] for a, _ in track.keyframes()] == [media.padded(raw)[i : i + 576] for i in range(0, len(media.padded(raw)), 576 * media.CHUNK)]
    kinds = [p[-1] for p, _, _ in media.walk(stored)]
    assert kinds[:2] == [b"ftyp", b"moov"] and kinds[-1] == b"mdat" and b"stsz" in kinds


def test_odd_containers(spark):
    good = media.store(b"abc")
    long_box = struct.pack(">I4sQ", 1, b"free", 24) + bytes(8) + good
    bad = [None, b"", b"\0\0\0", good[:100], good[:-10], struct.pack(">I4s", 4, b"moov"), os.urandom(300), good.replace(b"stsz", b"xxxx")]
    df = spark.createDataFrame([(i, m) for i, m in enumerate([good, long_box, *bad])], "id int, media binary")
    rows = {r.id: r for r in media.probe(df, ["id"]).collect()}
    assert rows[0].error is None and rows[0].codec == "raw " and rows[0].samples == 1
    assert rows[1].codec == "raw " and rows[1].error is None
    assert all(rows[i + 2].error and rows[i + 2].codec is None for i in range(len(bad)))


def movie(flags, samples, extra=b""):
    """A container with one fragmented track: no samples in moov, one moof with a trun of (size, flags)."""
    full = lambda kind, *parts, f=0: media._full(kind, *parts, flags=f)
    empty = media._box(b"stbl", full(b"stsd", struct.pack(">I", 1), media._box(b"avc1", bytes(16))), full(b"stts", struct.pack(">I", 0)), full(b"stsc", struct.pack(">I", 0)), full(b"stsz", struct.pack(">II", 0, 0)), full(b"stco", struct.pack(">I", 0)))
    trak = media._box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7), bytes(68)), media._box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 10, 0)), full(b"hdlr", struct.pack(">I4s", 0, b"vide")), media._box(b"minf", empty)))
    moov = media._box(b"moov", trak, media._box(b"mvex", full(b"trex", struct.pack(">IIIII", 7, 1, 5, 0, 0x10000))))
    table = b"".join(struct.pack(">I", n) for n in samples)
    frag = lambda at: media._box(b"moof", media._box(b"traf", full(b"tfhd", struct.pack(">I", 7), f=0x20000), full(b"trun", struct.pack(">IiI", len(samples), at, 0), table, f=0x205)))
    return moov + frag(len(frag(0)) + 8) + media._box(b"mdat", b"".join(bytes([i]) * n for i, n in enumerate(samples)))


def test_fragments_and_several_tracks():
    m = movie(0, [30, 40, 50])
    t = media.Track(m)
    assert t.codec == "avc1" and t.sizes.tolist() == [30, 40, 50] and t.keys.tolist() == [0] and t.duration == 15
    assert [m[a : a + n] for a, n in zip(t.starts.tolist(), t.sizes.tolist())] == [bytes([0]) * 30, bytes([1]) * 40, bytes([2]) * 50]
    # sound first: the video track is chosen, and both are listed
    good = media.store(b"abc" * 500)
    (at, end), = [(a, b) for p, a, b in media.walk(good) if p == (b"moov", b"trak")]
    video = good[at - 8 : end]
    sound = video.replace(b"vide", b"soun").replace(b"raw ", b"twos")
    start = good.index(b"moov") - 4
    (size,) = struct.unpack_from(">I", good, start)
    both = good[:start] + struct.pack(">I", size + len(sound)) + good[start + 4 : at - 8] + sound + good[at - 8 :]
    assert [t.handler for t in media.tracks(both)] == [b"soun", b"vide"] and media.Track(both).codec == "raw "


def test_broken_containers_give_error_rows(spark):
    rng, good = random.Random(0), [media.store(bytes(range(256)) * 40), movie(0, [30, 40, 50])]
    rows = [good[0], good[1]]
    for k in range(3000):
        b = bytearray(good[k % 2])
        for _ in range(rng.randrange(1, 5)):
            b[rng.randrange(min(len(b), 900))] = rng.choice([0, 1, 127, 255, rng.randrange(256)])
        rows.append(bytes(b))
    df = spark.createDataFrame([(i, m, "own") for i, m in enumerate(rows)], "id int, media binary, error string")
    got = media.probe(df, ["id", "error"]).collect()
    assert len(got) == len(rows) and sum(r.error is not None for r in got) > 1000 and all((r.error is None) != (r.codec is None) for r in got)
    assert media.probe(df.limit(0), ["id"]).count() == 0


def test_media_query_columns(spark):
    df = docs(spark, ODD).withColumn("media", F.lit("clash"))
    got = {r.doc_id: r for r in media.digests(media.store_texts(df, ["doc_id", "media"]), ["doc_id", "n_bytes"]).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        data = media.padded(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.store(raw)).hexdigest() and r.media_bytes == len(media.store(raw))
    assert got[3].feature == got[8].feature and media.store_texts(df.limit(0), ["doc_id"]).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_packing_round_trip(ranks):
    r = np.array(ranks, np.uint32)
    control, data = tokens.pack(r)
    assert len(control) == -(-len(r) // 4) and (tokens.unpack(control, data, len(r)) == r).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="aB.,!éÉ́İ1 \n\x1c\x85'sßΣ日%<>|", max_size=20), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>"])), max_size=4).map("".join))
def test_word_encoder_equals_whole_texts(text):
    described = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    encoder = tokens.encoder_of(described)
    assert encoder.by_words
    ids, counts = encoder.encode(pa.array([text, None, text]))
    want = Tokenizer.from_str(described).encode(text, add_special_tokens=False).ids if "<|" in text else encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want + want and counts.tolist() == [len(want), 0, len(want)]


def test_other_tokenizers_encode_whole_texts():
    described = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    encoder, library = tokens.WordEncoder(described), Tokenizer.from_str(described)
    assert not encoder.by_words
    texts = ["Two  words\n\nand <|endoftext|> more", "", "don't"]
    ids, counts = encoder.encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


def test_token_files(spark):
    described = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(described)
    texts = ODD + ["hot text"] * 30 + ["<|endoftext|> a"]
    ids = [5, 3, 9, None, 1, 0, 2, 4, 7, 8] + [6] * 30 + [11]
    path = new_path(spark, "tokens")
    tokens.write(docs(spark, texts, ids).withColumn("ids", F.lit(1)), described, path, block_ids=40)
    rows = tokens.read(spark, path).toPandas().sort_values("start")
    assert rows.doc_id.fillna(-1).tolist() == sorted(-1 if i is None else i for i in ids)
    assert rows.start.tolist() == [0, *np.cumsum([len(x) for x in rows.ids])[:-1].tolist()]
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in zip(ids, texts)}
    for r in rows.itertuples():
        assert list(r.ids) == want[None if r.doc_id != r.doc_id else int(r.doc_id)]
    first = tokens.digests(spark, path).where("doc_id = 11").head()
    assert first.ids_crc32 == zlib.crc32(np.array(want[11], "<u4").tobytes()) and first.n_tokens == len(want[11])
    empty = new_path(spark, "tokens")
    tokens.write(docs(spark, []), described, empty)
    assert tokens.digests(spark, empty).count() == 0


def test_queries_cover_all_documents(spark):
    for q in (queries.op3_media, queries.op8_byte_bpe, queries.op10_shard):
        assert q(spark, "/root/testdata/sf0.001").count() == 200
