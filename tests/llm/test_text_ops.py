import hashlib
import re
import zlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.llm import bpe, decontaminate, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "\x00\x1c x", "é" * 50, "word " * 30000, "日本😀 don't  stop\n\n", "a", "a"]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_bpe_equals_rank_encoder(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    named = docs(spark, ODD).withColumns({"ids": F.lit("own"), "n_tokens": F.lit("own")})
    got = {r.doc_id: r for r in bpe.digests(named, ["doc_id", "ids", "n_tokens"], path, P.PATTERN).collect()}
    assert got[0].ids == "own" and bpe.digests(named.limit(0), ["doc_id"], path, P.PATTERN).count() == 0
    for i, t in enumerate(ODD):
        ids = want.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_offsets_and_split_characters(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    row = bpe.encode(docs(spark, ["日本é😀x"]), ["doc_id"], path, P.PATTERN, with_offsets=True).head()
    made = bpe.ByteBPE(bpe.tokenizer_json(bpe.read_ranks(path)), bpe.read_ranks(path), P.PATTERN)
    assert made.text(row.ids) == "日本é😀x"
    assert made.text(row.ids[:1]) == "�"
    assert row.offsets[-1].end == 5 and row.offsets[0].start == 0


def brute(texts, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = []
    for i, t in items:
        w = pattern.findall(low(t))
        windows += [(i, w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)]
    for t in texts:
        w, hit, ids = pattern.findall(low(t)), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    ids |= {i} - {None}
        yield len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def test_decontaminate_equals_brute_force(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    items = [(10, passage), (9, "Two words"), (11, passage), (12, ""), (13, None), (14, "é1 é2"), (None, "item without id")]
    texts = [None, "", passage.upper() + "!", "x " + " ".join(f"w{i}," for i in range(3, 14)) + " y", "two  WORDS two", "twowords two wordsx", "É1 é2 é1 é2", " ".join(f"w{i}" for i in range(9)), "two words", "an ITEM without id"]
    texts += [texts[3], "z " * 60_000 + passage + " z" * 60_000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, texts).withColumn("n_hit", F.lit("own")), bench, ["doc_id"]).collect()}
    for i, want in enumerate(brute(texts, items)):
        r = out[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == want, i
        assert r.contaminated == (r.n_hit > 0)
    assert [texts[4][s.start : s.end] for s in out[4].spans] == ["two  WORDS"]
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0), ["doc_id"]).where("contaminated").count() == 0
    assert decontaminate.contaminated(docs(spark, []), bench, ["doc_id"]).count() == 0


def test_decontaminate_blocks(spark):
    items = [(i, " ".join(f"a{i}b{k}" for k in range(12))) for i in range(20)] + [(20, items_of := " ".join(f"a3b{k}" for k in range(5, 12)))]
    texts = [items[3][1] + " " + items[17][1], None, "clean", items_of.upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts).withColumn("__p9", F.lit(1))
    one = decontaminate.contaminated(df, bench, ["doc_id", "__p9"]).orderBy("doc_id").collect()
    many = decontaminate.contaminated(df, bench, ["doc_id", "__p9"], block_bytes=300).orderBy("doc_id").collect()
    for x, y in zip(one, many):
        assert [v for k, v in x.asDict().items() if k != "spans"] == [v for k, v in y.asDict().items() if k != "spans"]
    assert one[0].n_items == 3 and one[0].n_hit == 24 and one[3].n_items == 1 and not one[2].contaminated


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc ", max_size=40), max_size=4), st.text("abcd ", max_size=60), st.sampled_from([1, 2, 3, 4, 10]))
def test_scanner_equals_all_windows(items, text, window):
    ((ws, runs, found),) = decontaminate.Scanner([(str(i), t) for i, t in enumerate(items)], window).scan([text])
    hit, seen = set(), set()
    for i, t in enumerate(items):
        own = t.split()
        for a in range(max(1, len(own) - window + 1) if own else 0):
            part = own[a : a + window]
            for b in range(len(ws) - len(part) + 1):
                if [w.decode() for w in ws[b : b + len(part)]] == part:
                    hit |= set(range(b, b + len(part)))
                    seen.add(i)
    assert {x for a, b in runs for x in range(a, b)} == hit and found == seen


def test_automaton_has_two_nodes_for_each_word():
    items = [(str(i), " ".join(f"w{i * 7 + k}" for k in range(50))) for i in range(2000)]
    scanner = decontaminate.Scanner(items)
    assert scanner.auto.get_stats()["nodes_count"] <= 2 * 2000 * 50 + 1
    assert scanner.scan([items[7][1]])[0][1:] == ([(0, 50)], set(range(2, 13)))


def test_item_ids_of_any_type(spark):
    bench = spark.createDataFrame([("q/10", "two words"), ("q/9", "words two"), (None, "no id")], "item_id string, text string")
    out = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, ["two words two", "no id"]), bench, ["doc_id"]).collect()}
    assert (out[0].n_items, out[0].items_sha256) == (2, hashlib.sha256(b"q/10,q/9").hexdigest())
    assert (out[1].n_hit, out[1].n_items, out[1].contaminated) == (2, 0, True)


def test_shard_spreads_equal_rows(spark):
    rows = spark.range(400_000, numPartitions=4).select(F.lit(1).alias("a"), F.lit("x").alias("b"), F.monotonically_increasing_id().alias("salt"))
    n = sorted(r["count"] for r in rows.groupBy(sharding._bucket([F.col("a"), F.col("b"), F.col("salt")], 40)).count().collect())
    assert len(n) == 40 and n[-1] <= 2 * n[20]
    keep, sharding.ROWS_A_BUCKET = sharding.ROWS_A_BUCKET, 100
    try:
        named = spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("y" * 100_000).alias("text"), F.lit(1).alias("__bucket"), F.lit(2).alias("slot"))
        out = sharding.assign(named.drop("text"), "doc_id", [1.0] * 8)
        assert sorted(out.columns) == ["__bucket", "doc_id", "shard", "slot"] and sorted(r.slot for r in out.collect()) == list(range(3000))
    finally:
        sharding.ROWS_A_BUCKET = keep
    long = sharding.shard_documents(docs(spark, ["é" * 3_000_000, None])).orderBy("doc_id").collect()
    assert [r["size"] for r in long] == [6_000_001, 1] and long[0].text_crc32 == zlib.crc32(("é" * 3_000_000).encode())


def test_shard_documents(spark):
    texts = ["x" * (i % 7) for i in range(3000)] + [None] * 500 + ["hot"] * 1500
    ids = [*range(4000), *([7] * 500), *([None] * 500)]
    df = docs(spark, texts, ids).withColumn("shard", F.lit("clash"))
    out = sharding.shard_documents(df).toPandas()
    assert len(out) == 5000 and set(out.law) == {"key"} and out.shard.between(0, 7).all()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    moved = out[out.shard != out.grown_shard]
    assert (moved.grown_shard == 8).all() and 0.05 < len(moved.doc_id.unique()) / 4000 < 0.18
    assert out.groupby(out.doc_id.fillna(-1)).shard.nunique().max() == 1
    null = out[(out["size"] == 1)]
    assert (null.text_crc32 == 0).all()
    assert out[out["size"] == 4].text_crc32.eq(zlib.crc32(b"hot")).any()
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_shard_weights(spark):
    df = spark.range(20000).withColumn("shard", sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 1.0]))
    n = dict(df.groupBy("shard").count().collect())
    assert 2 not in n and abs(n[1] - 10000) < 400 and abs(n[0] - 5000) < 400
