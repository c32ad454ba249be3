import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from kinlink.llm import bpe
from tests.llm.test_dedup import brute_removal
from tests.llm.test_text_ops import DOCS

pipeline = pytest.importorskip("corpus_pipeline")


def sentence(k, n):
    return " ".join(f"the word{k}x{i} of" for i in range(n))


def planted():
    """Texts, and those that stay: clean ones, and the first of each group of copies."""
    passage = sentence(900, 40)
    question = sentence(700, 10)
    rows = [(i, sentence(i, 30 + i)) for i in range(30)]
    rows += [(100, sentence(3, 33)), (101, sentence(4, 34) + " added"), (102, "New " + sentence(5, 35)), (101, sentence(4, 34) + " added")]
    rows += [(200, sentence(210, 20) + " " + passage), (201, passage + " " + sentence(211, 20))]
    rows += [(300, sentence(310, 20) + " " + question.upper())]
    rows += [(400, None), (401, ""), (402, "123 %%"), (None, sentence(500, 20))]
    return rows, question, {*range(30), 200, 201, None}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, question, _ = planted()
    out = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(i, t, None if i == 1 else "en", "src0", None) for i, t in rows], DOCS).withColumn("score", F.lit("own")).withColumn("k0", F.lit(1))
    df.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, question), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages_equal_brute_force(spark, folder):
    rows, _, stay = planted()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name != "tokens":
            assert made.columns == columns, name
        seen[name] = made.collect()
        docs = spark.createDataFrame(seen[name], made.schema)
    assert {r.doc_id for r in seen["language"]} == {i for i, _ in rows} - {400, 401, 402}
    assert next(r.lang for r in seen["language"] if r.doc_id == 1) == "en"
    one = [r.doc_id for r in seen["near_duplicates"]]
    assert len(one) == len(set(one)) and set(one) == stay | {300}
    texts = {r.doc_id: r.text for r in seen["near_duplicates"]}
    for r, (n, gone, _, _) in zip(seen["repeated_bytes"], brute_removal([texts[r.doc_id] for r in seen["repeated_bytes"]])):
        assert len(r.text.encode()) == n - gone and r.n_chars == len(r.text)
    assert {r.doc_id for r in seen["benchmark_free"]} == stay
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = {r.doc_id: r.text for r in seen["benchmark_free"]}
    for r in seen["tokens"]:
        ids = coder.encode_ordinary(last[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_run_and_empty_table(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).count() == len(planted()[2])
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
