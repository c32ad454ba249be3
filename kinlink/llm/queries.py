"""The registered queries of this subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import bpe, decontaminate, langid, media, quality, repeats, sharding, simhash, tokens, urls
from kinlink.llm.common import held_out, new_path
from kinlink.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store_texts(_table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id", "n_bytes"])


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        described = f.read()
    path = new_path(spark, "tokens")
    tokens.write(_table(spark, sf_dir, "documents"), described, path)
    return tokens.digests(spark, path)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"]).drop("spans")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(_table(spark, sf_dir, "documents"), ["doc_id"])


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_simhash, op3_media, op4_token_ids, op5_quality, op6_urls, op7_decontaminate, op8_byte_bpe, op9_repeats, op10_shard)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
