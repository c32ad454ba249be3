"""A training-corpus pipeline over `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet
in the shared folder, reads them back as the next one's docs, and deletes what the stage itself stored.  All but the last return the columns
of docs.  Null and empty texts are `und` and go in the first stage.  Repeated rows are near-duplicates of each other;
an empty table stays empty; further columns stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import bpe, decontaminate, langid, repeats, simhash
from kinlink.llm.common import held_out, new_path, scratch

_REST, _TEXT = "__rest", "__text"


def _nested(docs: DataFrame) -> DataFrame:
    """All columns but the text in one struct, so that no name clashes with what a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(_REST), F.col("text").alias(_TEXT), "text")


def _flat(nested: DataFrame, columns: list[str], **changed) -> DataFrame:
    return nested.select(*[changed[c].alias(c) if c in changed else F.col(_TEXT).alias(c) if c == "text" else F.col(f"{_REST}.`{c}`").alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a learned language: no letter, or none of a learned language's script; a missing lang becomes the predicted one."""
    model = langid.fit(docs.where(~held_out()))
    told = langid.identify(_nested(docs), model, [_REST, _TEXT]).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0))
    return _flat(told, docs.columns, **({"lang": F.coalesce(F.col(f"{_REST}.lang"), F.col("lang_pred"))} if "lang" in docs.columns else {}))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group."""
    return simhash.keep_one(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte of strings of 200 bytes that occur elsewhere; a document may become empty but stays."""
    done = repeats.cleaned(_nested(docs), [_REST], "clean")
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
    return _flat(done, docs.columns, **changed)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item."""
    told = decontaminate.contaminated(_nested(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), [_REST, _TEXT])
    return _flat(told.where(~F.col("contaminated")), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.digests(docs, ["doc_id"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("benchmark_free", benchmark_free),
    ("tokens", tokens),
]

#: Language scores, suffix arrays and BPE have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
