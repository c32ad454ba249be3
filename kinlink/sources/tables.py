"""Sources and sinks of a linkage run: strict tab-separated records, truth lists, and list files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A table of text: no quoting, no inference, `NULL` and `N/A` are plain text, a missing field is ''."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("encoding", "UTF-8").csv(path).na.fill("")


def read_sources(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The three sources of a split as one table with src (1 for entities, 2 and 3 for records)."""
    parts = [read_tsv(spark, f"{folder}/{split}_source{k}.tsv").withColumn("src", F.lit(k).cast("byte")) for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, r_id), a row for each matched record; singletons have none."""
    return truth_pairs(read_tsv(spark, path, TRUTH), "source1_entity_id", "matched_entity_ids")


def truth_pairs(df: DataFrame, entity: str, listed: str) -> DataFrame:
    ids = F.explode(F.filter(F.split(F.col(listed), ","), lambda x: x != ""))
    return df.select(F.col(entity).alias("s1_id"), ids.alias("r_id"))


def listed(entities: DataFrame, pairs: DataFrame, entity: str, record: str, name: str = "matched_ids") -> DataFrame:
    """Every entity once, with its distinct record ids sorted as text and comma-joined ('' if none)."""
    lists = pairs.groupBy(entity).agg(F.array_join(F.array_sort(F.collect_set(F.col(record).cast("string"))), ",").alias(name))
    return entities.select(entity).distinct().join(lists, entity, "left").withColumn(name, F.coalesce(name, F.lit("")))


def write_tsv(df: DataFrame, path: str, order: Column | str) -> None:
    df.orderBy(order).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").mode("overwrite").csv(path)


def write_dictionary(df: DataFrame, path: str) -> None:
    """A learned table (transliterations, aliases, log-odds) as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_dictionary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
