"""Sharding by rendezvous hashing, in DataFrame functions only.

Each (record key, shard) pair has a uniform number u from a stable hash; a row goes to the shard with
the smallest -ln(u) / weight.  Adding a shard adds one number a row and leaves the others as they were,
so a row either stays or moves to the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinlink.llm.common import stored

#: Rows that one task numbers at a time; the count of buckets grows with the rows.
ROWS_A_BUCKET = 20_000


def _uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 52 bits of md5(key ':' shard)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a stable text key.  Equal numbers go to the smaller shard.

    Shards of weight 0 get nothing; a null key counts as an empty one.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are at least 0, one of them above")
    key = F.coalesce(key.cast("string"), F.lit(""))
    costs = [F.struct((-F.ln(_uniform(key, s)) / float(w)).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(weights) if w > 0]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["s"]


def _bucket(by: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def assign(df: DataFrame, key: str, weights: list[float], grown: list[float] | None = None, order: list[str] | None = None) -> DataFrame:
    """df with shard, slot (gapless from 0 in each shard) and, where `grown` weights are given, grown_shard.

    Slots are numbered in hash buckets of about ROWS_A_BUCKET rows, which are counted for each
    shard; a running sum over those counts (a few numbers for each bucket) gives their first slots, and
    rows are numbered inside their buckets by `order` (as a rule the key).  A bucket is chosen by the hash of those columns
    and of a number that each row has of its own, so that repeated keys and rows equal in all columns
    spread over buckets as other rows do.  The rows are stored once with that number, so that it is the same wherever it is read.
    Defined cases: null keys are one key; repeated rows each get a slot; an empty table stays empty;
    columns called like the new ones are replaced, and no other name clashes.
    """
    order = order or [key]
    taken = set(df.columns) | {"shard", "slot", "grown_shard"}
    salt, bucket, n, first_, in_ = (next(x for i in range(len(taken) + 1) if (x := f"__{c}{i or ''}") not in taken) for c in ("salt", "bucket", "n", "first", "in"))
    made = {"shard": rendezvous(F.col(f"`{key}`"), weights).cast("int"), salt: F.monotonically_increasing_id()}
    if grown is not None:
        made["grown_shard"] = rendezvous(F.col(f"`{key}`"), grown).cast("int")
    told = stored(df.withColumns(made), "sharded")
    rows = told.count()
    buckets = max(1, -(-rows // (ROWS_A_BUCKET * len(weights))))
    by = [F.col(f"`{c}`") for c in order] + [F.col(salt)]
    at = told.withColumn(bucket, _bucket(by, buckets))
    counts = at.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first_))
    numbered = at.withColumn(in_, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(*by)) - 1)
    return numbered.join(first, ["shard", bucket]).withColumn("slot", (F.col(first_) + F.col(in_)).cast("long")).drop(salt, bucket, first_, in_)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, law `key`.

    Null text: size 1 and the crc32 of no bytes.  Null doc_ids share one key.  Texts of any length count as a whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    done = assign(rows, "doc_id", [1.0] * shards, [1.0] * (shards + 1), ["doc_id", "size", "text_crc32"])
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
