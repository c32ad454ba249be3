"""Context of a scored pair inside its groups: gaps, ranks, seconds, sums and maxima of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _whole(key: str, value: str):
    return Window.partitionBy(key).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def second_best(key: str, value: str) -> Column:
    """The second largest value of a group, ties included; 0 in a group of one."""
    return F.coalesce(F.nth_value(value, 2).over(_whole(key, value)), F.lit(0.0))


def max_of_others(key: str, value: str) -> Column:
    """The largest value of the other rows of the group, 0 without any."""
    top = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value)))
    return F.when(top == 1, second_best(key, value)).otherwise(F.first(value).over(_whole(key, value)))


def sum_of_others(key: str, value: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(v).over(Window.partitionBy(key)) - v


def gap(key: str, value: str) -> Column:
    return F.max(value).over(Window.partitionBy(key)) - F.col(value)


def rank(key: str, value: str) -> Column:
    """1 for the largest; equal values share the smallest rank."""
    return F.rank().over(Window.partitionBy(key).orderBy(F.desc(value)))


def size(key: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(key))


def average_percentile(group: str, value: str) -> Column:
    """The average rank of equal values, ascending, divided by the group's size."""
    up = Window.partitionBy(group).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(group, value))
    return (F.rank().over(up) + (ties - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy(group))


def pair_context(pairs: DataFrame, record: str, entity: str, values: dict[str, str]) -> DataFrame:
    """The 5 context columns of each value (name -> column) and the sizes of both groups."""
    made = {}
    for name, v in values.items():
        made |= {f"{name}_rmax_gap": gap(record, v), f"{name}_rrank": rank(record, v), f"{name}_r2nd": second_best(record, v), f"{name}_s1max_gap": gap(entity, v), f"{name}_s1rank": rank(entity, v)}
    return pairs.withColumns(made | {"r_ncand": size(record), "s1_ncand": size(entity)})


def stage0_context(pairs: DataFrame, record: str, entity: str, values: dict[str, str]) -> DataFrame:
    """The pre-ranker's context: gap and rank in the record's group, gap in the entity's, and sizes."""
    made = {}
    for name, v in values.items():
        made |= {f"{name}_jmax_gap": gap(record, v), f"{name}_jrank": rank(record, v), f"{name}_imax_gap": gap(entity, v)}
    return pairs.withColumns(made | {"j_n": size(record), "i_n": size(entity)})


def reranked(pairs: DataFrame, key: str, old: str, tie: str, absent: int = 99) -> DataFrame:
    """Channel ranks counted again from 0 after rows have gone; absent ones stay absent."""
    order = Window.partitionBy(key, F.col(old) < absent).orderBy(old, tie)
    return pairs.withColumn(old, F.when(F.col(old) < absent, F.row_number().over(order) - 1).otherwise(absent))


def pruned(pairs: DataFrame, key: str, score: str, tie: str, most: int = 10, floor: float = 1e-4) -> DataFrame:
    """The `most` best pairs of each record with at least `floor`."""
    best = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return pairs.withColumn("__rk", F.row_number().over(best)).where((F.col("__rk") <= most) & (F.col(score) >= floor)).drop("__rk")


def prune_sweep(pairs: DataFrame, key: str, score: str, label: str, tie: str, tops: list[int], floors: list[float]) -> DataFrame:
    """(top, floor, kept, hits) for every setting, from one ranking and one aggregate of conditional sums."""
    best = Window.partitionBy(key).orderBy(F.desc(score), tie)
    settings = list(enumerate((m, f) for m in tops for f in floors))
    keep = lambda m, f: (F.col("__rk") <= m) & (F.col(score) >= f)
    sums = [x for i, (m, f) in settings for x in (F.sum(keep(m, f).cast("long")).alias(f"kept{i}"), F.sum((keep(m, f) & F.col(label)).cast("long")).alias(f"hits{i}"))]
    wide = pairs.withColumn("__rk", F.row_number().over(best)).agg(*sums)
    rows = [F.struct(F.lit(m).alias("top"), F.lit(f).alias("floor"), F.col(f"kept{i}").alias("kept"), F.col(f"hits{i}").alias("hits")) for i, (m, f) in settings]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def collective(pairs: DataFrame, strong: float = 0.5) -> DataFrame:
    """The second pass's eleven columns of pairs (r_id, s1_id, p, src3) from first-pass scores."""
    hit = (F.col("p") >= strong).cast("int")
    made = {
        "p1": F.col("p"), "p1_r_other_max": max_of_others("r_id", "p"), "p1_r_rank": rank("r_id", "p"), "p1_r_sum": F.sum("p").over(Window.partitionBy("r_id")),
        "p1_a_sum_excl": sum_of_others("s1_id", "p"), "p1_a_nstrong_excl": sum_of_others("s1_id", hit),
        "p1_a_nstrong_s3_excl": F.sum(hit * F.col("src3")).over(Window.partitionBy("s1_id")) - hit * F.col("src3"),
        "p1_a_nstrong_s2_excl": F.sum(hit * (1 - F.col("src3"))).over(Window.partitionBy("s1_id")) - hit * (1 - F.col("src3")),
        "p1_a_max_excl": max_of_others("s1_id", "p"), "p1_a_rank": rank("s1_id", "p"),
    }
    return pairs.withColumns(made).withColumn("p1_r_margin", F.col("p1") - F.col("p1_r_other_max"))


def sibling_pairs(pairs: DataFrame, strong: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """(s1_id, r_id, rs_id, ps) and `keep`: each pair's record beside the other records of its entity that score `strong` at least."""
    held = pairs.where(F.col("p") >= strong).select("s1_id", F.col("r_id").alias("rs_id"), F.col("p").alias("ps"))
    return pairs.select(*(keep or []), "s1_id", "r_id").join(held, "s1_id").where("r_id <> rs_id")


def siblings(pairs: DataFrame, similarity: DataFrame, name: str, strong: float = 0.5) -> DataFrame:
    """max, mean and score-weighted max of a pair's record's similarity to the entity's other strong records, the largest max
    of the record's other pairs, and the number of those records.

    similarity has (r_id, rs_id, sim); missing pairs count as 0.
    """
    met = sibling_pairs(pairs, strong).join(similarity, ["r_id", "rs_id"], "left")
    return sibling_columns(pairs, met.withColumn("sim", F.coalesce("sim", F.lit(0.0))), {name: "sim"})


def sibling_columns(pairs: DataFrame, met: DataFrame, similarities: dict[str, str]) -> DataFrame:
    """pairs with the columns of siblings() for each name; met has (s1_id, r_id, ps) and the similarities' columns."""
    made = [f(x).alias(f"sib_{n}_{k}") for n, c in similarities.items() for k, f, x in (("smax", F.max, F.col(c)), ("smean", F.avg, F.col(c)), ("swmax", F.max, F.col(c) * F.col("ps")))]
    sums = met.groupBy("s1_id", "r_id").agg(*made, F.count(F.lit(1)).alias("sib_n"))
    out = pairs.join(sums, ["s1_id", "r_id"], "left").na.fill(0, [c for c in sums.columns if c.startswith("sib_")])
    return out.withColumns({f"sib_{n}_rival_max": max_of_others("r_id", f"sib_{n}_smax") for n in similarities})
