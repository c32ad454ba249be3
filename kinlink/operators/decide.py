"""Decisions over scored pairs: assignment, expected F-beta selection, metrics, sweeps and calibration."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.operators.learn import drawn


def assign(pairs: DataFrame, record: str, score: str, tie: str) -> DataFrame:
    """The best pair of each record, ties by the smaller `tie`."""
    best = Window.partitionBy(record).orderBy(F.desc(score), tie)
    return pairs.withColumn("__rk", F.row_number().over(best)).where("__rk = 1").drop("__rk")


def pmf(chances: str) -> str:
    """SQL of the Poisson-binomial distribution of an array of chances: a place for each count from 0 on."""
    return f"aggregate({chances}, array(1D), (a, p) -> transform(sequence(0, size(a)), s -> coalesce(get(a, s), 0D) * (1 - p) + coalesce(get(a, s - 1), 0D) * p))"


def selected(pairs: DataFrame, entity: str, record: str, chance: str, beta: float = 0.5, most: int = 25, least: float = 1e-4, extra_least: float = 1e-3, digits: int = 9) -> DataFrame:
    """(entity, n_keep, value): how many of an entity's best records to output so that the expected F-beta is largest.

    The `most` best usable chances are candidates; the others of at least extra_least only add to what
    may be missed.  Value 0 records: the chance that nothing matches.  Of equal values (rounded) fewer records.
    """
    order = Window.partitionBy(entity).orderBy(F.desc(chance), record)
    rows = pairs.withColumn("__rk", F.row_number().over(order)).withColumn("__use", (F.col("__rk") <= most) & (F.col(chance) >= least))
    listed = rows.groupBy(entity).agg(
        F.expr(f"transform(array_sort(collect_list(if(__use, struct(__rk, {chance} as q), null))), x -> x.q)").alias("q"),
        F.expr(f"transform(array_sort(collect_list(if(not __use and {chance} >= {extra_least}D, struct(__rk, {chance} as q), null))), x -> x.q)").alias("extra"),
    )
    b2 = beta * beta
    zero = "aggregate(concat(q, extra), 1D, (a, p) -> a * (1 - p))"
    top, rest = pmf("slice(q, 1, k)"), pmf("concat(slice(q, k + 1, size(q)), extra)")
    inner = f"aggregate(sequence(1, k), 0D, (u, s) -> u + z.a[s] * aggregate(sequence(0, size(z.b) - 1), 0D, (v, t) -> v + z.b[t] * {1 + b2}D * s / ({b2}D * (s + t) + k)))"
    more = f"if(size(q) = 0, array(), transform(sequence(1, size(q)), k -> struct(round(transform(array(struct({top} as a, {rest} as b)), z -> {inner})[0], {digits}) as v, -k as k)))"
    best = f"array_max(concat(array(struct(round({zero}, {digits}) as v, 0 as k)), {more}))"
    return listed.withColumn("__best", F.expr(best)).select(entity, F.expr("-__best.k").cast("int").alias("n_keep"), F.col("__best.v").alias("value"))


def f_beta(tp: Column, npred: Column, ntrue: Column, beta: float = 0.5) -> Column:
    """1 where nothing is true and nothing predicted, 0 without a hit, else F-beta."""
    b2 = beta * beta
    p, r = tp / npred, tp / ntrue
    return F.when((npred == 0) & (ntrue == 0), 1.0).when((npred == 0) | (ntrue == 0) | (tp == 0), 0.0).otherwise((1 + b2) * p * r / (b2 * p + r))


def entity_counts(entities: DataFrame, predicted: DataFrame, truth: DataFrame, entity: str, label: str) -> DataFrame:
    """tp, npred and ntrue of every entity, with zeros."""
    made = predicted.groupBy(entity).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.count(F.lit(1)).alias("npred"))
    true = truth.groupBy(entity).agg(F.count(F.lit(1)).alias("ntrue"))
    return entities.select(entity).distinct().join(made, entity, "left").join(true, entity, "left").na.fill(0, ["tp", "npred", "ntrue"])


def macro_f(counts: DataFrame, beta: float = 0.5) -> DataFrame:
    return counts.agg(F.round(F.avg(f_beta(F.col("tp"), F.col("npred"), F.col("ntrue"), beta)), 9).alias("macro_f"))


def threshold_sweep(entities: DataFrame, pairs: DataFrame, truth: DataFrame, entity: str, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """(threshold, macro_f) over all entities: two sums for each threshold in one aggregate by entity, one average for each over all."""
    at = list(enumerate(thresholds))
    hit = F.col(label).cast("long")
    sums = [f for i, t in at for f in (F.sum(F.when(F.col(score) >= t, hit).otherwise(0)).alias(f"tp{i}"), F.sum(F.when(F.col(score) >= t, 1).otherwise(0)).alias(f"npred{i}"))]
    true = truth.groupBy(entity).agg(F.count(F.lit(1)).alias("ntrue"))
    counts = entities.select(entity).distinct().join(true, entity, "left").join(pairs.groupBy(entity).agg(*sums), entity, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    wide = counts.agg(*[F.round(F.avg(f_beta(zero(F.col(f"tp{i}")), zero(F.col(f"npred{i}")), zero(F.col("ntrue")))), 9).alias(f"f{i}") for i, _ in at])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"f{i}").alias("macro_f")) for i, t in at])).alias("r")).select("r.*")


def ceiling(entities: DataFrame, pairs: DataFrame, truth: DataFrame, entity: str, label: str) -> DataFrame:
    """What a perfect matcher over the candidates would reach."""
    return macro_f(entity_counts(entities, pairs.where(F.col(label)), truth, entity, label))


def empty_rate(entities: DataFrame, chosen: DataFrame, entity: str, group: str) -> DataFrame:
    n = chosen.groupBy(entity).agg(F.count(F.lit(1)).alias("npred"))
    return entities.join(n, entity, "left").na.fill(0, ["npred"]).groupBy(group).agg(F.round(F.avg((F.col("npred") == 0).cast("double")), 9).alias("empty_rate"))


def scaled_odds(p: Column, m: float) -> Column:
    return p * m / (p * m + 1 - p)


def match_prior(entities: DataFrame, pairs: DataFrame, entity: str, score: str, target: float, level: float = 0.5, steps: int = 12) -> float:
    """The odds factor in [0.05, 1] at which the share of entities without a pair of at least `level` meets the target.

    A geometric bisection: a step's middle lifts the low end where the share there is above the target, else lowers the
    high end.  A best score falls below the level at a factor m if and only if m is below level (1 - p) / (p (1 - level)), so
    one aggregate counts the entities between all factors that any step can visit, and the steps read its sums.
    1 where the share is high enough already, or without entities.
    """
    best = pairs.groupBy(entity).agg(F.max(score).alias("best"))
    held = entities.select(entity).distinct().join(best, entity, "left").na.fill(0.0, ["best"])
    turn = F.when(F.col("best") > 0, level * (1 - F.col("best")) / (F.col("best") * (1 - level))).otherwise(F.lit(float("inf")))
    # in logarithms the steps' middles are the inner points of 2 ** steps equal parts of [0.05, 1]
    parts, low = 1 << steps, math.log(0.05)
    place = F.when(turn <= 0, 0).otherwise(F.least(F.greatest(F.ceil((F.ln(turn) - low) / -low * parts), F.lit(0)), F.lit(parts + 1)))
    counts = dict(held.groupBy(place.cast("int").alias("place")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(counts.values())
    # entities empty at the factor of point k are those that turn above it
    below = [0]
    for k in range(parts + 1):
        below.append(below[-1] + counts.get(k, 0))
    share = lambda k: (total - below[k + 1]) / total
    if not total or share(parts) >= target:
        return 1.0
    a, b = 0, parts
    for _ in range(steps):
        mid = (a + b) // 2
        a, b = (mid, b) if share(mid) > target else (a, mid)
    return math.exp(low - low * (a + b) / 2 / parts)


def mean_of_present(columns: list[str]) -> Column:
    """The mean of the non-null columns, null if none."""
    return F.expr(f"aggregate(filter(array({', '.join(columns)}), x -> x is not null), named_struct('s', 0D, 'n', 0), (a, x) -> named_struct('s', a.s + x, 'n', a.n + 1), a -> try_divide(a.s, a.n))")


def subsets(names: list[str]) -> list[tuple[str, ...]]:
    return [c for n in range(1, len(names) + 1) for c in combinations(names, n)]


def blend_report(pairs: DataFrame, models: list[str], label: str) -> DataFrame:
    """(models, rmse) of every subset's equal-weight blend, in one aggregate."""
    made = [F.round(F.sqrt(F.avg(F.pow(mean_of_present(list(c)) - F.col(label).cast("double"), 2))), 9).alias("+".join(c)) for c in subsets(models)]
    wide = pairs.agg(*made)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("models"), F.col(f"`{c}`").alias("rmse")) for c in wide.columns])).alias("r")).select("r.*")


def kept(best: DataFrame, entity: str, record: str, score: str, mode: str = "expf", level: float = 0.5) -> DataFrame:
    """The rows of assigned pairs that are output: by `expf` as many of an entity's best as maximise expected F, by `threshold` those of `level`."""
    if mode == "threshold":
        return best.where(F.col(score) >= level)
    order = Window.partitionBy(entity).orderBy(F.desc(score), record)
    counts = selected(best, entity, record, score).select(entity, "n_keep")
    return best.withColumn("__rk", F.row_number().over(order)).join(counts, entity).where("__rk <= n_keep").drop("__rk", "n_keep")


def evaluated(entities: DataFrame, pairs: DataFrame, truth: DataFrame, entity: str, record: str, score: str, label: str) -> DataFrame:
    """(macro_f) of scored pairs: each record at its best entity, then as many as maximise expected F."""
    return macro_f(entity_counts(entities, kept(assign(pairs, record, score, entity), entity, record, score), truth, entity, label))


def blends_compared(entities: DataFrame, pairs: DataFrame, truth: DataFrame, entity: str, record: str, label: str, main: str, others: list[str]) -> DataFrame:
    """(models, macro_f) of the mean of `main` and every subset of the other models' scores, missing ones left out."""
    out = None
    for combo in [(), *subsets(others)]:
        blend = pairs.withColumn("__p", F.round(mean_of_present([main, *combo]), 9))
        made = evaluated(entities, blend, truth, entity, record, "__p", label).select(F.lit("+".join((main, *combo))).alias("models"), "macro_f")
        out = made if out is None else out.unionByName(made)
    return out


def best_blend(compared: DataFrame) -> list[str]:
    """The models of the blend of the largest macro F; of equal ones the fewest."""
    rows = compared.collect()  # a row for each subset
    return max(rows, key=lambda r: (r.macro_f, -r.models.count("+"))).models.split("+")


def error_kinds(pairs: DataFrame, truth: DataFrame, entity: str, record: str, group: str) -> DataFrame:
    """(group, kind, n): hits, false positives and misses of chosen pairs against true ones."""
    both = pairs.select(entity, record, group, F.lit(True).alias("chosen")).join(truth.select(entity, record, F.col(group).alias("__g"), F.lit(True).alias("real")), [entity, record], "full")
    kind = F.when(F.col("chosen") & F.col("real"), "hit").when(F.col("chosen"), "false").otherwise("missed")
    return both.groupBy(F.coalesce(group, "__g").alias(group), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def error_examples(chosen: DataFrame, candidates: DataFrame, truth: DataFrame, entity: str, record: str, score: str, n: int) -> DataFrame:
    """(kind, entity, record, score, true entity, in_candidates): n examples of false positives and of misses, drawn by a stable hash.

    A false positive names the record's true entity (null if it has none); a miss says whether it was among the candidates.
    """
    true = truth.select(F.col(record), F.col(entity).alias("true_entity"))
    seen = candidates.select(entity, record, F.col(score).alias("score"), F.lit(True).alias("seen"))
    false = chosen.select(entity, record).join(truth, [entity, record], "left_anti").join(true, record, "left").withColumn("kind", F.lit("false"))
    missed = truth.select(entity, record).join(chosen, [entity, record], "left_anti").withColumns({"true_entity": F.col(entity), "kind": F.lit("missed")})
    rows = false.unionByName(missed).join(seen, [entity, record], "left")
    draw = Window.partitionBy("kind").orderBy(drawn(entity, record), entity, record)
    rows = rows.select("kind", entity, record, "score", "true_entity", F.coalesce("seen", F.lit(False)).alias("in_candidates"), F.row_number().over(draw).alias("__rk"))
    return rows.where(F.col("__rk") <= n).drop("__rk")


def aligned(union: DataFrame, scored: DataFrame, entity: str, record: str, score: str, name: str) -> DataFrame:
    """union with another candidate set's scores as a column, null where that set lacks the pair."""
    return union.join(scored.select(entity, record, F.col(score).alias(name)), [entity, record], "left")
