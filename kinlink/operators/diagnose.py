"""Checks of a linkage run under shift: scores by group, dropped entities, overridden tables, compared rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.operators import decide, learn, windows


def scores_by_group(entities: DataFrame, chosen: DataFrame, truth: DataFrame, entity: str, label: str, group: str) -> DataFrame:
    """(group, n, macro_f): macro F-beta of each group of entities, those without any pair included."""
    counts = decide.entity_counts(entities, chosen, truth, entity, label).join(entities.select(entity, group).distinct(), entity)
    f = decide.f_beta(F.col("tp"), F.col("npred"), F.col("ntrue"))
    return counts.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(f), 9).alias("macro_f"))


def shifted(pairs: DataFrame, entity: str, record: str, values: dict[str, str], share: float, ranks: list[str] | None = None) -> DataFrame:
    """What remains when a stable share of the entities was never there: pairs, ranks and context are made anew."""
    held = pairs.where(~learn.in_share(F.col(entity), share))
    for r in ranks or []:
        held = windows.reranked(held, record, r, entity)
    return windows.pair_context(held, record, entity, values)


def rules_compared(entities: DataFrame, pairs: DataFrame, truth: DataFrame, entity: str, record: str, score: str, label: str, thresholds: list[float], odds: list[float]) -> DataFrame:
    """(rule, macro_f) of thresholds and of expected-F selection at several odds factors, over assigned pairs."""
    best = decide.assign(pairs, record, score, entity)
    out = decide.threshold_sweep(entities, best, truth, entity, score, label, thresholds).select(F.concat(F.lit("threshold "), F.col("threshold").cast("string")).alias("rule"), "macro_f")
    for m in odds:
        scaled = best.withColumn(score, F.round(decide.scaled_odds(F.col(score), m), 9))
        made = decide.macro_f(decide.entity_counts(entities, decide.kept(scaled, entity, record, score), truth, entity, label))
        out = out.unionByName(made.select(F.lit(f"expected f, odds {m}").alias("rule"), "macro_f"))
    return out


def unseen_groups(known: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """The groups of new that known lacks."""
    return new.select(group).distinct().join(known.select(group).distinct(), group, "left_anti")


def overridden(table: DataFrame, own: DataFrame, support: Column, least: int = 20) -> DataFrame:
    """(group, token, lo): a group's own value where its support is large enough, else the common one (0 if unknown).

    table has (token, lo), own (group, token, lo and what support reads).
    """
    mine = own.where(support >= least).select("group", "token", F.col("lo").alias("own"))
    every = own.select("group", "token").distinct().join(table.select("token", "lo"), "token", "left")
    return every.join(mine, ["group", "token"], "left").select("group", "token", F.coalesce("own", "lo", F.lit(0.0)).alias("lo"))
