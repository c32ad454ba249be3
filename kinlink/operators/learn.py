"""Learned tables and models: alignments, aliases, token log-odds, isotonic maps, grouped cross-fitting and self-training.

Draws and halves use md5, so that other systems can repeat them.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions import similarity as sim
from kinlink.functions.text import INDIC_LETTERS


def modes(counts: DataFrame, key: str, value: str, least: int, share: float = 0.0, total: Column | None = None) -> DataFrame:
    """(key, value, n): the most frequent value (ties: the smaller) of each key with at least `least` counts and share of the total."""
    order = Window.partitionBy(key).orderBy(F.desc("n"), value)
    whole = total if total is not None else F.sum("n").over(Window.partitionBy(key))
    rows = counts.withColumn("__t", whole).withColumn("__rk", F.row_number().over(order))
    return rows.where((F.col("__rk") == 1) & (F.col("n") >= least) & (F.col("n") / F.col("__t") >= share)).select(key, value, "n")


def aligned_tokens(pairs: DataFrame, record: Column, entity: Column, wanted: Column | None = None) -> DataFrame:
    """(token, aligned, n) over pairs of token arrays of one length: which entity token stands in a record token's place."""
    zipped = F.explode(F.arrays_zip(record.alias("token"), entity.alias("aligned")))
    rows = pairs.where(F.size(record) == F.size(entity)).select(zipped.alias("z")).select("z.token", "z.aligned")
    if wanted is not None:
        rows = rows.where(wanted)
    return rows.groupBy("token", "aligned").agg(F.count(F.lit(1)).alias("n"))


def name_dictionary(pairs: DataFrame, record: Column, entity: Column, wanted: Column | None = None) -> DataFrame:
    """Transliterations of name tokens by position: seen twice at least, 30 % of the token's own counts."""
    wanted = F.col("token").rlike(INDIC_LETTERS) if wanted is None else wanted
    return modes(aligned_tokens(pairs, record, entity, wanted), "token", "aligned", 2, 0.3)


def met_components(pairs: DataFrame, record: Column, entity: Column, wanted: Column | None = None) -> DataFrame:
    """(token, aligned, n, seen): each record component beside all distinct entity components; seen counts its own occurrences."""
    rows = pairs.withColumn("__p", F.monotonically_increasing_id()).select("__p", F.posexplode(record).alias("__i", "token"), F.array_distinct(entity).alias("e"))
    if wanted is not None:
        rows = rows.where(wanted)
    seen = rows.groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    return rows.select("token", F.explode("e").alias("aligned")).groupBy("token", "aligned").agg(F.count(F.lit(1)).alias("n")).join(seen, "token")


def component_dictionary(pairs: DataFrame, record: Column, entity: Column, wanted: Column | None = None, least: int = 3, share: float = 0.6) -> DataFrame:
    wanted = F.col("token").rlike(INDIC_LETTERS) if wanted is None else wanted
    return modes(met_components(pairs, record, entity, wanted), "token", "aligned", least, share, F.col("seen"))


def token_dictionary(pairs: DataFrame, record: Column, entity: Column, wanted: Column | None = None) -> DataFrame:
    return component_dictionary(pairs, record, entity, wanted, 3, 0.0)


def aliases(pairs: DataFrame, entity_ac: Column, record_ac: Column, fold: Column, least: int = 3) -> DataFrame:
    """(fold, s1_comp, rec_comp, n): unmatched components of true pairs that meet often, for each fold and (fold -1) over all."""
    rows = pairs.select(fold.alias("fold"), sim.unmatched_of(entity_ac, record_ac).alias("a"), sim.unmatched_of(record_ac, entity_ac).alias("b"))
    met = rows.select("fold", F.explode("a").alias("s1_comp"), "b").select("fold", "s1_comp", F.explode("b").alias("rec_comp"))
    both = met.unionByName(met.withColumn("fold", F.lit(-1).cast(met.schema["fold"].dataType)))
    return both.groupBy("fold", "s1_comp", "rec_comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def token_log_odds(pairs: DataFrame, kinds: dict[str, str], label: str, smoothing: float = 5.0, least: int = 3) -> DataFrame:
    """(kind, token, lo): log-odds of a true pair given the token, less the prior, of tokens in `least` pairs.

    kinds names the array columns, such as extra and missing.
    """
    total = pairs.agg(F.sum(F.col(label).cast("long")).alias("y"), F.count(F.lit(1)).alias("m")).select(F.ln((F.col("y") + 1) / (F.col("m") - F.col("y") + 1))).scalar()
    parts = [pairs.select(F.lit(k).alias("kind"), F.explode(F.array_distinct(c)).alias("token"), F.col(label).cast("long").alias("y")) for k, c in kinds.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = rows.groupBy("kind", "token").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).where(F.col("p") + F.col("n") >= least)
    share = F.exp(total) / (1 + F.exp(total))
    return counts.select("kind", "token", F.round(F.ln((F.col("p") + smoothing * share) / (F.col("n") + smoothing * (1 - share))) - total, 6).alias("lo"))


def add_one_ratio(p: Column, n: Column) -> Column:
    return F.ln((p + 1) / (n + 1))


def pseudo_counts(pairs: DataFrame) -> DataFrame:
    """(kind, token, p, n): without labels, tokens that differ between records of one first core token count as
    positive where the first numbers agree and as negative where they do not, given two shared address words.

    pairs has arrays core1, core2, num1, num2, words1, words2.
    """
    extra, missing = F.array_except("core2", "core1"), F.array_except("core1", "core2")
    shared = F.size(F.array_intersect(*[F.filter(c, lambda t: ~t.rlike("^[0-9]+$")) for c in ("words1", "words2")]))
    first = lambda c: F.get(F.col(c), F.lit(0))
    rows = pairs.where((first("core1") == first("core2")) & (F.size("num1") > 0) & (F.size("num2") > 0) & (shared >= 2))
    rows = rows.select((first("num1") == first("num2")).cast("long").alias("y"), F.explode(F.array(F.struct(F.lit("extra").alias("kind"), extra.alias("t")), F.struct(F.lit("missing").alias("kind"), missing.alias("t")))).alias("k"))
    return rows.select("y", "k.kind", F.explode("k.t").alias("token")).groupBy("kind", "token").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))


def isotonic(points: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    """points with fitted: an increasing map from x to y, weighted by the root of the counts, constant beyond its ends."""
    return fitted_map(points, x, y, weight).setPredictionCol("fitted").transform(points)


def fitted_map(points: DataFrame, x: str, y: str, weight: str) -> IsotonicRegressionModel:
    return IsotonicRegression(featuresCol=x, labelCol=y, weightCol="__w").fit(points.withColumn("__w", F.sqrt(weight)))


def tokens_by_label(pairs: DataFrame) -> DataFrame:
    """(kind, token, p, n): how often true and false pairs of one first core token differ in a token.  pairs has core1, core2 and y."""
    first = lambda c: F.get(F.col(c), F.lit(0))
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_except(a, b).alias("t")) for k, a, b in (("extra", "core2", "core1"), ("missing", "core1", "core2"))])
    rows = pairs.where(first("core1") == first("core2")).select(F.col("y").cast("long").alias("y"), F.explode(parts).alias("k"))
    return rows.select("y", "k.kind", F.explode("k.t").alias("token")).groupBy("kind", "token").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))


def calibration(pseudo: DataFrame, true: DataFrame, least: int = 100) -> DataFrame:
    """(kind, token, x, y, n): pseudo and true add-one log ratios of the tokens that `least` labelled pairs differ in; both have (kind, token, p, n)."""
    known = true.where(F.col("p") + F.col("n") >= least).select("kind", "token", add_one_ratio(F.col("p"), F.col("n")).alias("y"), (F.col("p") + F.col("n")).alias("n"))
    ratio = F.coalesce(add_one_ratio(F.col("p"), F.col("m")), F.lit(0.0))
    return known.join(pseudo.select("kind", "token", "p", F.col("n").alias("m")), ["kind", "token"], "left").select("kind", "token", ratio.alias("x"), "y", "n")


def adapted(table: DataFrame, maps: dict[str, IsotonicRegressionModel], pseudo: DataFrame, least: int = 20) -> DataFrame:
    """(kind, token, lo) for an unseen group: its own pseudo ratios, mapped to true ones, where `least` of its pairs differ in the token, else table's.

    pseudo has (kind, token, p, n) of the group; a kind without a map keeps the table's values.
    """
    own = None
    for kind, model in maps.items():
        points = pseudo.where((F.col("kind") == kind) & (F.col("p") + F.col("n") >= least)).withColumn("x", add_one_ratio(F.col("p"), F.col("n")))
        part = model.setFeaturesCol("x").setPredictionCol("own").transform(points).select("kind", "token", "own")
        own = part if own is None else own.unionByName(part)
    if own is None:
        return table.select("kind", "token", "lo")
    return table.select("kind", "token", "lo").join(own, ["kind", "token"], "full").select("kind", "token", F.coalesce("own", "lo").alias("lo"))


def fold_of(key: Column | str, k: int, seed: int = 0) -> Column:
    """A grouped fold by a stable hash; use another seed for other splits of the same key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int")


def drawn(*keys: Column | str) -> Column:
    """A stable number from 0 to 2 ** 32 - 1 of a key, from the first digits of the md5 of its text."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def in_share(key: Column | str, share: float) -> Column:
    """A stable draw of a share of keys."""
    return drawn(key) < share * (1 << 32)


def easy_negatives_thinned(pairs: DataFrame, label: str, prior: str, key: list[str], keep: float, floor: float = 0.01) -> DataFrame:
    """Positives and pairs of at least `floor`, and a stable share of the others, which weigh 1 / keep."""
    hard = F.col(label).cast("boolean") | (F.col(prior) >= floor)
    return pairs.where(hard | in_share(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), keep)).withColumn("weight", F.when(hard, 1.0).otherwise(1.0 / keep))


def _features(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="keep")


def booster(columns: list[str], label: str, rounds: int = 20, depth: int = 5, rate: float = 0.1, weight: str | None = None, validation: str | None = None, least: int = 1, share: float = 0.7) -> Pipeline:
    """Gradient-boosted trees over columns, with row and column sampling; `least` rows a leaf, `share` of the columns a split."""
    trees = GBTClassifier(featuresCol="__x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.7, featureSubsetStrategy=str(share), minInstancesPerNode=least, seed=7, predictionCol="__y")
    trees = trees.setProbabilityCol("__p").setRawPredictionCol("__raw")
    if weight:
        trees = trees.setWeightCol(weight)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[_features(columns), trees])


def linear(columns: list[str], label: str, weight: str | None = None) -> Pipeline:
    """A regularised logistic pre-ranker."""
    model = LogisticRegression(featuresCol="__x", labelCol=label, regParam=1e-3, maxIter=30, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y")
    return Pipeline(stages=[_features(columns), model.setWeightCol(weight) if weight else model])


def scored(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("__p")[1]).drop("__x", "__raw", "__p", "__y")


def out_of_fold(df: DataFrame, pipeline: Pipeline, fold: str, k: int, name: str = "p", thin=None, validation: str | None = None) -> tuple[DataFrame, list[PipelineModel]]:
    """df with each fold's rows scored by a model of the other folds, and the models.

    thin(rows) leaves the rows, with their weight, that a model learns from.  With `validation`, the name that the
    pipeline has for it, the fold left out says when a model stops.
    """
    models, parts = [], None
    for f in range(k):
        held, rest = df.where(F.col(fold) == f), df.where(F.col(fold) != f)
        rest = thin(rest) if thin else rest
        if validation:
            held_ = held.withColumn("weight", F.lit(1.0)) if thin else held
            rest = rest.withColumn(validation, F.lit(False)).unionByName(held_.withColumn(validation, F.lit(True)))
        model = pipeline.fit(rest)
        models.append(model)
        part = scored(model, held, name)
        parts = part if parts is None else parts.unionByName(part)
    return parts, models


def oof_again(df: DataFrame, models: list[PipelineModel], fold: str, name: str = "p") -> DataFrame:
    """df with each fold's rows scored by that fold's saved model."""
    parts = None
    for f, model in enumerate(models):
        part = scored(model, df.where(F.col(fold) == f), name)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def fold_average(models: list[PipelineModel], df: DataFrame, name: str = "p") -> DataFrame:
    """df with the mean score of several models."""
    out = df
    for i, m in enumerate(models):
        out = scored(m, out, f"__m{i}")
    names = [f"__m{i}" for i in range(len(models))]
    return out.withColumn(name, sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)).drop(*names)


def save_models(models: list[PipelineModel], path: str) -> None:
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/{i}")


def load_models(path: str, k: int) -> list[PipelineModel]:
    return [PipelineModel.load(f"{path}/{i}") for i in range(k)]


def importances(models: list[PipelineModel], columns: list[str]) -> list[tuple[str, float]]:
    """Summed feature importances, largest first."""
    total = [sum(float(m.stages[-1].featureImportances[i]) for m in models) for i in range(len(columns))]
    return sorted(zip(columns, total), key=lambda x: -x[1])


def top_tokens(table: DataFrame, value: str, n: int, kind: str = "kind") -> DataFrame:
    """The n least and n largest tokens of each kind by value, with their place from either end; ties by token."""
    up, down = Window.partitionBy(kind).orderBy(value, "token"), Window.partitionBy(kind).orderBy(F.desc(value), "token")
    ranked = table.withColumns({"from_least": F.row_number().over(up), "from_largest": F.row_number().over(down)})
    return ranked.where((F.col("from_least") <= n) | (F.col("from_largest") <= n))


def pseudo_labelled(df: DataFrame, score: str, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """Confident rows of another group with their own predictions as labels."""
    return df.where((F.col(score) >= high) | (F.col(score) <= low)).withColumn("label", (F.col(score) >= high).cast("double"))


def self_trained(source: DataFrame, target: DataFrame, pipeline: Pipeline, high: float = 0.95, low: float = 0.05, name: str = "p") -> DataFrame:
    """target scored by a model of source (label) and of target's own confident predictions under a model of source alone (source_only)."""
    first = scored(pipeline.fit(source), target.drop("label"), "source_only")
    both = source.unionByName(pseudo_labelled(first, "source_only", high, low).select(*source.columns))
    return scored(pipeline.fit(both), first, name)
