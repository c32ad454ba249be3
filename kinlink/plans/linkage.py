"""A whole linkage run: normalise, block, prune, featurise, score out of fold, score again collectively, decide, list.

Each step is a function of DataFrames.  train() and predict() keep the tables that later steps read more than once as
Parquet below a folder, which also ends their lineage; what predict() needs of train() can be saved and loaded.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions import text
from kinlink.operators import blocking, decide, diagnose, features, learn, windows
from kinlink.sources import tables

SIDE = ["nf", "nc", "na", "nw", "nl", "nflag", "at", "an", "ast", "ac"]


@dataclass
class Settings:
    """Sizes of a run.  Channel sizes, caps and pruning are those of a national register; small tables need smaller caps.

    A line is a pair of models, of both passes, over its own candidates: `keyed` ones have the key channel's pairs.  The first
    is the main one; the blend of it and those others that reach the largest expected F out of fold decides.
    """

    channels: dict[str, int] = field(default_factory=lambda: {"comb": 30, "name": 15, "addr": 10, "rev": 10})
    name_cap: int = 20_000
    addr_cap: int = 5_000
    name_weight: float = 0.6
    top: int = 10
    floor: float = 1e-4
    key_freq: int = 50
    key_cos: float = 0.3
    key_top: int = 2
    folds: int = 4
    rounds: int = 30
    depth: int = 5
    neg_keep: float = 1.0
    hard_p0: float = 0.01
    mode: str = "expf"
    level: float = 0.5
    lines: dict[str, dict] = field(default_factory=lambda: {"n": {"keyed": True}})


#: Companion lines of a national register: the same candidates as the main line has without the key channel, and deeper trees with smaller steps.
COMPANIONS = {"t": {"keyed": False}, "tb": {"keyed": False, "rounds": 60, "depth": 7, "rate": 0.05, "least": 50, "share": 0.6}}


def dictionaries(raw: DataFrame, truth: DataFrame) -> DataFrame:
    """(field, kind, token, aligned): readings of Indic name words, address parts and address words, learned from true pairs."""
    side = lambda key, k: raw.select(F.col("entity_id").alias(key), text.cleaned(F.lower("business_name")).alias(f"n{k}"), text.cleaned(F.lower("business_address")).alias(f"a{k}"))
    true = truth.join(side("s1_id", 1), "s1_id").join(side("r_id", 2), "r_id")
    words = lambda c: F.regexp_extract_all(c, F.lit(text.INDIC_WORD), 1)
    commas = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x))
    parts = [
        ("name", "w", learn.name_dictionary(true, words(F.col("n2")), words(F.col("n1")))),
        ("addr", "c", learn.component_dictionary(true, commas(F.col("a2")), commas(F.col("a1")))),
        ("addr", "w", learn.token_dictionary(true, words(F.col("a2")), words(F.col("a1")))),
    ]
    out = None
    for field_, kind, table in parts:
        part = table.select(F.lit(field_).alias("field"), F.lit(kind).alias("kind"), "token", "aligned")
        out = part if out is None else out.unionByName(part)
    return out


def with_readings(raw: DataFrame, known: DataFrame) -> DataFrame:
    """raw with name_read and addr_read: what the dictionaries have for each record's Indic words and parts, however large they are."""
    out = raw
    for field_, column in (("name", "business_name"), ("addr", "business_address")):
        tokens = raw.where(F.col(column).rlike(text.INDIC_LETTERS)).select("entity_id", F.explode(text.indic_tokens(text.cleaned(F.lower(column)), field_ == "addr")).alias("x")).select("entity_id", "x.*")
        found = tokens.join(known.where(F.col("field") == field_), ["kind", "token"]).groupBy("entity_id").agg(F.collect_set(F.concat_ws("\t", "kind", "token", "aligned")).alias(f"{field_}_read"))
        out = out.join(found, "entity_id", "left")
    return out


def normalise(raw: DataFrame, drop_locality: bool = True, country_token: bool = True) -> DataFrame:
    """entity_id, country, src and the normalised fields of raw records, with readings if they have them."""
    read = {f: text.indic_words(F.col(f"{f}_read") if f"{f}_read" in raw.columns else None) for f in ("name", "addr")}
    name = text.name(F.col("business_name"), country_token, lambda c: read["name"](F.lower(c)))
    addr = text.address(F.col("business_address"), F.col("country"), drop_locality, lambda c: read["addr"](F.lower(c)))
    return raw.select("entity_id", "country", "src", name.alias("n"), addr.alias("a")).select("entity_id", "country", "src", "n.*", "a.*")


def vectors(norm: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Posting tables of names, addresses and both, fitted over all sources of each country."""
    rows = norm.select(F.col("country").alias("grp"), F.col("entity_id").alias("id"), "src", "nc", "at")
    name, addr = blocking.postings(rows, blocking.char_grams(F.col("nc")), 2), blocking.postings(rows, blocking.word_grams(F.col("at")), 1)
    return {"name": name, "addr": addr, "comb": blocking.combined(name, addr, s.name_weight)}


def candidates(vec: dict[str, DataFrame], s: Settings, keep=lambda df, name: df) -> DataFrame:
    """Pairs (grp, j, i1) of any channel with ranks and exact cosines of names, addresses and both.

    Names and addresses lose their frequent features, each by its own cap, before they are combined.  keep(df, name)
    stores tables that are read more than once: the cosines of both are ranked in either direction.
    """
    kept = {"name": keep(blocking.capped(vec["name"], s.name_cap), "capped_name"), "addr": keep(blocking.capped(vec["addr"], s.addr_cap), "capped_addr")}
    kept["comb"] = blocking.combined(kept["name"], kept["addr"], s.name_weight)
    both = keep(blocking.cosines(blocking.others(kept["comb"]), blocking.entities(kept["comb"])), "cosines")
    found = {"comb": blocking.ranked(both, "j", "i1", s.channels["comb"])}
    found |= {k: blocking.topk(blocking.others(kept[k]), blocking.entities(kept[k]), s.channels[k]) for k in ("name", "addr")}
    found["rev"] = blocking.ranked(both, "i1", "j", s.channels["rev"])
    pairs = keep(blocking.channel_union(found).drop(*[f"cos_{k}" for k in found]), "union")
    for k, v in vec.items():
        pairs = blocking.exact_cosine(pairs, blocking.others(v), blocking.entities(v), f"cos_{k}")
    return pairs


def key_candidates(norm: DataFrame, vec: dict[str, DataFrame], known: DataFrame, s: Settings) -> DataFrame:
    """New pairs that share number, locality and first name token, the best by name cosine; ranks absent, p0 null."""
    rows = norm.select(F.col("country").alias("grp"), F.col("entity_id").alias("id"), "src", "an", "at", "nc")
    numbers = features.words(F.col("an"))
    locality = F.explode_outer(F.filter(features.words(F.col("at")), lambda t: ~t.rlike("^[0-9]+$") & ~t.startswith("s_") & (F.length(t) > 2)))
    split = rows.withColumn("loc", locality).withColumn("tok", F.get(features.words(F.col("nc")), F.lit(0))).withColumn("num", numbers)
    side = lambda df, first: blocking.keys(df, F.col("num"), F.coalesce("loc", F.lit("")), F.coalesce("tok", F.lit("")), first)
    pairs = blocking.key_pairs(side(split.where("src > 1"), True), side(split.where("src = 1"), False), s.key_freq)
    for k in ("name", "addr", "comb"):
        pairs = blocking.exact_cosine(pairs, blocking.others(vec[k]), blocking.entities(vec[k]), f"cos_{k}")
        if k == "name":
            pairs = blocking.ranked(pairs.withColumn("cos", F.col("cos_name")).where(F.col("cos") >= s.key_cos), "j", "i1", s.key_top).drop("cos", "rk")
    fresh = blocking.new_pairs(pairs, known)
    return fresh.withColumns({f"rk_{k}": F.lit(blocking.ABSENT) for k in s.channels}).withColumn("p0", F.lit(None).cast("double"))


def stage0_features(pairs: DataFrame, norm: DataFrame) -> tuple[DataFrame, list[str]]:
    """The pre-ranker's 23 columns, and their names."""
    values = {k: f"cos_{k}" for k in ("comb", "name", "addr")}
    out = windows.stage0_context(pairs, "j", "i1", {v: v for v in values.values()})
    entities = norm.where("src = 1")
    freq = entities.groupBy("country", "nc").agg(F.count(F.lit(1)).alias("f"))
    one = entities.join(freq, ["country", "nc"]).select(F.col("entity_id").alias("i1"), F.length("nc").alias("s1_name_len"), F.col("f").alias("s1_name_freq"))
    two = norm.where("src > 1").join(freq, ["country", "nc"], "left").select(F.col("entity_id").alias("j"), (F.col("at") == "").cast("int").alias("r_addr_empty"), F.length("nc").alias("r_name_len"), F.coalesce("f", F.lit(0)).alias("r_name_freq_s1"))
    out = out.join(one, "i1").join(two, "j")
    names = [c for c in out.columns if c not in ("grp", "j", "i1", "y", "fold", "p0", "label")]
    return out, names


def pair_features(pairs: DataFrame, norm: DataFrame, raw: DataFrame) -> DataFrame:
    """pairs (j, i1, p0, cosines, ranks) with context, frequency, overlap, string, number, format, raw pair and raw token features;
    grp, extra, missing, loc_left and loc_right are for the learned tables."""
    out = windows.pair_context(pairs, "j", "i1", {v: v for v in ("cos_comb", "cos_name", "cos_addr")})
    rows = norm.join(raw.select("entity_id", F.col("business_name").alias("rn"), F.col("business_address").alias("ra")), "entity_id")
    side = lambda k, key: rows.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}{k}") for c in [*SIDE, "rn", "ra"]])
    out = out.join(side(1, "i1"), "i1").join(side(2, "j"), "j")
    out = out.join(frequencies(pairs, norm), ["j", "i1"]).join(overlaps(pairs, norm), ["j", "i1"])
    col = lambda c, k: F.col(f"{c}{k}")
    made = features.strings(*[{c: col(c, k) for c in SIDE} for k in (1, 2)])
    made |= features.number_relations(col("an", 1), col("an", 2))
    made |= text.raw_format(col("rn", 2), col("ra", 2))
    made |= features.raw_pair(col("rn", 1), col("ra", 1), col("rn", 2), col("ra", 2))
    made |= features.raw_token(col("rn", 1), col("ra", 1), col("rn", 2), col("ra", 2))
    made |= features.locality(col("ac", 1), col("ac", 2))
    extra, missing = features.token_difference(col("nc", 1), col("nc", 2))
    out = out.withColumns(made | {"extra": extra, "missing": missing, "src3": F.col("j").startswith("S3-").cast("int")})
    # a pair of the key channel has no first score: -1, which trees can split off
    return out.withColumn("p0", F.coalesce("p0", F.lit(-1.0))).drop(*[f"{c}{k}" for c in [*SIDE, "rn", "ra"] for k in (1, 2)])


def frequencies(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """(j, i1) with how often names and addresses occur among entities and all records, and the share of unknown name tokens."""
    one, two = norm.where("src = 1"), norm.where("src > 1")
    n = norm.groupBy("country", "nc").agg(F.sum((F.col("src") == 1).cast("long")).alias("n1"), F.count(F.lit(1)).alias("n"))
    a = one.groupBy("country", "at").agg(F.count(F.lit(1)).alias("a1"))
    known = one.select("country", F.explode(F.array_distinct(features.words(F.col("nc")))).alias("t")).distinct().withColumn("known", F.lit(1))
    oov = two.select("entity_id", "country", F.explode(features.words(F.col("nc"))).alias("t")).join(known, ["country", "t"], "left").groupBy("entity_id").agg(F.avg(F.col("known").isNull().cast("double")).alias("r_name_oov"))
    counted = lambda df: df.join(n, ["country", "nc"]).join(a, ["country", "at"], "left").na.fill(0, ["a1"])
    left = counted(one).select(F.col("entity_id").alias("i1"), F.col("n1").alias("s1_name_freq"), F.col("a1").alias("s1_addr_freq"))
    right = counted(two).join(oov, "entity_id", "left").select(F.col("entity_id").alias("j"), F.col("n1").alias("r_name_freq_s1"), F.col("n").alias("r_name_freq_all"), F.col("a1").alias("r_addr_freq_s1"), F.coalesce("r_name_oov", F.lit(0.0)).alias("r_name_oov"))
    return pairs.select("j", "i1").join(left, "i1").join(right, "j")


def overlaps(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """(j, i1) with the weighted overlaps of name tokens (on_) and address tokens (oa_)."""
    out = pairs.select("j", "i1")
    for p, c in (("on", "nc"), ("oa", "at")):
        out = blocking.overlap(out, blocking.idf_sets(norm.select(F.col("country").alias("grp"), F.col("entity_id").alias("id"), c), features.words(F.col(c))), p)
    return out


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with y (and label, the same as a number); a record without a true entity has only false pairs."""
    real = truth.select(F.col("r_id").alias("j"), F.col("s1_id").alias("__t"))
    out = pairs.join(real, "j", "left").withColumn("y", F.coalesce(F.col("__t") == F.col("i1"), F.lit(False))).drop("__t")
    return out.withColumn("label", F.col("y").cast("double"))


def decided(scored: DataFrame, s: Settings | None = None, name: str = "p") -> DataFrame:
    """(s1_id, r_id, p): each record at its best entity, each entity with as many of them as maximise expected F, or those of a level."""
    s = s or Settings()
    best = decide.assign(scored.select(F.col("i1").alias("s1_id"), F.col("j").alias("r_id"), F.col(name).alias("p")), "r_id", "p", "s1_id")
    return decide.kept(best, "s1_id", "r_id", "p", s.mode, s.level).select("s1_id", "r_id", "p")


@dataclass
class Line:
    """The models of both passes, one for each fold."""

    first: list[PipelineModel]
    second: list[PipelineModel]


@dataclass
class Trained:
    """What scoring unlabelled sources needs."""

    settings: Settings
    readings: DataFrame
    ranker: PipelineModel
    log_odds: DataFrame
    aliases: DataFrame
    maps: dict[str, IsotonicRegressionModel]
    groups: DataFrame
    lines: dict[str, Line]
    blend: list[str]

    def save(self, path: str) -> None:
        spark = self.readings.sparkSession
        about = {"settings": asdict(self.settings), "blend": self.blend, "lines": {k: len(v.first) for k, v in self.lines.items()}, "maps": sorted(self.maps)}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        for name in ("readings", "log_odds", "aliases", "groups"):
            tables.write_dictionary(getattr(self, name), f"{path}/{name}")
        learn.save_models([self.ranker], f"{path}/ranker")
        for kind, model in self.maps.items():
            model.write().overwrite().save(f"{path}/maps/{kind}")
        for k, line in self.lines.items():
            learn.save_models(line.first, f"{path}/{k}/first")
            learn.save_models(line.second, f"{path}/{k}/second")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trained:
        about = json.loads(spark.read.text(f"{path}/about").head()[0])
        read = lambda name, schema: tables.read_dictionary(spark, f"{path}/{name}", schema)
        lines = {k: Line(learn.load_models(f"{path}/{k}/first", n), learn.load_models(f"{path}/{k}/second", n)) for k, n in about["lines"].items()}
        return cls(
            Settings(**about["settings"]), read("readings", "field string, kind string, token string, aligned string"), learn.load_models(f"{path}/ranker", 1)[0],
            read("log_odds", "kind string, token string, lo double"), read("aliases", "fold int, s1_comp string, rec_comp string, n long"),
            {k: IsotonicRegressionModel.load(f"{path}/maps/{k}") for k in about["maps"]}, read("groups", "country string"), lines, about["blend"],
        )


class _Work:
    """Tables of a run, kept below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")


@dataclass
class _Blocked:
    """The representations of a run's records, their vectors and all raw candidates."""

    block: DataFrame
    norm: DataFrame
    stage0: DataFrame
    vec: dict[str, DataFrame]
    pairs: DataFrame


def _blocked(raw: DataFrame, s: Settings, work: _Work) -> _Blocked:
    block = work.keep(normalise(raw, False, False), "norm_block")
    norm = work.keep(normalise(raw, True, True), "norm")
    vec = {k: work.keep(v, f"vec_{k}") for k, v in vectors(block, s).items()}
    pairs = work.keep(candidates(vec, s, work.keep), "cand_raw")
    return _Blocked(block, norm, work.keep(normalise(raw, True, False), "norm_s0"), vec, pairs)


def _pruned(scored: DataFrame, b: _Blocked, s: Settings, work: _Work) -> DataFrame:
    """The best candidates of each record by p0 and the key channel's new ones, which keyed tells apart."""
    cand = work.keep(windows.pruned(scored.select(*b.pairs.columns, "p0"), "j", "p0", "i1", s.top, s.floor), "cand")
    new = key_candidates(b.block, b.vec, cand, s).select(*cand.columns)
    return work.keep(cand.withColumn("keyed", F.lit(False)).unionByName(new.withColumn("keyed", F.lit(True))), "cand_key")


#: Columns that are no features.
_ABOUT = ("grp", "j", "i1", "y", "label", "fold", "half", "keyed")


def columns_of(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if c not in _ABOUT and not c.startswith("p_") and t not in ("string", "array<string>")]


def _collective(first: DataFrame, vec: dict[str, DataFrame]) -> DataFrame:
    """first (with p and src3) with the second pass's 24 columns in place of p."""
    own = first.select("grp", F.col("j").alias("r_id"), F.col("i1").alias("s1_id"), "p", "src3")
    made = windows.collective(own)
    met = windows.sibling_pairs(own, keep=["grp"])
    alike = met.select("grp", F.col("r_id").alias("j"), F.col("rs_id").alias("i1")).distinct()
    for k, v in vec.items():
        alike = blocking.exact_cosine(alike, blocking.others(v), blocking.others(v), f"sim_{k}")
    met = met.join(alike.select(F.col("j").alias("r_id"), F.col("i1").alias("rs_id"), *[f"sim_{k}" for k in vec]), ["r_id", "rs_id"])
    made = windows.sibling_columns(made, met, {k: f"sim_{k}" for k in vec}).drop("p", "src3", "grp")
    return first.drop("p").join(made.withColumnsRenamed({"r_id": "j", "s1_id": "i1"}), ["j", "i1"])


def _lined(line: dict, s: Settings, columns: list[str]):
    """The pipeline of a line's pass."""
    return learn.booster(columns, "label", line.get("rounds", s.rounds), line.get("depth", s.depth), line.get("rate", 0.1), "weight" if s.neg_keep < 1 else None, "held", line.get("least", 1), line.get("share", 0.7))


def _trained_line(name: str, full: DataFrame, b: _Blocked, s: Settings, work: _Work) -> tuple[DataFrame, Line]:
    """(j, i1, p_<name>) out of fold after both passes, and the models."""
    line = s.lines[name]
    rows = full if line.get("keyed") else full.where("not keyed")
    thin = (lambda df: learn.easy_negatives_thinned(df, "label", "p0", ["j", "i1"], s.neg_keep, s.hard_p0)) if s.neg_keep < 1 else None
    one, first = learn.out_of_fold(rows, _lined(line, s, columns_of(rows)), "fold", s.folds, "p", thin, "held")
    both = work.keep(_collective(work.keep(one, f"pass1_{name}"), b.vec), f"features2_{name}")
    two, second = learn.out_of_fold(both, _lined(line, s, columns_of(both)), "fold", s.folds, f"p_{name}", thin, "held")
    return work.keep(two.select("j", "i1", f"p_{name}"), f"pass2_{name}"), Line(first, second)


def train(raw: DataFrame, truth: DataFrame, path: str, s: Settings | None = None) -> tuple[DataFrame, Trained]:
    """Out-of-fold matches (s1_id, r_id, p) of labelled sources, and what predict() needs."""
    s, work = s or Settings(), _Work(raw.sparkSession, path)
    readings = work.keep(dictionaries(raw, truth), "readings")
    raw = work.keep(with_readings(raw, readings), "raw")
    b = _blocked(raw, s, work)
    ready, names = stage0_features(labelled(b.pairs, truth), b.stage0)
    ready = work.keep(ready.withColumn("fold", learn.fold_of("i1", 2, seed=1)), "stage0")
    scored, _ = learn.out_of_fold(ready, learn.linear(names, "label"), "fold", 2, "p0")
    ranker = learn.linear(names, "label").fit(ready)
    cand = _pruned(scored, b, s, work)
    base = work.keep(labelled(pair_features(cand, b.norm, raw), truth).withColumn("half", learn.fold_of("i1", 2, seed=2)), "features0")
    # tables that are learned from labels serve a training pair from the other half of the entities, new pairs from all
    kinds, key = {"extra": "extra", "missing": "missing"}, ["j", "i1"]
    ac = b.norm.select("entity_id", "ac")
    true = truth.join(ac.withColumnsRenamed({"entity_id": "s1_id", "ac": "ac1"}), "s1_id").join(ac.withColumnsRenamed({"entity_id": "r_id", "ac": "ac2"}), "r_id")
    aliases = work.keep(learn.aliases(true, F.col("ac1"), F.col("ac2"), learn.fold_of("s1_id", 2, seed=2)), "aliases")
    full = None
    for h in (0, 1):
        part = features.log_odds_features(base.where(F.col("half") == h), learn.token_log_odds(base.where(F.col("half") != h), kinds, "y"), key)
        part = features.locality_features(part, aliases.where(F.col("fold") == 1 - h), key)
        full = part if full is None else full.unionByName(part)
    log_odds = work.keep(learn.token_log_odds(base, kinds, "y"), "log_odds")
    full = work.keep(full.drop("extra", "missing").withColumn("fold", learn.fold_of("i1", s.folds)), "features")
    # the map from pseudo to true ratios of tokens, for groups without labels
    tokens = differing(labelled(cand, truth), b.norm)
    points = work.keep(learn.calibration(learn.pseudo_counts(tokens), learn.tokens_by_label(tokens)), "calibration")
    maps = {k: learn.fitted_map(points.where(F.col("kind") == k), "x", "y", "n") for k in kinds if not points.where(F.col("kind") == k).isEmpty()}
    lines, out = {}, full.select("j", "i1", "y")
    for name in s.lines:
        made, lines[name] = _trained_line(name, full, b, s, work)
        out = decide.aligned(out, made, "i1", "j", f"p_{name}", f"p_{name}")
    out = work.keep(out, "scores")
    models, entities = [f"p_{n}" for n in s.lines], b.norm.where("src = 1").select(F.col("entity_id").alias("s1_id"))
    pairs = out.withColumnsRenamed({"i1": "s1_id", "j": "r_id"})
    blend = decide.best_blend(decide.blends_compared(entities, pairs, truth, "s1_id", "r_id", "y", models[0], models[1:])) if len(models) > 1 else models
    matches = decided(out.withColumn("p", decide.mean_of_present(blend)), s)
    groups = work.keep(raw.select("country").distinct(), "groups")
    return matches, Trained(s, readings, ranker, log_odds, aliases, maps, groups, lines, blend)


def differing(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """pairs (j, i1) with the arrays core, num and words of both records, as learn.pseudo_counts reads them."""
    side = lambda key, k: norm.select(F.col("entity_id").alias(key), *[features.words(F.col(c)).alias(f"{n}{k}") for n, c in (("core", "nc"), ("num", "an"), ("words", "at"))])
    return pairs.join(side("i1", 1), "i1").join(side("j", 2), "j")


def adapted_log_odds(trained: Trained, cand: DataFrame, norm: DataFrame) -> dict[str, DataFrame]:
    """(kind, token, lo) for each country that training did not have, from that country's own candidates; '' has the common table."""
    # a row for each country at most
    unseen = [r.country for r in diagnose.unseen_groups(trained.groups, norm, "country").collect()]
    out = {"": trained.log_odds}
    for c in sorted(unseen):
        own = learn.pseudo_counts(differing(cand.where(F.col("grp") == c), norm))
        out[c] = learn.adapted(trained.log_odds, trained.maps, own)
    return out


def _scored_line(name: str, full: DataFrame, b: _Blocked, trained: Trained, work: _Work) -> DataFrame:
    line = trained.lines[name]
    rows = full if trained.settings.lines[name].get("keyed") else full.where("not keyed")
    one = work.keep(learn.fold_average(line.first, rows), f"pass1_{name}")
    both = work.keep(_collective(one, b.vec), f"features2_{name}")
    return work.keep(learn.fold_average(line.second, both, f"p_{name}").select("j", "i1", f"p_{name}"), f"pass2_{name}")


def predict(raw: DataFrame, trained: Trained, path: str) -> tuple[DataFrame, DataFrame]:
    """Matches (s1_id, r_id, p) of unlabelled sources, and the candidates (j, i1) that were scored."""
    work, s = _Work(raw.sparkSession, path), trained.settings
    raw = work.keep(with_readings(raw, trained.readings), "raw")
    b = _blocked(raw, s, work)
    ready, _ = stage0_features(b.pairs, b.stage0)
    cand = _pruned(learn.scored(trained.ranker, ready, "p0"), b, s, work)
    base = work.keep(pair_features(cand, b.norm, raw), "features0")
    key, full = ["j", "i1"], None
    tables_ = adapted_log_odds(trained, cand, b.norm)
    for c, table in tables_.items():
        rows = base.where(F.col("grp") == c) if c else base.where(~F.col("grp").isin(*tables_))
        part = features.log_odds_features(rows, table, key)
        full = part if full is None else full.unionByName(part)
    full = features.locality_features(full, trained.aliases.where("fold = -1"), key)
    full = work.keep(full.drop("extra", "missing"), "features")
    out = full.select("j", "i1")
    for name in s.lines:
        if f"p_{name}" in trained.blend:
            out = decide.aligned(out, _scored_line(name, full, b, trained, work), "i1", "j", f"p_{name}", f"p_{name}")
    scored = work.keep(out.withColumn("p", decide.mean_of_present(trained.blend)), "scores")
    return decided(scored, s), cand.select("j", "i1")


def rescored_without(full: DataFrame, truth: DataFrame, trained: Trained, vec: dict[str, DataFrame], share: float, name: str | None = None) -> DataFrame:
    """(s1_id, r_id, p, y) of a line's training features when a stable share of the entities was never there.

    Context is made anew among the rest, both passes are scored again by the folds' saved models.
    """
    name = name or next(iter(trained.lines))
    line, values = trained.lines[name], ("cos_comb", "cos_name", "cos_addr")
    rows = full if trained.settings.lines[name].get("keyed") else full.where("not keyed")
    made = [c for k in values for c in (f"{k}_rmax_gap", f"{k}_rrank", f"{k}_r2nd", f"{k}_s1max_gap", f"{k}_s1rank")] + ["r_ncand", "s1_ncand"]
    rows = windows.pair_context(rows.where(~learn.in_share("i1", share)).drop(*made), "j", "i1", {v: v for v in values})
    both = _collective(learn.oof_again(rows, line.first, "fold"), vec)
    two = learn.oof_again(both, line.second, "fold")
    return two.select(F.col("i1").alias("s1_id"), F.col("j").alias("r_id"), "p", "y")


def candidates_without(pairs: DataFrame, norm0: DataFrame, ranker: PipelineModel, share: float, s: Settings) -> DataFrame:
    """The pruned candidates when a stable share of the entities was never there: records' channel ranks counted again, scored and pruned again."""
    held = pairs.where(~learn.in_share("i1", share))
    for r in ("rk_comb", "rk_name", "rk_addr"):
        held = windows.reranked(held, "j", r, "i1")
    ready, _ = stage0_features(held, norm0)
    return windows.pruned(learn.scored(ranker, ready, "p0").select(*pairs.columns, "p0"), "j", "p0", "i1", s.top, s.floor)


def run(dataset: str, path: str, out: str, spark: SparkSession, s: Settings | None = None) -> None:
    """From a folder of train and test TSV files to out/matching_results and out/candidate_pairs; what was learned is saved below path/trained."""
    raw = tables.read_sources(spark, dataset, "train")
    truth = tables.read_truth(spark, f"{dataset}/train_ground_truth.tsv")
    _, trained = train(raw, truth, f"{path}/train", s)
    trained.save(f"{path}/trained")
    score(dataset, path, out, spark)


def score(dataset: str, path: str, out: str, spark: SparkSession) -> None:
    """The test files of a dataset by what an earlier run saved below path/trained."""
    test = tables.read_sources(spark, dataset, "test")
    matches, cand = predict(test, Trained.load(spark, f"{path}/trained"), f"{path}/test")
    entities = test.where("src = 1").select(F.col("entity_id").alias("source1_entity_id"))
    found = matches.select(F.col("s1_id").alias("source1_entity_id"), "r_id")
    tables.write_tsv(tables.listed(entities, found, "source1_entity_id", "r_id", "matched_entity_ids"), f"{out}/matching_results", "source1_entity_id")
    shown = cand.select(F.col("i1").alias("source1_entity_id"), F.col("j").alias("r_id"))
    tables.write_tsv(tables.listed(entities, shown, "source1_entity_id", "r_id", "candidate_entity_ids"), f"{out}/candidate_pairs", "source1_entity_id")
