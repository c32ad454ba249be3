"""URL filter by a character language-model ratio, in DataFrame functions only.

Rules of (host, path) decide what they fit.  Urls that rules allow and block are the accepted and
rejected samples of two variable-order Markov models over the characters of host and path.  Both are
smoothed by Witten-Bell interpolation: with n(x) occurrences and t(x) distinct continuations of a context x,
P(c | x) = (n(xc) + t(x) P(c | shorter x)) / (n(x) + t(x)).  A url's score is the difference of its
log-likelihoods divided by its length; the threshold between the two classes is calibrated on samples
that the models did not see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import checkpoint

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
ORDER = 5
#: Probability of a character before any is known.
UNIFORM = 1 / 256
#: Stands before and behind a scored text.
EDGE = "\x01"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(df: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """df (with host and path) and rule, ruling: the longest fitting rule (of equal ones the first given), else null."""
    fits = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = ruling = None
    for h, p, verdict in fits:
        fit = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule = F.when(fit, F.lit(h + p)) if rule is None else rule.when(fit, F.lit(h + p))
        ruling = F.when(fit, F.lit(verdict)) if ruling is None else ruling.when(fit, F.lit(verdict))
    return df.withColumns({"rule": rule if rule is not None else F.lit(None).cast("string"), "ruling": ruling if ruling is not None else F.lit(None).cast("string")})


def _characters(texts: DataFrame) -> DataFrame:
    """A row for each character and the end of each text, with the characters before it: gram is up to ORDER characters."""
    whole = F.concat(F.lit(EDGE * (ORDER - 1)), F.col("s"), F.lit(EDGE))
    places = F.sequence(F.lit(1), F.char_length("s") + 1)
    return texts.withColumn("__w", whole).withColumn("__at", F.explode(places)).withColumn("gram", F.expr(f"substr(__w, __at, {ORDER})")).drop("__w", "__at")


def fit(samples: DataFrame) -> DataFrame:
    """gram, ratio, back: for grams of 1 to ORDER characters the log ratio of the last one's probabilities
    given those before it, and (for grams as contexts) the log ratio of what an unseen next character is multiplied by.

    samples has s (text) and accepted (boolean).  A class without samples is uniform.
    """
    last = F.expr(f"transform(sequence(1, {ORDER}), k -> substr(gram, {ORDER} + 1 - k, k))")
    grams = _characters(samples).select("accepted", F.explode(last).alias("gram"))
    n = grams.groupBy("gram").agg(F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("na"), F.sum(F.when(F.col("accepted"), 0).otherwise(1)).alias("nr"))
    counts = checkpoint(n)
    context = F.expr("left(gram, length(gram) - 1)")
    sums = {f"{k}{c}": f(c) for c in "ar" for k, f in (("n", lambda c: F.sum(f"n{c}")), ("t", lambda c: F.sum((F.col(f"n{c}") > 0).cast("int"))))}
    # contexts are shorter grams, '' for single characters, and the edges before a text, which are no grams
    contexts = counts.groupBy(context.alias("ctx")).agg(*[v.alias(f"c{k}") for k, v in sums.items()])
    rows = checkpoint(counts.withColumn("ctx", context).join(contexts, "ctx").withColumn("shorter", F.expr("substr(gram, 2)")))
    done = None
    for order in range(1, ORDER + 1):
        here = rows.where(F.length("gram") == order)
        if done is None:
            here = here.withColumns({"la": F.lit(UNIFORM), "lr": F.lit(UNIFORM)})
        else:
            here = here.join(done.select(F.col("gram").alias("shorter"), F.col("pa").alias("la"), F.col("pr").alias("lr")).where(F.length("shorter") == order - 1), "shorter")
        share = {f"p{c}": F.when(F.col(f"cn{c}") > 0, (F.col(f"n{c}") + F.col(f"ct{c}") * F.col(f"l{c}")) / (F.col(f"cn{c}") + F.col(f"ct{c}"))).otherwise(F.col(f"l{c}")) for c in "ar"}
        here = here.withColumns(share).select("gram", "pa", "pr")
        done = here if done is None else done.unionByName(here)
    free = {c: F.when(F.col(f"cn{c}") > 0, F.col(f"ct{c}") / (F.col(f"cn{c}") + F.col(f"ct{c}"))).otherwise(F.lit(1.0)) for c in "ar"}
    back = contexts.select(F.col("ctx").alias("gram"), (F.ln(free["a"]) - F.ln(free["r"])).alias("back")).where(F.length("gram") < ORDER)
    ratio = done.select("gram", (F.ln("pa") - F.ln("pr")).alias("ratio"))
    return checkpoint(ratio.join(back, "gram", "full"))


def scores(texts: DataFrame, model: DataFrame, key: str = "s") -> DataFrame:
    """key and score (log-likelihood difference a character) of the distinct texts s.

    Each distinct gram is valued once: its shorter ones are looked up order by order, the longest known one counts,
    times what its longer contexts leave to unseen characters.  Joins are by gram, whatever the model's size.
    """
    rows = _characters(texts.select("s")).groupBy("s", "gram").agg(F.count(F.lit(1)).alias("n"))
    known = model.where("ratio is not null").select("gram", "ratio")
    left = model.where("back is not null").select("gram", "back")
    grams, value = rows.select("gram").distinct(), F.lit(0.0)
    for order in range(1, ORDER + 1):
        grams = grams.withColumns({f"g{order}": F.expr(f"right(gram, {order})"), f"h{order}": F.expr(f"substr(gram, {ORDER + 1 - order}, {order - 1})")})
        grams = grams.join(known.select(F.col("gram").alias(f"g{order}"), F.col("ratio").alias(f"r{order}")), f"g{order}", "left").drop(f"g{order}")
        grams = grams.join(left.select(F.col("gram").alias(f"h{order}"), F.col("back").alias(f"b{order}")), f"h{order}", "left").drop(f"h{order}")
        value = F.coalesce(F.col(f"r{order}"), F.coalesce(F.col(f"b{order}"), F.lit(0.0)) + value)
    valued = checkpoint(grams.select("gram", value.alias("v")))
    return rows.join(valued, "gram").groupBy("s").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """Between the classes' mean scores (columns accepted, score), each weighted by the other's deviation; 0 without both classes."""
    r = scored.agg(*[f(F.when(F.col("accepted") == (c == "a"), F.col("score"))).alias(f"{n}{c}") for c in "ar" for n, f in (("m", F.avg), ("d", F.stddev_pop))]).head()
    if r.ma is None or r.mr is None:
        return 0.0
    wide = r.da + r.dr
    return (r.ma * r.dr + r.mr * r.da) / wide if wide > 0 else (r.ma + r.mr) / 2


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page.

    A rule's verdict stands; other urls are allowed where their score reaches the threshold.  Null urls and
    those without `://` have empty host and path and are scored as the empty text.  score is null where a
    rule decides.  Repeated rows are judged alike; an empty table stays empty; a url of any length is scored as a whole (a
    row for each of its characters); other columns, whatever their names, play no part.  Joins are by url and by gram, free to
    shuffle: what is broadcast is up to the session's threshold.
    """
    rows = pages.select(F.col("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = ruled(rows, rules).withColumn("s", F.concat("host", "path"))
    labelled = rows.where("ruling is not null").select("s", (F.col("ruling") == "allow").alias("accepted")).distinct()
    sample = checkpoint(labelled)
    unseen = F.crc32(F.col("s").cast("binary")) % 4 == 0
    model = fit(sample.where(~unseen))
    wanted = rows.where("ruling is null").select("s").distinct()
    limit = threshold(scores(sample.where(unseen), model).join(sample, "s"))
    judged = scores(wanted, model)
    out = rows.join(judged, "s", "left")
    out = out.withColumn("score", F.when(F.col("ruling").isNull(), F.col("score")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"), "score")
