import random

from pyspark.sql import functions as F

from kinlink.functions import text
from kinlink.operators import learn
from kinlink.plans import linkage
from kinlink.sources import tables


def world(seed, n, country="US"):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ter", "san", "vu", "pol", "re")) for _ in range(rng.randrange(2, 4)))
    rows, truth, c = [], [], country[0].lower()
    for i in range(n):
        name, addr = f"{word()} {word()} {rng.choice(('Inc', 'Ltd', 'LLC'))}", f"{rng.randrange(1, 999)} {word()} Street, {word()}, Texas"
        rows.append((f"S1-{c}{i}", name, addr, country, 1))
        for k in (2, 3):
            if rng.random() < 0.8:
                noisy = name.replace("Inc", "Incorporated").upper() if rng.random() < 0.5 else name.replace("o", "0", 1)
                rows.append((f"S{k}-{c}{i}", noisy, addr.replace("Street", "St").replace("Texas", "TX") if rng.random() < 0.8 else "", country, k))
                truth.append((f"S1-{c}{i}", f"S{k}-{c}{i}"))
    rows += [(f"S2-{c}x{i}", f"{word()} {word()}", f"{rng.randrange(1, 999)} {word()} Road", country, 2) for i in range(n // 3)]
    return rows, truth


def test_whole_run_finds_most_links(spark, tmp_path):
    wanted, entities = {}, {}
    for split, worlds in (("train", [world(4, 70)]), ("test", [world(5, 50), world(6, 20, "Peru")])):
        rows, truth = (sum((w[i] for w in worlds), []) for i in (0, 1))
        wanted[split], entities[split] = set(truth), [r[0] for r in rows if r[4] == 1]
        for k in (1, 2, 3):
            lines = ["\t".join(r[:4]) for r in rows if r[4] == k]
            (tmp_path / f"{split}_source{k}.tsv").write_text("\n".join(["entity_id\tbusiness_name\tbusiness_address\tcountry", *lines]) + "\n")
    lists = {}
    for s1, r in wanted["train"]:
        lists.setdefault(s1, []).append(r)
    (tmp_path / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{e}\t{','.join(lists.get(e, []))}\n" for e in entities["train"]))
    small = linkage.Settings(channels={"comb": 6, "name": 4, "addr": 4, "rev": 3}, name_cap=60, addr_cap=60, top=5, folds=2, rounds=2, depth=2, neg_keep=0.7)
    linkage.run(str(tmp_path), f"{tmp_path}/work", f"{tmp_path}/out", spark, small)
    found = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/out/matching_results").na.fill("")
    assert found.count() == 70 and found.columns == ["source1_entity_id", "matched_entity_ids"]
    got = {(r.s1_id, r.r_id) for r in tables.truth_pairs(found, "source1_entity_id", "matched_entity_ids").collect()}
    assert len({r for _, r in got}) == len(got)
    hit = len(got & wanted["test"])
    assert hit > 0.85 * len(wanted["test"]) and hit > 0.9 * len(got)
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/out/candidate_pairs").count() == 70
    # the columns of both passes, and what a run keeps
    full, both = (spark.read.parquet(f"{tmp_path}/work/train/{n}") for n in ("features", "features2_n"))
    assert len(linkage.columns_of(full)) == 163 and len(linkage.columns_of(both)) == 187
    trained = linkage.Trained.load(spark, f"{tmp_path}/work/trained")
    assert trained.settings == small and set(trained.lines) == {"n"} and trained.blend == ["p_n"] and [r.country for r in trained.groups.collect()] == ["US"]
    # as if a share of the entities had never been there
    truth = tables.read_truth(spark, f"{tmp_path}/train_ground_truth.tsv")
    vec = {k: spark.read.parquet(f"{tmp_path}/work/train/vec_{k}") for k in ("name", "addr", "comb")}
    again = linkage.rescored_without(full, truth, trained, vec, 0.2).toPandas()
    gone = {r.i1 for r in full.where(learn.in_share("i1", 0.2)).select("i1").distinct().collect()}
    assert gone and not gone & set(again.s1_id) and len(again) == full.where(~learn.in_share("i1", 0.2)).count() and again.p.between(0, 1).all()
    raw, norm0 = (spark.read.parquet(f"{tmp_path}/work/train/{n}") for n in ("cand_raw", "norm_s0"))
    held = linkage.candidates_without(raw, norm0, trained.ranker, 0.2, small).toPandas()
    assert not gone & set(held.i1) and held.groupby("j").size().max() <= 5 and (held.p0 >= small.floor).all()


def test_indic_words(spark):
    assert text.transliterate("राम") == "raama" or text.transliterate("राम").startswith("ra")
    rows = [("S1-1", "राम Traders", "12, दिल्ली, x", "India", 1), ("S2-1", "plain", "5 rd", "India", 2)]
    raw = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, src int")
    known = spark.createDataFrame([("name", "w", "राम", "ram"), ("addr", "c", "दिल्ली", "delhi"), ("addr", "w", "राम", "other")], "field string, kind string, token string, aligned string")
    got = {r.entity_id: r for r in linkage.normalise(linkage.with_readings(raw, known)).collect()}
    row = got["S1-1"]
    assert row.nf == "ram traders" and row.nflag & text.INDIC and row.ast == "s_in_dl" and row.aind and got["S2-1"].nf == "plain" and not got["S2-1"].aind


def test_dictionaries_of_indic_words(spark):
    rows = [(f"S{k}-{i}", n, f"{i} {a}", "India", k) for i in range(3) for k, n, a in ((1, "Ram Traders", "Gandhi Marg, Delhi"), (2, "राम Traders", "गांधी Marg, दिल्ली"))]
    raw = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, src int")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(3)], "s1_id string, r_id string")
    got = {(r.field, r.kind, r.token): r.aligned for r in linkage.dictionaries(raw, truth).collect()}
    assert got[("name", "w", "राम")] == "ram" and got[("addr", "c", "दिल्ली")] == "delhi" and ("addr", "w", "गांधी") in got
