"""What a stage has stored on the way to its result is deleted, by whatever it is called."""

import glob

from kinlink.llm import repeats, simhash
from kinlink.llm.common import shared_dir

LONG = " ".join(f"word{i}" for i in range(60))


def test_only_results_stay_in_the_shared_folder(spark):
    docs = spark.createDataFrame([(i, LONG + (f" and {i}" if i % 3 else "")) for i in range(9)], "doc_id long, text string")
    at = shared_dir(spark).removeprefix("file:").rstrip("/")
    tables = lambda: set(glob.glob(f"{at}/*-*"))
    before = tables()
    assert simhash.keep_one(docs).count() == 1
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in tables() - before} <= {"kept"}
    before = tables()
    assert repeats.cleaned(docs, ["doc_id"]).count() == 9
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in tables() - before} <= {"covers"}


def test_texts_are_cut_once(spark, monkeypatch):
    texts = [str(i) + "some text that is long enough to have windows of its own " * 5 for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut, whole = spark.sparkContext.accumulator(0), repeats.segments
    monkeypatch.setattr(repeats, "segments", lambda raws, length: (cut.add(len(raws)), whole(raws, length))[1])
    assert repeats.digests(docs, ["doc_id"]).where("n_removed > 0").count() == 12
    assert cut.value == 12
