"""Models and thresholds that see all there is to see."""

import random
import string
from pathlib import Path

import pytest

from vellum import scratch
from vellum.llm import pii, toxicity


def test_pii_learns_from_all_formats(spark, monkeypatch):
    rnd = random.Random(3)
    token = lambda: "".join(rnd.choices(string.ascii_letters + string.digits, k=rnd.randint(16, 80)))
    rows = [(i, " ".join(token() for _ in range(24))) for i in range(1000)] + [(5000 + i, f"password: {token()}") for i in range(50)]
    made, _, cands = pii.propose(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    formats = made.selectExpr(f"inline({cands})").filter("pmod(xxhash64(f, k), 3) <> 0").groupBy("k", "f").count()
    want = (formats.count(), sum(r["count"] for r in formats.collect()))

    class Seen(Exception):
        pass

    class Watch:
        def __init__(self, **_):
            pass

        def fit(self, train):
            raise Seen(train.select("features", "weight").count(), train.agg({"weight": "sum"}).first()[0])

    monkeypatch.setattr(pii, "GBTClassifier", Watch)
    with pytest.raises(Seen) as seen:
        pii.fit(made, cands)
    rows, weight = seen.value.args
    assert want[0] > 14_000 and rows >= want[0] and weight == want[1]


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 9 = 0 as int) as toxic")
    docs = labels.selectExpr("doc_id", "if(toxic = 1, 'you idiot', concat('fine ', doc_id)) as text")
    seen = []

    def watch(sample):
        seen.append(sample.count())
        return []

    class Done(Exception):
        pass

    def stop(sample, learned):
        seen.append(sample.count())
        raise Done

    monkeypatch.setattr(toxicity, "learn_words", watch)
    monkeypatch.setattr(toxicity, "features", stop)
    with pytest.raises(Done):
        toxicity.fit(docs, labels)
    known = labels.filter(~toxicity.held_out(labels.doc_id)).count()
    assert known > 14_000 and seen[1] == known and seen[0] > 0.7 * known


def _shuffled(spark):
    """Bytes of each shuffle file that this session has on disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p: p.stat().st_size for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_learned_words_shuffle_less_than_the_texts(spark):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choices(string.ascii_lowercase, k=6)) for _ in range(500)]
    rows = []
    for k in range(1200):
        words = rnd.choices(vocabulary, k=200)
        for j in rnd.sample(range(200), 5) if k % 20 == 0 else []:
            words[j] = "zorkface"
        rows.append((k, " ".join(words), int(k % 20 == 0)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    sample.write.parquet(path := scratch.scratch(spark, "test"))
    before = set(_shuffled(spark))
    assert toxicity.learn_words(spark.read.parquet(path)) == ["zorkface"]
    moved = sum(n for p, n in _shuffled(spark).items() if p not in before)
    assert moved < 0.5 * sum(len(text) for _, text, _ in rows), moved
