"""The pipeline's stages on a small corpus, each held against a plain version of its decisions."""

import random

import corpus_pipeline as cp
import pytest
from vellum.llm import simhash, toxicity

from .test_operators import same_line


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefghijk", k=rnd.randint(3, 8))) for _ in range(500)]
    rows = []
    for i in range(260):
        body = [" ".join(rnd.choices(vocabulary, k=12)) for _ in range(6)]
        if i % 6 == 0:
            body[2] = "you absolute idiot " + body[2] + " moron clown you scum"
        if i % 10 == 3:
            body.append("shared licence line of seven plain words")
        if i % 9 == 4:
            body[0] += f" mail me{i}@example.org now"
        rows.append((i, "\n".join(body), "en", "s", 1))
    rows += [(300 + i, rows[i][1], "en", "s", 1) for i in range(1, 20, 2)]  # exact copies
    rows += [(400, None, None, None, None), (401, "", "en", None, 0), (402, "   ", "en", None, 3)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    known = [(i, 1, int(i % 6 == 0)) for i in range(260)]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, corpus).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
    first = {r["doc_id"] for r in seen["toxicity"]}
    toxic = {i for i in range(0, 260, 6)}
    assert len(toxic & first) <= 0.05 * len(toxic) and len(first & set(range(260)) - toxic) >= 0.99 * (260 - len(toxic))

    kept = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert kept.keys() == first and kept[400] is None
    shared = [d for d, t in kept.items() if t and "shared licence line" in t]
    assert shared == [min(d for d in first if d % 10 == 3 and d < 260)]
    left = sorted((d, n, x.lower().split()) for d, t in kept.items() if t for n, x in enumerate(t.split("\n")) if x.split())
    assert not any(same_line(a[2], b[2]) for i, a in enumerate(left) for b in left[:i])

    singles = {r["doc_id"] for r in seen["simhash_near_dedup"]}
    prints = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(spark.read.parquet(f"{tmp_path}/line_dedup"), cp.NEAR_WORDS, cp.NEAR_BITS, cp.NEAR_SEGMENTS).collect()}
    assert singles == {d for d, (_, c) in prints.items() if d == c}
    assert all((prints[a][0] ^ prints[b][0]).bit_count() > cp.NEAR_BITS for a in singles for b in singles if a < b)

    clean = {r["doc_id"]: r["text"] for r in seen["pii"]}
    assert clean.keys() == singles and not any("@" in (t or "") for t in clean.values()) and any("[EMAIL]" in (t or "") for t in clean.values())
    packed = seen["best_fit_packing"]
    assert {r["doc_id"] for r in packed} == singles
    for s in {r["sequence_id"] for r in packed}:
        at = 0
        for offset, n in sorted((r["offset"], r["length"]) for r in packed if r["sequence_id"] == s):
            assert offset == at
            at += n
        assert at <= 1024
    assert [tuple(r)[:5] for r in sorted(packed)] == [tuple(r)[:5] for r in sorted(cp.run(spark, corpus).collect())]


def test_model_is_fitted_on_its_own_rows(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    assert {"idiot", "moron"} & set(model.learned)


def test_empty_table(spark, corpus, tmp_path):
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet").limit(0) for t in ("documents", "labels"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
