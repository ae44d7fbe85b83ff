"""What learned operators compute, against plain versions: features, learned words, calibration."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import toxicity

SPELLED = str.maketrans("0134@57", "oieaast")


def plain_features(text, learned):
    text = text or ""
    bare = "".join(c for c in text.lower() if c not in toxicity._PUNCTUATION).translate(SPELLED)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", bare) if w]
    kind = lambda w: "F" if w in toxicity.INSULTS else "L" if w in learned else "Y" if w in toxicity.SECOND_PERSON else "."
    m = "".join(map(kind, words))
    n, chars = max(len(m), 1), max(len(text), 1)
    hits = m.count("F") + m.count("L")
    near = len(re.findall("[FL](?=.{0,3}Y)|Y(?=.{0,3}[FL])", m)) if hits else 0
    some = lambda of: sum(c in of for c in text)
    return [
        m.count("F") / n, m.count("L") / n, m.count("F"), m.count("L"), near, m.count("Y") / n, some("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
        len(re.findall(r"\b[A-Z]{3,}\b", text)) / n, some("!?") / chars, some(toxicity._PUNCTUATION) / chars,
        len(re.findall(r"[A-Za-z]{1,20}[0-9@$*!]{1,4}[A-Za-z]", text)) / n, math.log1p(n),
    ]


@pytest.mark.parametrize("learned", [[], ["blarg", "zonk", "you"]])
def test_features_equal_a_plain_version(spark, learned):
    rnd = random.Random(3)
    words = ["you", "are", "an", "idiot", "1d10t!", "m0r0n", "MORON", "blarg", "zonk,", "the", "nice", "day", "Tu", "s7up1d", "SHOUT", "a-b", "(kill)", "@", "...", "don't", "f**l", "x9y"]
    texts = [rnd.choice((" ", "\n", "  ")).join(rnd.choices(words, k=rnd.randint(0, 30))) for _ in range(300)] + [None, "", " \t", "!?" * 50, "é ü " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made, into = toxicity.features(df, learned)
    got = {r.doc_id: r[into] for r in made.collect()}
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(plain_features(t, learned)), t


def test_learned_words_equal_a_plain_version(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(200):
        toxic = int(k % 4 == 0)
        rows.append((k, " ".join(rnd.choices(["Blarg!", "zonk", "house"] if toxic else ["tree", "house", "zonk"], k=3) + rnd.choices(["a", "bee", "cee", "dee", "eff"], k=5)), toxic))
    rows += [(900 + k, "copied words of one text", 1) for k in range(50)] + [(999, None, 1)]
    contexts = {}
    for _, t, toxic in rows:
        ws = [re.sub(r"^[^\w@$]+|[^\w]+\Z", "", w).translate(SPELLED) for w in (t or "").lower().split()]
        for i, w in enumerate(ws):
            if len(w) > 1:
                seen = contexts.setdefault(w, {}).setdefault(ws[i - 1] if i else "", [0, 0])
                seen[1 - toxic] = 1
    counts = {w: (sum(s[0] for s in c.values()), sum(s[1] for s in c.values())) for w, c in contexts.items()}
    want = sorted((w for w, (t, c) in counts.items() if t >= toxicity.MIN_CONTEXTS and t >= toxicity.MIN_SHARE * (t + c)), key=lambda w: (-counts[w][0], w))
    got = toxicity.learn_words(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert got == want[: toxicity.MAX_LEARNED] and "blarg" in got and "copied" not in got


def test_calibration_is_linear_between_its_points(spark):
    steps = [(0.1, 0.0), (0.2, 0.0), (0.4, 0.3), (0.9, 1.0)]
    xs = [0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.65, 0.9, 0.95, 1.0]
    df = spark.createDataFrame([(x,) for x in xs], "p double")
    got = [r[0] for r in df.select(toxicity.calibrated(F.col("p"), steps)).collect()]
    assert got == pytest.approx(np.interp(xs, *zip(*steps, strict=True)).tolist())
    assert [r[0] for r in df.select(toxicity.calibrated(F.col("p"), [])).collect()] == xs
