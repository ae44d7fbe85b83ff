"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a fixed and of a learned lexicon, how near hits stand to
second-person words, capitals, punctuation and obfuscated spellings.  All are
built-in functions; texts are scored where they lie, without a shuffle.

Learned words and trees see three quarters of the labelled rows; the isotonic step is
fitted on the last quarter alone, so it maps scores of texts that neither has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, free, kept_columns, materialize, named
from .trees import probability

#: Learned words at most (those in most contexts; each is a part of the scoring expression), the contexts each takes,
#: and the share of them in toxic texts.
MAX_LEARNED, MIN_CONTEXTS, MIN_SHARE = 64, 4, 0.6
#: Words that are broadcast at most; more are joined as Spark sees fit.
MAX_BROADCAST = 200_000
THRESHOLD = 0.3

# Common insults, and second-person words of four languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers clown scum trash garbage worthless pathetic disgusting "
    "filthy vile imbecile cretin hate kill shut ugly freak creep jerk bastard damn crap "
    "idiota estúpido imbécil basura asqueroso imbécile stupide ordure débile dummkopf abschaum widerlich müll"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur tu te tus usted ustedes vosotros toi ton ta tes vous votre vos "
    "du dich dir dein deine deinen euch euer"
).split()

# Punctuation.
_PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_~`+=/\\"
_MARK = "[" + "".join("\\" + c for c in _PUNCTUATION) + "]"
_SPELLED = ("0134@57", "oieaast")
# Of words with one blank between them: what stands before the first letter, digit, @ or $, and after the last letter or digit.
_OUTER = r"(?:\A|(?<=\x20))[^\p{L}\p{N}@$\x20]+|[^\p{L}\p{N}\x20]++(?=\x20|\z)"
NAMES = (
    "fixed_density", "learned_density", "fixed_hits", "learned_hits", "near_you", "you_density", "capitals",
    "capital_words", "exclaims", "punctuation", "obfuscated", "log_words",
)


def features(docs: DataFrame, learned: list[str]) -> tuple[DataFrame, str]:
    """``docs`` and a column of features (array of doubles, in the order of NAMES), and its name; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    words, marks, into = free(docs.columns, "words", "marks", "features")
    # punctuation off first, so plain words need one lookup
    plain = F.translate(F.regexp_replace(F.lower(text), _MARK + "+", ""), *_SPELLED)
    step = bind(docs, words, F.array_remove(F.split(plain, SPACE), ""))
    w = F.col(words)
    lexicon = sorted({*INSULTS, *learned, *SECOND_PERSON})

    # one letter a word: F fixed, L learned, Y second person, a stop otherwise; most words need one lookup, most texts none
    def mark(x: Column) -> Column:
        kind = F.when(x.isin(*INSULTS), "F")
        if learned:
            kind = kind.when(x.isin(*learned), "L")
        return F.when(~x.isin(*lexicon), ".").otherwise(kind.otherwise("Y"))

    met = F.arrays_overlap(w, F.array(*map(F.lit, lexicon)))
    step = bind(step, marks, F.when(met, F.array_join(F.transform(w, mark), "")).otherwise(F.repeat(F.lit("."), F.size(w)))).drop(words)

    def count(chars: str) -> Column:
        return F.length(marks) - F.length(F.translate(marks, chars, ""))

    def found(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    chars = F.greatest(F.length(text), F.lit(1))
    m = F.col(marks)
    fixed, hits_learned = count("F"), count("L")
    near = F.when(fixed + hits_learned == 0, 0).otherwise(F.regexp_count(m, F.lit("[FL](?=.{0,3}Y)|Y(?=.{0,3}[FL])")))
    obfuscated = found("[A-Za-z][0-9@$*!]{1,4}[A-Za-z]")  # letters before the last one change no count
    shout = found(r"(?=[A-Z]{3})\b[A-Z]{3,}\b")
    n = F.greatest(F.length(m), F.lit(1))
    values = [
        fixed / n, hits_learned / n, fixed, hits_learned, near, count("Y") / n, found("[A-Z]") / chars, shout / n,
        found("[!?]") / chars, found(_MARK) / chars, obfuscated / n, F.log1p(n),
    ]
    return bind(step, into, F.array(*[v.cast("double") for v in values])).drop(marks), into


@dataclass
class Model:
    learned: list[str]
    trees: object | None  # None: the labels have one class only
    calibration: list[tuple[float, float]]  # boundaries and values of the step function
    base_rate: float


def held_out(doc_id: Column) -> Column:
    """Remainder 2 of crc32 of the id's decimal text by 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def contexts(texts: DataFrame) -> DataFrame:
    """``(w, before)``: each word of two characters or more, plain, and the one before it (empty for a text's first).

    Plain: lower case, without outer punctuation, common digit and sign spellings undone.
    """
    apart = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), SPACE, " "))
    plain = bind(texts, "w", F.split(F.translate(F.regexp_replace(apart, _OUTER, ""), *_SPELLED), " ")).select("w")
    pairs = plain.withColumn("before", F.concat(F.array(F.lit("")), "w")).select(F.explode(F.arrays_zip("w", "before")).alias("p"))
    return pairs.select("p.*").filter("length(w) > 1")


def learn_words(sample: DataFrame) -> list[str]:
    """Words that stand in toxic texts in varied company.

    A word counts once per distinct word before it, so copies of one toxic text don't
    make all of its words look toxic.  A null text has no words.

    Clean contexts are met by bits first, as no more bits are set than there are contexts: on 64
    bits a word, then, for words that this leaves, on twice as many as the word has toxic contexts.
    The few words that stay are counted exactly, so no shuffle holds all pairs of words.
    """

    clean = sample.filter("toxic = 0")

    def among(words: DataFrame) -> DataFrame:
        few = words.count() <= MAX_BROADCAST
        return contexts(clean).join(F.broadcast(words) if few else words, "w")

    def pass_share(words: DataFrame, counts: DataFrame) -> DataFrame:
        both = words.join(counts, "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        return both.filter(F.col("t") >= MIN_SHARE * (F.col("t") + F.col("c"))).select("w", "t")

    toxic = contexts(sample.filter("toxic = 1")).distinct().groupBy("w").agg(F.count("*").alias("t"))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(before), 58) as int))")).alias("bits")
    first = contexts(clean).groupBy("w").agg(bits).select("w", F.bit_count("bits").alias("c"))
    left = materialize(pass_share(toxic.filter(F.col("t") >= MIN_CONTEXTS), first), "toxic-words")
    cells = among(left).groupBy("w", F.expr("pmod(xxhash64(before), (t + 31) div 32)").alias("cell")).agg(bits)
    left = materialize(pass_share(left, cells.groupBy("w").agg(F.sum(F.bit_count("bits")).alias("c"))), "toxic-words")
    exact = among(left).select("w", "before").distinct().groupBy("w").agg(F.count("*").alias("c"))
    return [r["w"] for r in pass_share(left, exact).orderBy(F.desc("t"), "w").limit(MAX_LEARNED).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled rows that are not held out."""
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    sample = materialize(
        docs.select("doc_id", "text").join(known.hint("merge"), "doc_id")  # the same join however few labels there are
        .withColumn("calibrate", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0), "toxic",
    )
    learned = learn_words(sample.filter("not calibrate"))
    made, into = features(sample, learned)
    rows = materialize(
        made.select(F.col("toxic").cast("double").alias("label"), array_to_vector(into).alias("features"), "calibrate"), "toxic-features"
    )
    total, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    rate = (toxic or 0.0) / total if total else 0.0
    train = rows.filter("not calibrate")
    if train.select("label").distinct().count() < 2:
        return Model(learned, None, [], rate)
    trees = GBTClassifier(maxIter=20, maxDepth=4, minInstancesPerNode=5, stepSize=0.2, seed=42).fit(train)
    unseen = trees.transform(rows.filter("calibrate")).select("label", F.element_at(vector_to_array("probability"), 2).alias("p"))
    if unseen.select("label").distinct().count() < 2:
        return Model(learned, trees, [], rate)
    iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(unseen)
    steps = list(zip(iso.boundaries.toArray().tolist(), iso.predictions.toArray().tolist(), strict=True))
    return Model(learned, trees, steps, rate)


def calibrated(p: Column, steps: list[tuple[float, float]]) -> Column:
    """Linear between the fitted points, constant outside; ``p`` itself without any."""
    if not steps:
        return p
    xs = F.array(*[F.lit(x) for x, _ in steps])
    ys = F.array(*[F.lit(y) for _, y in steps])
    k = F.size(F.filter(xs, lambda x: x < p))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    inside = y0 + (y1 - y0) * F.coalesce(F.try_divide(p - x0, x1 - x0), F.lit(0.0))
    return F.when(k == 0, ys[0]).when(k == len(steps), ys[len(steps) - 1]).otherwise(inside)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= 0.3).

    Every row is scored, null and empty texts as texts without words; repeated rows get
    equal scores.  Without labels of both classes the score is the share of toxic
    labels.  Input columns named like an output are replaced; other columns pass
    through, whatever their names.
    """
    source = docs.select(*named(kept_columns(docs, ["score", "predicted"])))
    if model.trees is None:
        return source.withColumns({"score": F.lit(model.base_rate), "predicted": F.lit(int(model.base_rate >= THRESHOLD))})
    made, into = features(source, model.learned)
    (raw,) = free(made.columns, "raw")
    made = bind(made, raw, probability(model.trees, lambda i: F.col(into)[i]))
    p = F.least(F.greatest(calibrated(F.col(raw), model.calibration), F.lit(0.0)), F.lit(1.0))
    return bind(made, "score", p).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop(into, raw)


def held_out_counts(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """One row over labelled rows that learning never sees: toxic ones found and missed, clean ones flagged and left."""
    known = labels.filter(held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    met = scored.select("doc_id", "predicted").join(known, "doc_id")
    counts = {"found": "toxic = 1 and predicted = 1", "missed": "toxic = 1 and predicted = 0", "flagged": "toxic = 0 and predicted = 1", "left": "toxic = 0 and predicted = 0"}
    return met.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in counts.items()])
