"""Personal data: high-recall candidates, boosted trees, calibrated thresholds; DataFrame operations only.

Base kinds (email, ip, card, phone) follow fixed patterns and checks.  Beside them,
generators propose overlapping candidate spans with high recall.  Boosted trees judge
them by format and by what stands beside them.  Labels come from evidence that is no
feature: the word that announces a value ("password: ", "tel. ", "mail "), and for the
trees alone also a base span over a candidate.

Thresholds: on candidates held out of the fit, and there only on occurrences that no
base span covers (all that a threshold can add), the lowest score at which PRECISION
of the occurrences down to it are announced.  Occurrences are counted, not formats, so
a format that values share with decoys counts with all its decoys.  A kind without
enough announced occurrences has no threshold.  An announced value itself needs none: it is
added whatever its format, even among decoys that share it.

Patterns use possessive repeats and stand at the start of a run, so a long run of
letters or digits takes linear time and no deep recursion.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import spread
from .common import bind, free, materialize, named
from .trees import probability

#: Formats that one task learns from, the precision asked of a threshold, announced occurrences it takes, and
#: characters looked at before a value.
FORMATS_A_TASK, PRECISION, MIN_HELD, LEFT = 50_000, 0.95, 5, 24

# The base patterns.  (Match the contract's; \G continues after a match inside a run.)
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "secret", "number", "contact")

# What announces a value.
_SECRET_WORD = "(?i:token|key|secret|passwd|password|pwd|auth|credentials?)"
ANNOUNCED = {
    "secret": _SECRET_WORD + r"[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?\z|(?i:bearer)\x20\z",
    "number": r"(?i:tel|telephone|phone|mobile|cell|fax|call|whatsapp|fon|handy|card|visa|account|iban|konto)\.?(?:\x20?(?i:no|nr|number)\.?)?[:\x20]{1,3}\z",
    "contact": r"(?i:mail|e-mail|email|mailto|contact|reach|write to)[:\x20]{1,3}\z",
}

# Candidate generators, wider than the base patterns.  Secrets: six characters with a digit, sixteen of any kind, or
# four that a secret's word announces.
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{6,}+={0,2}|[A-Za-z0-9+/_-]{16,}+={0,2}"
    r"|(?<=[:=]\x20{0,3}[\"']?)(?<=" + _SECRET_WORD + r"[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?)[^\x20\x09-\x0D\"']{4,}+)",
    "number": r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "contact": r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++",
}
_SPANS = "array<struct<s:int,e:int,v:string,left:string,right:string>>"


def find_spans(text: Column, pattern: str) -> Column:
    """``array<struct<s, e, v, left, right>>`` of leftmost non-overlapping matches; code points, end exclusive.

    ``left`` and ``right`` are the LEFT characters before and the one behind, as far as the next match.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["v"])
        one = F.struct(
            s.alias("s"), e.alias("e"), x["v"].alias("v"), F.right(x["g"], F.lit(LEFT)).alias("left"), F.substring(x["h"], 1, 1).alias("right")
        )
        return F.when(x["v"].isNull(), acc).otherwise(
            F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))
        )

    def walk(found: Column, gaps: Column) -> Column:
        # one gap more than matches: the last element has no match
        around = F.arrays_zip(gaps.alias("g"), found.alias("v"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("h"))
        return F.aggregate(around, start, step)["out"]

    # lambdas over one-element arrays: matches are found once, gaps once and only where there are matches
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda found: F.when(
        F.size(found) == 0, F.array().cast(_SPANS)
    ).otherwise(F.transform(F.array(F.split(text, pattern, -1)), lambda gaps: walk(found, gaps))[0]))[0]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(v, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    return F.length(digits).between(9, 15)


def _base(text: Column) -> Column:
    """``array<struct<s, k, e>>`` of base spans in order of start and kind."""

    def of(k: int, kind: str, pattern: str) -> Column:
        hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
        spans = F.filter(find_spans(text, pattern), lambda x: _valid(kind, x["v"]))
        spans = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
        return F.when(hint, spans).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))

    return F.sort_array(F.concat(*[of(k, kind, pattern) for k, (kind, pattern) in enumerate(BASE.items())]))


def _share(v: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(v, f"[^{chars}]", "")) / F.length(v)


FEATURES = (
    "length", "digits", "lower", "upper", "hex", "vowels", "distinct", "separators", "dots", "at_sign", "plus",
    "quoted", "assigned", "after_letter", "before_letter", "generator",
)


def _features(x: Column, kind: int) -> Column:
    v, left, right = x["v"], x["left"], x["right"]
    values = [
        F.length(v), _share(v, "0-9"), _share(v, "a-z"), _share(v, "A-Z"), _share(v, "0-9a-fA-F"), _share(v, "aeiouAEIOU"),
        F.size(F.array_distinct(F.split(v, ""))) / F.length(v), _share(v, r"\x20()./_=-"), _share(v, "."), F.contains(v, F.lit("@")).cast("int"),
        F.startswith(v, F.lit("+")).cast("int"), left.rlike("[\"'`]\\z").cast("int"),
        left.rlike("[=:][\\x20\"']*\\z").cast("int"), left.rlike(r"\p{L}\z").cast("int"), right.rlike(r"\A\p{L}").cast("int"), F.lit(kind),
    ]
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in values])


_CANDIDATES = "array<struct<s:int,k:int,e:int,f:array<double>,said:boolean,base:boolean>>"


def _proposed(text: Column, base: Column, name: str, pattern: str) -> Column:
    """``array<struct<s, k, e, f, said, base>>``: span, kind and features of each proposal, whether a word
    announces it, and whether base spans cover it or a part of it."""
    k = KINDS.index(name)
    hint = {"contact": F.contains(text, F.lit("@")), "number": text.rlike("[0-9]")}.get(name, text.rlike("[0-9:=]|[A-Za-z+/_-]{16}"))

    def make(x: Column) -> Column:
        met = F.filter(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        if name == "secret":  # base spans inside a longer secret are parts of it
            met = F.filter(met, lambda b: ~((x["e"] - x["s"] >= 16) & (x["s"] <= b["s"]) & (b["e"] <= x["e"]) & (b["e"] - b["s"] < x["e"] - x["s"])))
        said = F.coalesce(x["left"].rlike(ANNOUNCED[name]), F.lit(False))  # a word is no secret: ``key: value``
        return F.struct(
            x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), _features(x, k).alias("f"),
            (said & ~x["v"].rlike(r"\A[A-Za-z]++\z") if name == "secret" else said).alias("said"), (F.size(met) > 0).alias("base"),
        )

    return F.when(hint, F.transform(find_spans(text, pattern), make)).otherwise(F.array()).cast(_CANDIDATES)


def propose(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str, str]:
    """``keep`` columns with base spans and candidates of whole texts, and the names of those two; a null text is empty."""
    text, base, cands = free(keep, "t", "base", "cands")
    step = docs.select(*named(keep), F.coalesce("text", F.lit("")).alias(text))
    step = bind(step, base, _base(F.col(text)))  # bound: candidates look at the spans again and again
    each = [_proposed(F.col(text), F.col(base), name, pattern) for name, pattern in GENERATORS.items()]
    return bind(step, cands, F.concat(*each)).drop(text), base, cands


@dataclass
class Model:
    trees: object | None = None
    thresholds: dict[int, float] = field(default_factory=dict)  # by kind; a kind without one adds nothing


def fit(proposed: DataFrame, cands: str) -> Model:
    """Fit on all formats (kind and features): two thirds of them, by hash, for the trees, the others for thresholds.

    A format is one row with the counts of its occurrences over the whole corpus, so equal values weigh
    what they are worth and cost nothing.
    """
    each = proposed.select(F.explode(cands).alias("c")).select("c.k", "c.f", "c.said", "c.base")
    formats = each.groupBy("k", "f").agg(
        F.count_if(F.expr("said or base")).alias("pos"), F.count("*").alias("n"),
        F.count_if(F.expr("said and not base")).alias("free_pos"), F.count_if(F.expr("not base")).alias("free_n"),
    ).withColumn("h", F.xxhash64("f", "k"))
    # in an order of its own: sums of a boosting step shouldn't follow the order of a shuffle
    dealt = spread(materialize(formats, "pii-formats"), ["h"], FORMATS_A_TASK).sortWithinPartitions("h", "k", "f")
    rows = materialize(dealt.withColumn("held", F.pmod("h", F.lit(3)) == 0), "pii")
    label = F.explode(F.array(*[F.struct(F.lit(y).alias("label"), c.alias("weight")) for y, c in ((1.0, F.col("pos")), (0.0, F.col("n") - F.col("pos")))]))
    train = rows.filter("not held").select(array_to_vector("f").alias("features"), label.alias("l")).select("features", "l.label", F.col("l.weight").cast("double").alias("weight")).filter("weight > 0")
    if train.select("label").distinct().count() < 2:
        return Model()
    trees = GBTClassifier(maxIter=12, maxDepth=4, minInstancesPerNode=3, stepSize=0.3, seed=42, weightCol="weight").fit(train)
    score = F.round(probability(trees, lambda i: F.col("f")[i]), 3)
    # at most 1,001 scores a kind
    steps = rows.filter("held").groupBy("k", score.alias("p")).agg(
        F.sum("free_pos").alias("y"), F.sum("free_n").alias("n")).collect()
    model = Model(trees)
    for k in {r["k"] for r in steps}:
        y = n = 0
        for r in sorted((r for r in steps if r["k"] == k), key=lambda r: -r["p"]):
            y, n = y + r["y"], n + r["n"]
            if y >= MIN_HELD and y >= PRECISION * n:
                model.thresholds[k] = r["p"]
    return model


def selected(base: str, cands: str, model: Model) -> Column:
    """Base spans, and candidates that no base span covers and that are announced or reach their kind's threshold; in order."""

    def good(x: Column) -> Column:
        found = x["said"]
        if model.trees is not None and model.thresholds:
            limit = F.lit(2.0)
            for k, t in model.thresholds.items():
                limit = F.when(x["k"] == k, t).otherwise(limit)
            found = found | (F.round(probability(model.trees, lambda i: x["f"][i]), 3) >= limit)
        return ~x["base"] & found

    added = F.transform(F.filter(cands, good), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return F.sort_array(F.array_distinct(F.concat(base, added)))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by the first one's kind in brackets."""
    start = F.array().cast("array<struct<s:int,k:int,e:int>>")

    def merge(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(
            (F.size(acc) > 0) & (x["s"] < last["e"]),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer)),
        ).otherwise(F.concat(acc, F.array(x)))

    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    runs = F.aggregate(spans, start, merge)

    def build(r: Column) -> Column:
        pieces = F.transform(r, lambda x, i: F.concat(
            F.substring(text, F.coalesce(F.get(r, i - 1)["e"], F.lit(0)) + 1, x["s"] - F.coalesce(F.get(r, i - 1)["e"], F.lit(0))),
            F.get(names, x["k"])))
        tail = F.substring(text, F.get(r, F.size(r) - 1)["e"] + 1, F.length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(F.transform(F.array(runs), build)[0])


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row, repeated ones too.

    A null or empty text has no spans.  A corpus without announced values adds none.  Announced ones are added.
    Other columns are ignored.
    """
    proposed, base, cands = propose(docs.select("doc_id", "text"), ["doc_id"])
    proposed = materialize(proposed, "pii-spans")
    found = bind(proposed, "spans", selected(base, cands, fit(proposed, cands)))

    def count(k: int, name: str) -> Column:
        return F.size(F.filter(base, lambda x: x["k"] == k)).cast("long").alias(f"n_{name}")

    counts = [count(k, n) for k, n in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(written(F.col(base)).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, with found spans replaced in ``text``; a null text stays null.

    Texts are read twice, once to learn and once to replace, and written nowhere between.
    """
    learned, _, cands = propose(docs.select("text"), [])
    model = fit(learned, cands)
    proposed, base, cands = propose(docs, docs.columns)
    (spans,) = free(proposed.columns, "spans")
    found = bind(proposed, spans, selected(base, cands, model))
    return found.select(*[
        redacted(F.col("text"), F.col(spans)).alias("text") if c == "text" else named([c])[0] for c in docs.columns
    ])
