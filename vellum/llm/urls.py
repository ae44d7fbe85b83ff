"""URL filters: explicit host and path rules, and association rules mined by FP-growth.

URLs become sets of tokens (host labels, path segments, query names, scheme).  On
labelled URLs Spark's FP-growth finds token combinations that go with a block label;
rules under the support or confidence bound go, and so do rules of which a part is a
rule: they fire on no other URL.  An inverted index from token to rule matches them:
a rule stands under its rarest token, and fires when all of its tokens are met.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A rule holds in this many labelled urls at least, whatever the number of urls.
MIN_COUNT, MIN_CONFIDENCE = 20, 0.8
#: An index of rules of so many bytes at most is sent to all tasks; a larger one meets the urls in a shuffle.
INDEX_BYTES = 8_000_000
BLOCKED = "label:block"

# The contract's rules (host and path, verdict).
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, shape, 2)


def longest_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    rule, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        rule, verdict = rule.when(fits, text), verdict.when(fits, says)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; long numbers count as one token, so ids don't matter."""
    def tag(name: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(name + ":"), v))

    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    segments = F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/")
    names = F.transform(F.split(query, "&"), lambda q: F.substring_index(q, "=", 1))
    return F.array_distinct(F.concat(
        tag("host", F.split(host, r"\.")), tag("path", segments), tag("query", names),
        F.when(F.contains(u, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        tag("scheme", F.array(F.lower(F.substring_index(u, "://", 1)))),
    ))


def mine(labelled: DataFrame) -> DataFrame:
    """``labelled(tokens, blocked 0/1)`` -> ``(rule_id, tokens, confidence, support)``.

    Rules of any length whose confidence and support reach the bounds and of which no
    proper part does.  Such a rule has no token that all labelled urls have, nor one that
    fewer than MIN_COUNT blocked ones have, so those are left out of the baskets.  So are
    tokens that make a rule alone, as their counts say: no larger one is minimal.  FP-growth
    keeps its tokens on the driver, so it gets only those that may stand in larger rules.
    Tokens that stand in the same labelled urls, such as the segments of one long path, are
    mined as one, and each of them makes a rule in its place.
    """
    schema = "rule_id long, tokens array<string>, confidence double, support double"
    n, blocked = labelled.agg(F.count("*"), F.sum("blocked")).first()
    if (blocked or 0) < MIN_COUNT:
        return labelled.sparkSession.createDataFrame([], schema)
    keyed = materialize(labelled.withColumn("id", F.monotonically_increasing_id()), "url-baskets")
    each = keyed.select("id", "blocked", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(
        F.count("*").alias("n"), F.sum("blocked").alias("b"),
        # tokens of the same urls: equal in both digests of those
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("xor"),
    )
    useful = materialize(counts.filter((F.col("n") < n) & (F.col("b") >= MIN_COUNT)), "url-useful")
    sure = F.col("b") / F.col("n") >= MIN_CONFIDENCE
    alone = useful.filter(sure).select(
        F.xxhash64(F.array("token")).alias("rule_id"), F.array("token").alias("tokens"), (F.col("b") / F.col("n")).alias("confidence"), (F.col("b") / F.lit(n)).alias("support")
    )
    # a class lies in one url, which bounds it; mining sees one token for it, so what always comes together makes no subsets
    classes = useful.filter(~sure).groupBy("n", "b", "sum", "xor").agg(F.min("token").alias("token"), F.collect_set("token").alias("members"))
    classes = materialize(classes.select("token", "members"), "url-tokens")
    # Spark takes exploded rows for as small as the file they come from: semi joins and hints keep them from being broadcast
    baskets = each.join(classes.select("token"), "token", "left_semi").groupBy("id").agg(F.collect_list("token").alias("tokens"), F.max("blocked").alias("blocked"))
    items = F.when(F.col("blocked") == 1, F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens"))
    # half a url less: a share of n times n may round up past MIN_COUNT
    baskets = materialize(baskets.select(items.alias("items")), "url-items")
    held = baskets.count()  # urls without such a token count in no larger rule
    if not held:
        return alone
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, MIN_COUNT - 0.5) / held, minConfidence=MIN_CONFIDENCE).fit(baskets)
    rules = model.associationRules.filter(F.get("consequent", F.lit(0)) == BLOCKED).select(
        F.xxhash64(F.sort_array("antecedent")).alias("rule_id"), F.sort_array("antecedent").alias("tokens"), "confidence", (F.col("support") * held / n).alias("support")
    )
    rules = materialize(rules, "url-rules")
    larger = met(rules.select(F.col("rule_id").alias("key"), "tokens"), rules).filter("size(need) < size(tokens)").select(F.col("key").alias("rule_id")).distinct()
    minimal = rules.join(larger, "rule_id", "left_anti")
    # each token of a class in turn
    slots = minimal.select("rule_id", "confidence", "support", F.explode("tokens").alias("token")).join(classes.hint("merge"), "token")
    slots = slots.groupBy("rule_id", "confidence", "support").agg(F.collect_list("members").alias("slots"))
    ways = F.aggregate(
        "slots", F.array(F.array().cast("array<string>")),
        lambda got, members: F.flatten(F.transform(got, lambda part: F.transform(members, lambda t: F.array_append(part, t)))),
    )
    whole = slots.select("confidence", "support", F.explode(ways).alias("tokens")).withColumn("tokens", F.sort_array("tokens"))
    return materialize(whole.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support").unionByName(alone), "url-minimal")


def met(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets(key, tokens)`` -> ``(key, tokens, need, confidence)``: a row for each rule all of whose tokens (``need``) a set has.

    The index has one row a rule, under the token that the fewest sets have, so a token of
    nearly all of them isn't asked for; the rest of the rule is compared in the join.  It may
    be broadcast, the sets never are.
    """
    asked = sets.select("key", "tokens", F.explode("tokens").alias("token"))
    often = materialize(asked.groupBy("token").agg(F.count("*").alias("n")), "url-counts")  # a join of written rows can be split
    index = rules.select("rule_id", F.col("tokens").alias("need"), "confidence", F.explode("tokens").alias("token")).join(often.hint("merge"), "token")
    index = index.groupBy("rule_id").agg(F.min_by(F.struct("token", "need", "confidence"), F.struct("n", "token")).alias("i")).select("i.*")
    index = materialize(index, "url-index")
    held = index.agg(F.sum(F.octet_length(F.concat_ws("", "need")) + 24 * F.size("need") + 64)).first()[0] or 0
    return asked.join(index.hint("broadcast" if held <= INDEX_BYTES else "merge"), "token").filter(F.size(F.array_except("need", "tokens")) == 0).select("key", "tokens", "need", "confidence")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(key, tokens)``, distinct -> ``(key, confidence)`` of urls that meet all tokens of some rule."""
    return met(urls, rules).groupBy("key").agg(F.max("confidence").alias("confidence"))


def _judged(pages: DataFrame) -> DataFrame:
    """``(page_id, url, key, host, path, rule, says)``; ``key`` is a hash of the url."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url", F.xxhash64("url", F.lit(1)).alias("key"), host.alias("host"), path.alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"))
    return base.withColumns({"rule": rule, "says": says})


def labelled_urls(pages: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows of ``pages`` under the explicit rules, and their distinct urls ``(key, tokens, says, blocked)``.

    A url that an explicit rule judges has its verdict as label.  Of the others those in
    ``labels(page_id, blocked)`` are labelled (the highest of a url's pages) and the rest
    is not (``blocked`` null).  Without ``labels`` all others are labelled 0: nothing is
    known against them, and left out they would make every token of the blocked ones look bad.
    """
    base = _judged(pages)
    urls = base.filter("url is not null").groupBy("key").agg(F.min(F.struct("url", "host", "path", "says")).alias("u"))
    urls = urls.select("key", tokens(F.col("u.url"), F.col("u.host"), F.col("u.path")).alias("tokens"), F.col("u.says").alias("says"))
    label = (F.col("says") == "block").cast("int")
    if labels is None:
        label = F.coalesce(label, F.lit(0))
    else:
        given = base.filter("says is null and url is not null").select("page_id", "key").join(labels, "page_id")
        urls = urls.join(given.groupBy("key").agg(F.max("blocked").cast("int").alias("given")), "key", "left")
        label = F.coalesce(label, F.col("given"))
    return base, materialize(urls.select("key", "tokens", "says", label.alias("blocked")), "urls")


def judge(pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, confidence)`` for every row of ``pages``.

    The explicit rule's verdict, else block if a mined rule matches (``confidence`` is the
    highest of those), else allow; see :func:`labelled_urls` for what is learned from.  A
    null url is allowed.  Repeated rows stay.  Other columns are ignored.
    """
    base, urls = labelled_urls(pages, labels)
    hit = matches(urls.filter("says is null").select("key", "tokens"), mine(urls.filter("blocked is not null").select("tokens", "blocked")))
    return base.join(hit, "key", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("says", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence",
    )


def held_out_counts(pages: DataFrame) -> DataFrame:
    """One row over a quarter of the distinct urls, by mined rules of the other three alone: blocked ones found and
    missed, allowed ones flagged and left, and others (no explicit rule) flagged."""
    _, urls = labelled_urls(pages)
    held = F.pmod("key", F.lit(4)) == 0
    rules = mine(urls.filter(~held).select("tokens", "blocked"))
    met = urls.filter(held).join(matches(urls.filter(held).select("key", "tokens"), rules), "key", "left")
    counts = {
        "found": "says = 'block' and confidence is not null", "missed": "says = 'block' and confidence is null",
        "flagged": "says = 'allow' and confidence is not null", "left": "says = 'allow' and confidence is null",
        "others_flagged": "says is null and confidence is not null", "others": "says is null",
    }
    return met.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in counts.items()])
