"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

All lines with a word take part; blank lines stay.  Words are runs without ASCII white
space, compared in lower case.  Equal lines are copies at any length.  Two lines of
NEAR_WORDS words or more are near copies when one word substitution, insertion or
deletion turns one into the other: one edit in fewer words changes what they say.
A line goes when an equal or near line stands earlier in the order of doc_id, line
number and the hash of the text, whether or not that one goes itself.

1. Equal lines become one class with its earliest place.
2. Lossless prefilter: with one edit, either the first or the last half of the words
   is the same.  Classes that share no half with another class have no near copy.
3. The rest emit their deletion neighbourhood as hashed keys: one key per deleted
   word, and the whole line.  Keys are order-sensitive and come from running
   exclusive-ors of word hashes, so a line of n words costs O(n).
4. Classes with the same remaining words at the same deleted position are all one
   substitution apart, so each is held against the group's earliest alone: a minimum
   per key instead of pairs.  The same for a whole line against one-word-longer ones.
5. Candidates are verified word by word; the earliest stays.

Scale: hashes move, not texts, until the last join.  Every group is reduced by a
partial aggregate before its shuffle and joined back by an equi-join that AQE can
split, so a line that a third of all documents share is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, free, kept_columns, materialize, named

#: Words that a line has at least to be a near copy of another.
NEAR_WORDS = 5
PLACE = ("doc_id", "line_no", "th")
#: White space other than the space and the line feed.
RARE_SPACE = "\t\x0b\x0c\r"


def _split_lines(docs: DataFrame, least: int) -> DataFrame:
    """``(doc_id, th, line_no, line)`` of lines that can have ``least`` words; white space in a line is spaces.

    ``th`` tells apart texts with one doc_id.
    """
    text = F.col("text")
    rare = F.lit(False)
    for c in RARE_SPACE:
        rare = rare | F.contains(text, F.lit(c))
    spaced = F.when(rare, F.regexp_replace(text, f"[{RARE_SPACE}]", " ")).otherwise(text)
    # hashed and split before the lines are dealt out, so no line carries its whole text
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.split(spaced, "\n").alias("ls"))
    return split.select("doc_id", "th", F.posexplode("ls").alias("line_no", "line")).filter(F.length("line") >= 2 * least - 1)


def _with_words(lines: DataFrame, least: int) -> DataFrame:
    """Lines of ``least`` words or more, with ``words`` and the two hashes of their class."""
    words = F.array_remove(F.split(F.lower("line"), " "), "")  # a plain split and no lambda: stays in generated code
    return bind(lines, "words", words).drop("line").filter(F.size("words") >= least).withColumns(
        {"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit("2"), "words")}
    )


def line_places(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, line_no, h1, h2)`` and half keys of each line that takes part."""
    return materialize(
        _with_words(_split_lines(docs, 1), 1).select("doc_id", "th", "line_no", "h1", "h2", *_half_keys(F.col("words"))), "lines"
    )


def _half_keys(words: Column) -> list[Column]:
    """Hashes of the first and last q words, for q the half of the shorter line of a pair:
    n div 2 (this one is the shorter, or both are equal) and (n - 1) div 2 (this one is longer; null if that's the same).
    Lines under NEAR_WORDS words have none."""
    n = F.size(words)

    def key(end: str, q: Column) -> Column:
        part = F.slice(words, F.lit(1) if end == "first" else n - q + 1, q)
        return F.xxhash64(F.lit(end), q, part)

    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    equal = [F.when(n >= NEAR_WORDS, key(end, half)).alias(f"{end}0") for end in ("first", "last")]
    return equal + [F.when((n >= NEAR_WORDS) & (n % 2 == 0), key(end, less)).alias(f"{end}1") for end in ("first", "last")]


def _survivors(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes ``(h1, h2, place, copies)``, and those that share a half with another class ``(h1, h2, place)``."""
    halves = ("first0", "last0", "first1", "last1")
    found = places.groupBy("h1", "h2").agg(
        F.min(F.struct(*PLACE)).alias("place"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in halves]
    )
    classes = materialize(found, "classes")
    keys = classes.select("h1", "h2", F.explode(F.array_compact(F.array(*halves))).alias("k"))
    shared = keys.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    near = keys.join(shared, "k", "left_semi").select("h1", "h2").distinct()
    return classes.select("h1", "h2", "place", "copies"), near


def near_earlier(docs: DataFrame, classes: DataFrame, near: DataFrame) -> DataFrame:
    """``(h1, h2)`` of classes with a near class that stands earlier."""
    # one long for a class, in the order of places
    own = classes.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "place.*").orderBy(*PLACE)
    own = materialize(own.withColumn("rank", F.monotonically_increasing_id()), "own")
    # words of surviving classes, from the class's earliest line
    asked = own.select("rank", *[F.col(c).alias(f"own_{c}") for c in PLACE])
    here = (F.col("th") == F.col("own_th")) & (F.col("line_no") == F.col("own_line_no")) & F.col("doc_id").eqNullSafe(F.col("own_doc_id"))
    found = _split_lines(docs, NEAR_WORDS).join(asked, here)
    words = materialize(_with_words(found, NEAR_WORDS).select("rank", "words").dropDuplicates(["rank"]), "words")  # rows of documents may repeat

    def folded(shift: int) -> Column:  # exclusive-or of all word hashes, positions shifted
        hashes = F.transform("words", lambda w, i: F.xxhash64(w, i - shift if shift else i))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))

    # dealt by rank before the words are: the window needs no shuffle of a row a word
    dealt = bind(words.repartition("rank"), "t", F.struct(F.size("words").alias("n"), folded(1).alias("t1")))
    each = dealt.select("rank", "t.n", "t.t1", F.posexplode("words").alias("i", "w"))
    run = Window.partitionBy("rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    here, shifted = F.xxhash64("w", "i"), F.xxhash64("w", F.col("i") - 1)
    # words before i at their positions, words after i one position earlier
    deleted = (
        F.bit_xor(here).over(run).bitwiseXOR(here).bitwiseXOR(F.col("t1")).bitwiseXOR(F.bit_xor(shifted).over(run))
    )
    cut = each.select("rank", "i", F.xxhash64(F.col("n") - 1, deleted).alias("v"))
    whole = words.select("rank", F.lit(-1).alias("i"), F.xxhash64(F.size("words"), folded(0)).alias("v"))
    hood = materialize(cut.unionByName(whole), "hood")
    cuts = hood.filter("i >= 0")
    groups = cuts.groupBy("v", "i").agg(F.min("rank").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same_slot = cuts.join(groups, ["v", "i"]).filter("low < rank").select("rank", "low")
    wholes = hood.filter("i < 0").select("v", F.col("rank").alias("short"))
    longer = cuts.groupBy("v").agg(F.min("rank").alias("low"))
    short_late = wholes.join(longer, "v").filter("low < short").select(F.col("short").alias("rank"), "low")
    long_late = (
        cuts.join(wholes.groupBy("v").agg(F.min("short").alias("low")), "v").filter("low < rank").select("rank", "low")
    )
    pairs = same_slot.unionByName(short_late).unionByName(long_late).distinct()
    late = words.select("rank", F.col("words").alias("a"))
    earlier = words.select(F.col("rank").alias("low"), F.col("words").alias("b"))
    checked = pairs.join(late, "rank").join(earlier, "low").filter(within_one_edit(F.col("a"), F.col("b")))
    return own.join(checked.select("rank").distinct(), "rank", "left_semi").select("h1", "h2")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one word edit at most turns ``a`` into ``b``: equal ends cover all but one word."""

    def common(x: Column, y: Column) -> Column:
        differ = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(differ == 0, F.greatest(F.size(x), F.size(y))).otherwise(differ - 1)

    longest = F.greatest(F.size(a), F.size(b))
    close = F.abs(F.size(a) - F.size(b)) <= 1
    return close & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, drops)``: numbers of the lines that go, from 0, for each document with any."""
    places = line_places(docs)
    classes, near = _survivors(places)
    late = materialize(near_earlier(docs, classes, near), "late").withColumn("near", F.lit(True))
    judged = classes.join(late, ["h1", "h2"], "left").filter("near or copies > 1")
    act = judged.select("h1", "h2", F.coalesce("near", F.lit(False)).alias("near"),
                        *[F.col(f"place.{c}").alias(f"first_{c}") for c in PLACE])
    gone = places.join(act, ["h1", "h2"]).filter(
        "near or not (doc_id <=> first_doc_id and line_no = first_line_no and th = first_th)"
    )
    return gone.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("drops"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` less its repeated lines, and ``n_lines``, ``n_dropped``.

    A null text stays null (0 lines); an empty one has one line.  Rows with equal
    doc_id and text are one document and get the same result; rows with equal doc_id
    and different texts are documents of their own.  Rows without doc_id come first in
    the order.  Input columns named like an output are replaced; other columns pass
    through, whatever their names.
    """
    rest = kept_columns(docs, ["n_lines", "n_dropped"])
    drops, doc, th = free(rest, "drops", "id", "th")
    source = docs.select(*named(rest))
    joined = source.join(
        dropped_lines(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": doc, "th": th, "drops": drops}),
        F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left",
    )
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drops))
    text = F.when(F.col(drops).isNull(), F.col("text")).otherwise(
        F.transform(F.array(lines), lambda ls: F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n"))[0]
    )
    return joined.select(
        *[text.alias(c) if c == "text" else named([c])[0] for c in rest],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(drops), F.lit(0)).cast("long").alias("n_dropped"),
    )
