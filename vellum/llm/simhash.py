"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or and
bit counts.  A tile holds distinct fingerprints with the same population counts of
their bit segments.  Two fingerprints differ in at least as many bits as the sum
of the differences of those counts, so tile pairs whose counts differ beyond the
radius are skipped without a look.

Scale: equal texts (and all equal fingerprints) meet in one row before anything is
compared.  There are at most ``17**4`` kinds of tile; a kind with many rows is split
into parts of about TILE_ROWS, so a task holds two parts at a time.  Of each tile
pair only a spanning forest of its links leaves the task, never all pairs of a group
of near copies; the forests have the same components as the links.  The method compares
pairs, so its work grows with the square of the distinct fingerprints: at 4 % of all
pairs and some 3e8 of them a core second, a thousand cores take 1e8 fingerprints in about
ten minutes and 1e9 in a day.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, connected_components, materialize, words_of

WIDTH, RADIUS, SEGMENTS, TILE_ROWS = 3, 3, 4, 2048
#: Verified near copies: 128 bits, of which pairs at a Jaccard similarity of 0.8 differ in 19 (deviation 4), strangers in 64 (6).
WIDE_RADIUS, WIDE_ROWS = 34, 4096
#: Shingles of the texts of a tile part that is compared exactly (8 bytes each).
SET_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """XXH64 (seed 42) of each ``width``-word shingle, repeats included; fewer words: of the whole sequence."""
    words = words_of(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER))

    def hashes(w: Column) -> Column:
        n = F.size(w)
        several = F.transform(
            F.sequence(F.lit(0), n - width),
            lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)])),
        )
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < width, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(several)
        )

    # bind the words once: a lambda over a one-element array evaluates them a single time
    return F.transform(F.array(words), hashes)[0]


def majority_bits(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per run of hashes (``ends``: offsets, one more than runs): bits set in over half of them."""
    out = np.zeros(len(ends) - 1, np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    step = 1 << 15
    k, runs = 0, len(ends) - 1
    while k < runs:
        last = max(k + 1, int(np.searchsorted(ends, ends[k] + step, "right")) - 1)
        n = ends[k + 1 : last + 1] - ends[k:last]
        if last == k + 1:  # one run, in slices
            counts = np.zeros((1, 64), np.int64)
            for a in range(int(ends[k]), int(ends[last]), step):
                part = np.ascontiguousarray(values[a : min(a + step, int(ends[last]))])
                counts[0] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            part = np.ascontiguousarray(values[ends[k] : ends[last]])
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.zeros((last - k, 64), np.int64)
            full = np.flatnonzero(n)
            if len(full):
                counts[full] = np.add.reduceat(bits, (ends[k:last] - ends[k])[full], axis=0, dtype=np.int32)
        out[k:last] = ((2 * counts > n[:, None]) * weights).sum(1, dtype=np.uint64)
        k = last
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)`` with the 64 bits as a long; a text without words has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = np.asarray(lists.offsets)
            values = np.asarray(lists.values)
            fp = majority_bits(values, ends)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), shingle_hashes(F.col("text"), width).alias("h")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _tile(fp: Column, segments: int) -> Column:
    bits = 64 // segments
    key = F.lit(0)
    for s in range(segments):
        part = F.shiftrightunsigned(fp, s * bits).bitwiseAND(F.lit((1 << bits) - 1))
        key = key * (bits + 1) + F.bit_count(part)
    return key.cast("int")


def _offsets(radius: int, segments: int) -> list[int]:
    """Differences of tile keys, half of them (the other half has them reversed)."""
    base = 64 // segments + 1
    moves = [m for m in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, m)) <= radius]
    return [sum(x * base ** (segments - 1 - s) for s, x in enumerate(m)) for m in moves if m >= (0,) * segments]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest over 0..n-1 with the components of the links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            child = np.flatnonzero(label != np.arange(n))
            return child, label[child]
        label = new


def tile_links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``fps(fp, node)``, one row per fingerprint -> ``(a, b)`` nodes; a forest of each tile pair's links.

    ``fps`` is read several times, so pass a written table; neither column may be null.
    """
    base = 64 // segments + 1
    tiled = fps.select("fp", "node", _tile(F.col("fp"), segments).alias("tile"))
    # at most base ** segments rows (83,521 for four segments)
    kinds = tiled.groupBy("tile").agg(F.count("*").alias("n"))
    parts = (
        tiled.join(F.broadcast(kinds), "tile")
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / TILE_ROWS)).cast("int"))
        .groupBy("tile", "part")
        .agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes"))
    )
    offsets = F.array(*[F.lit(x) for x in _offsets(radius, segments)])
    other = parts.select(F.col("tile").alias("t2"), F.col("part").alias("p2"), F.col("fps").alias("fps2"), F.col("nodes").alias("nodes2"))
    ask = parts.select("*", F.explode(offsets).alias("d")).withColumn("t2", F.col("tile") + F.col("d"))
    ask = ask.join(F.broadcast(kinds.select(F.col("tile").alias("t2"))), "t2", "left_semi")
    # keys may wrap at a segment's end; such tiles are compared for nothing, never missed
    pairs = ask.join(other, "t2").filter((F.col("d") != 0) | (F.col("part") <= F.col("p2")))
    pairs = pairs.select("fps", "nodes", "fps2", "nodes2", ((F.col("d") == 0) & (F.col("part") == F.col("p2"))).alias("same"))
    assert base > radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (fa, oa), (na, _), (fb, ob), (nb, _) = (
                (np.asarray(b.column(c).values), np.asarray(b.column(c).offsets)) for c in range(4)
            )
            fa, fb = fa.view(np.uint64), fb.view(np.uint64)
            out_a, out_b = [], []
            for r, same in enumerate(b.column(4).to_pylist()):
                x = fa[oa[r] : oa[r + 1]]
                # a part with itself: the other side's copy may hold the rows in another order
                y = x if same else fb[ob[r] : ob[r + 1]]
                nodes = np.concatenate([na[oa[r] : oa[r + 1]], nb[ob[r] : ob[r + 1]]])
                ii, jj = [], []
                for s in range(0, len(x), 256):
                    near = np.bitwise_count(x[s : s + 256, None] ^ y) <= radius
                    i, j = np.nonzero(near)
                    if same:
                        i, j = i[i + s < j], j[i + s < j]
                    ii.append(i + s)
                    jj.append(j)
                i, j = np.concatenate(ii), np.concatenate(jj)
                if len(i):
                    child, top = forest(i, j if same else j + len(x), len(nodes))
                    out_a.append(nodes[child])
                    out_b.append(nodes[top])
            cat = lambda v: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([cat(out_a), cat(out_b)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is
    the smallest doc_id reachable.  Null, empty and blank texts have fingerprint zero
    and are linked like any other.  Repeated rows stay, each with the same values.  A
    row without doc_id gets the component of its fingerprint's other rows, or null if
    there is none; it links nothing by itself.  Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width), "fp")
    fps = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"), "fps"
    )
    comps = connected_components(tile_links(fps, radius, segments))
    known = fps.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(known, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def distinct_shingles(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, h, key)``: hashes of the distinct shingles, and one hash of that set."""
    hashed = bind(docs, "h", F.array_distinct(shingle_hashes(F.col("text"), width)))
    return hashed.select(F.col("doc_id").cast("long"), "h", F.xxhash64(F.array_sort("h")).alias("key"))


def wide_prints(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, key, n, fp0, fp1)``: 128 bits and the number of distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.asarray(b.column(1).offsets)
            values = np.asarray(b.column(1).values)
            z = values.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)  # splitmix64: other bits from the same hash
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            prints = [pa.array(majority_bits(v, ends).view(np.int64)) for v in (values, (z ^ (z >> np.uint64(31))).view(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(np.diff(ends).astype(np.int64)), *prints], names=["doc_id", "key", "n", "fp0", "fp1"]
            )

    return distinct_shingles(docs, width).mapInArrow(run, "doc_id long, key long, n long, fp0 long, fp1 long")


def _banded(nodes: DataFrame, cols: tuple[str, ...], weight: Column, most: int) -> DataFrame:
    """Pairs of tile parts that can hold near sets: ``cols`` of one, ``cols`` with a 2 of the other, and ``same``.

    Tiles are bands of shingle counts: sets with a Jaccard similarity of 0.8 have counts
    within a factor of 1.25, which is four bands (one more for rounding), so other tile
    pairs are skipped.  A tile has a part for each ``most`` of its rows' ``weight``.
    """
    tiled = nodes.filter("n > 0").withColumn("tile", F.floor(F.log(F.col("n")) * (4 / np.log(1.25))).cast("int"))
    kinds = tiled.groupBy("tile").agg(F.sum(weight).alias("weight"))  # some 200 rows
    parts = materialize(
        tiled.join(F.broadcast(kinds), "tile")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("weight") / most)).cast("int"))
        .groupBy("tile", "part").agg(F.collect_list(F.struct(*cols)).alias("m"))
        .select("tile", "part", *[F.col(f"m.{c}").alias(c) for c in cols]), "tiles"
    )
    names = parts.select("tile", "part")
    ask = names.select("tile", "part", F.explode(F.array(*[F.lit(d) for d in range(6)])).alias("d")).withColumn("t2", F.col("tile") + F.col("d"))
    ask = ask.join(names.select(F.col("tile").alias("t2"), F.col("part").alias("p2")), "t2").filter("d > 0 or part <= p2")
    other = parts.select(F.col("tile").alias("t2"), F.col("part").alias("p2"), *[F.col(c).alias(f"{c}2") for c in cols])
    return ask.join(parts, ["tile", "part"]).join(other, ["t2", "p2"]).select(
        *cols, *[f"{c}2" for c in cols], ((F.col("d") == 0) & (F.col("part") == F.col("p2"))).alias("same")
    )


def candidates(nodes: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """``nodes(id, n, fp0, fp1)`` -> ``(a, b)``: the closest partner of each node within ``radius`` bits.

    ``nodes`` is read several times, so pass a written table.
    """
    pairs = _banded(nodes, ("id", "n", "fp0", "fp1"), F.lit(1), WIDE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                one = whole.slice(r, 1)
                ids, n, f0, f1 = (np.asarray(one.column(c).flatten()) for c in range(4))
                ids2, n2, g0, g1 = (np.asarray(one.column(c).flatten()) for c in range(4, 8))
                if one.column(8)[0].as_py():  # the other side's copy may hold the rows in another order
                    ids2, n2, g0, g1 = ids, n, f0, f1
                f0, f1, g0, g1 = (v.view(np.uint64) for v in (f0, f1, g0, g1))
                best, at = np.full(len(ids2), 255, np.uint8), np.zeros(len(ids2), np.int64)
                for s in range(0, len(ids), 64):
                    x = slice(s, s + 64)
                    d = np.bitwise_count(f0[x, None] ^ g0) + np.bitwise_count(f1[x, None] ^ g1)
                    near = d <= radius
                    if not near.any():
                        continue
                    near &= ids[x, None] != ids2
                    near &= 5 * np.minimum(n[x, None], n2) >= 4 * np.maximum(n[x, None], n2)
                    d[~near] = 255
                    j, low = d.argmin(1), d.min(1)
                    i = np.flatnonzero(low < 255)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + s]), pa.array(ids2[j[i]]), pa.array(low[i].astype(np.int32))], names=["a", "b", "bits"])
                    i, low = d.argmin(0), d.min(0)
                    less = low < best
                    best[less], at[less] = low[less], ids[i[less] + s]
                j = np.flatnonzero(best < 255)
                yield pa.RecordBatch.from_arrays([pa.array(ids2[j]), pa.array(at[j]), pa.array(best[j].astype(np.int32))], names=["a", "b", "bits"])

    found = pairs.mapInArrow(run, "a long, b long, bits int")
    closest = found.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("m"))
    return materialize(closest.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct(), "candidates")


def similar(shared, a, b):
    """Whether sets of ``a`` and ``b`` elements with ``shared`` in common have a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def tile_forest(ids, comp, n, f0, f1, h, o, ids2, comp2, n2, g0, g1, h2, o2, same: bool, radius: int) -> list[tuple[int, int]]:
    """Verified links of two tile parts, of which only those that join components not joined so far.

    ``h`` and ``o`` are hashes of shingles and where each set begins.  Pairs within
    ``radius`` bits are compared shingle by shingle, a row against all of its partners at once.
    """
    _, local = np.unique(np.concatenate([h, h2]), return_inverse=True)
    mine, theirs = local[: len(h)], local[len(h) :]
    _, root = np.unique(np.concatenate([comp, comp2]), return_inverse=True)  # component of each row, of both parts
    left, right = root[: len(ids)], root[len(ids) :]  # views: a join below changes both
    seen = np.zeros(int(local.max(initial=-1)) + 1, bool)
    links = []
    for i in range(len(ids)):
        near = np.bitwise_count(f0[i] ^ g0) + np.bitwise_count(f1[i] ^ g1) <= radius
        near &= (right != left[i]) & (5 * np.minimum(n[i], n2) >= 4 * np.maximum(n[i], n2))
        if same:
            near[: i + 1] = False
        js = np.flatnonzero(near)
        if not len(js):
            continue
        seen[mine[o[i] : o[i + 1]]] = True
        sizes = o2[js + 1] - o2[js]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(o2[js] - starts, sizes)
        shared = np.add.reduceat(seen[theirs[at]].astype(np.int64), starts)
        seen[mine[o[i] : o[i + 1]]] = False
        for j in js[similar(shared, n[i], n2[js])].tolist():
            if left[i] != right[j]:
                links.append((int(ids[i]), int(ids2[j])))
                root[root == right[j]] = left[i]
                if same:
                    right[:] = left
    return links


def exact_links(nodes: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """``nodes(id, comp, n, fp0, fp1, h)`` -> ``(a, b)``: links that join different ``comp``.

    All pairs within ``radius`` bits and of a Jaccard similarity of 0.8 or more count; of
    those of a tile pair a forest leaves the task, never all pairs of a group, whether or
    not the pairs are similar enough.  ``nodes`` is read several times, so pass a written table.
    """
    pairs = _banded(nodes, ("id", "comp", "n", "fp0", "fp1", "h"), F.col("n"), SET_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                one = whole.slice(r, 1)

                def part(first: int) -> list[np.ndarray]:
                    flat = [np.asarray(one.column(first + c).flatten()) for c in range(5)]  # noqa: B023
                    sets = one.column(first + 5).flatten()  # noqa: B023
                    begin = np.asarray(sets.offsets).astype(np.int64)
                    return [*flat[:3], *[v.view(np.uint64) for v in flat[3:]], np.asarray(sets.flatten()), begin - begin[0]]

                same = one.column(12)[0].as_py()
                here = part(0)
                links = tile_forest(*here, *(here if same else part(6)), same, radius)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def shingle_sets(asked: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``(id, h)`` of classes ``asked(id, node, key)``: distinct shingles of their texts."""
    wanted = asked.select("id", F.col("node").alias("doc_id"), F.col("key").alias("own"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = distinct_shingles(texts, width).join(wanted, "doc_id").filter("key = own").select("id", "h")
    return materialize(sets.dropDuplicates(["id"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose sets of shingles have a Jaccard similarity of 0.8 or more."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return materialize(both.filter(similar(shared, F.size("ha"), F.size("hb"))).select("a", "b"), "links")


def near_copies(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs``: the smallest doc_id reachable.

    Texts are linked if the Jaccard similarity of their distinct shingles is 0.8 or more.
    Fingerprints only propose pairs; each proposal is verified on the shingles.  First every
    text is held against its closest one; then, among texts that have any proposal, all
    pairs that these links haven't joined yet are compared within tiles, from which only
    forests of verified links come.  Texts without words are one class.  A row without
    doc_id links nothing by itself.
    """
    prints = materialize(wide_prints(docs, width), "prints")
    classes = prints.groupBy("key", "n", "fp0", "fp1").agg(F.min("doc_id").alias("node")).filter("node is not null")
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    first = candidates(classes)
    asked = classes.join(first.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    sets = shingle_sets(asked, docs, width)
    links = verified(first, sets)
    found = connected_components(links).withColumnRenamed("node", "id")
    some = asked.join(found, "id", "left").join(sets, "id").select("id", F.coalesce("component", "id").alias("comp"), "n", "fp0", "fp1", "h")
    more = exact_links(materialize(some, "some"))
    comps = connected_components(links.unionByName(more)).withColumnRenamed("node", "id")
    known = classes.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = known.groupBy("component").agg(F.min("node").alias("component_id"))
    known = known.join(lowest, "component").select("key", "n", "fp0", "fp1", "component_id")
    return prints.join(known, ["key", "n", "fp0", "fp1"], "left").select("doc_id", "component_id")
