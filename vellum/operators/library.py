"""The library audit: everything that stored bundles promise, held against the files that are there.

Inputs are tables: ``bundles(slug, manifest, provenance, annotations)`` with the texts of those
files (null: no such file), ``files(slug, file, length)`` with every file, ``texts(slug,
file, body)`` with contents of descriptions, stored manifests and linked resources, ``links(slug,
ord, url, kind)`` as discovered in the manifests, and ``catalogue(dir)``.  Nothing is repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import ceil_div
from ..functions.urls import safe_relative
from ..scratch import spread, written
from .audit import missing_by_kind, reconcile, repeated_files
from .once import once

PROVENANCE = (
    "manifest_url string, manifest_file string, images array<struct<file:string,tile_dir:string>>, "
    "linked_resources array<struct<url:string,file:string,kind:string,sha256:string>>, linked_failures array<struct<url:string,kind:string,error:string>>"
)
INFO = "width long, height long, sizes array<struct<width:long,height:long>>, tiles array<struct<width:long,height:long,scaleFactors:array<long>>>"
MAX_TILES = 10_000_000


def advertised(descriptions: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, file, error)``: every size and tile that ``descriptions(keys, prefix, body)`` promise, and what is wrong with them.

    A tile's height defaults to its width; a number that is absent counts as 0.  A description that isn't JSON, without
    dimensions or tiles, or a profile with bad numbers or over MAX_TILES tiles is an error.
    """
    read = once(descriptions, "i", F.from_json("body", INFO))
    whole = F.expr("i.width > 0 and i.height > 0 and size(i.tiles) > 0")
    broken = F.when(F.try_parse_json("body").isNull(), "invalid description").when(~F.coalesce(whole, F.lit(False)), "invalid dimensions or no tiles")
    judged = read.withColumn("broken", broken)
    errors = [judged.filter("broken is not null").select(*keys, F.lit(None).cast("string").alias("file"), F.col("broken").alias("error"))]
    good = judged.filter("broken is null")
    size = good.select(*keys, "prefix", F.explode("i.sizes").alias("s"))
    sizes = size.select(
        *keys, F.when(F.expr("s.width > 0 and s.height > 0"), F.format_string("%s/full/%d,%d/0/default.jpg", "prefix", "s.width", "s.height")).alias("file"),
    ).withColumn("error", F.when(F.col("file").isNull(), "invalid size"))
    # an absent number is 0, and so an error: a null must not slip through comparisons
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    profile = good.select(*keys, "prefix", F.col("i.width").alias("w"), F.col("i.height").alias("h"), F.explode("i.tiles").alias("t"))
    profile = profile.withColumns({"tw": number("t.width"), "th": number("t.height")}).withColumn("th", F.expr("if(th > 0, th, tw)"))
    errors.append(profile.filter("tw <= 0").select(*keys, F.lit(None).cast("string").alias("file"), F.lit("invalid tile width").alias("error")))
    scaled = profile.filter("tw > 0").select(*keys, "prefix", "w", "h", "tw", "th", F.explode("t.scaleFactors").alias("f")).withColumn("f", number("f"))
    # a step beyond the image is one tile, so products stay small
    step = lambda side, edge: F.least(F.col(side).cast("decimal(38,0)") * F.col("f"), F.col(edge).cast("decimal(38,0)")).cast("long")
    huge = F.greatest(F.col("tw"), F.col("th")).cast("decimal(38,0)") * F.col("f") > F.lit(2**63 - 1)
    sized = scaled.withColumn("bad", F.when(F.expr("f <= 0"), "invalid scale factor").when(huge, "scale factor too large"))
    sized = sized.withColumns({"sx": F.when(F.col("bad").isNull(), step("tw", "w")), "sy": F.when(F.col("bad").isNull(), step("th", "h"))})
    sized = sized.withColumn("bad", F.coalesce("bad", F.when(ceil_div(F.col("w"), F.col("sx")) > F.lit(float(MAX_TILES)) / ceil_div(F.col("h"), F.col("sy")), "too many tiles")))
    errors.append(sized.filter("bad is not null").select(*keys, F.lit(None).cast("string").alias("file"), F.col("bad").alias("error")))
    rows = sized.filter("bad is null").withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1, F.col("sy"))))
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1, F.col("sx"))))
    cells = cells.withColumns({"rw": F.least("sx", F.col("w") - F.col("x")), "rh": F.least("sy", F.col("h") - F.col("y"))})
    tile = F.format_string("%s/%d,%d,%d,%d/%d,%d/0/default.jpg", "prefix", "x", "y", "rw", "rh", ceil_div(F.col("rw"), F.col("f")), ceil_div(F.col("rh"), F.col("f")))
    found = sizes.unionByName(cells.select(*keys, tile.alias("file"), F.lit(None).cast("string").alias("error")))
    for e in errors:
        found = found.unionByName(e)
    return found


def _problem(severity: str, path: Column, message: Column | str) -> list[Column]:
    text = F.lit(message) if isinstance(message, str) else message
    return [F.lit(severity).alias("severity"), path.alias("path"), text.alias("message")]


def _at(file: Column | str) -> Column:
    return F.concat(F.col("slug"), F.lit("/"), F.lit(file) if isinstance(file, str) else file)


def _absent(promised: DataFrame, files: DataFrame) -> DataFrame:
    """Problems of promised files ``(slug, file)`` that are missing or empty."""
    met = promised.distinct().join(files.groupBy("slug", "file").agg(F.max("length").alias("length")), ["slug", "file"], "left")
    message = F.when(F.col("length").isNull(), "missing or unreadable").when(F.col("length") == 0, "file is empty")
    return met.withColumn("m", message).filter("m is not null").select(*_problem("ERROR", _at(F.col("file")), F.col("m")))


def parsed(bundles: DataFrame) -> DataFrame:
    """``(slug, p, ok)``: provenance as it is read, and whether it is JSON; written once for all that look at it."""
    ok = F.try_parse_json("provenance").isNotNull().alias("ok")
    return written(bundles.select("slug", F.from_json("provenance", PROVENANCE).alias("p"), ok), "provenance")


def problems(
    bundles: DataFrame, files: DataFrame, texts: DataFrame, links: DataFrame, catalogue: DataFrame, provenance: DataFrame | None = None,
) -> DataFrame:
    """``(severity, path, message)`` of all findings; ERROR for what is broken, WARN for what a rerun would mend.

    ``provenance`` is :func:`parsed`, where it is there already.
    """
    json = lambda c: F.try_parse_json(c).isNotNull()
    safe = lambda c: F.coalesce(safe_relative(c), F.lit(False))
    out = []
    m = F.when(F.col("manifest").isNull(), "cannot read manifest").when(~json("manifest"), "invalid JSON")
    out.append(bundles.withColumn("m", m).filter("m is not null").select(*_problem("ERROR", _at("manifest.json"), F.col("m"))))
    m = F.when(F.col("provenance").isNull(), "cannot read provenance").when(~json("provenance"), "invalid provenance JSON")
    out.append(bundles.withColumn("m", m).filter("m is not null").select(*_problem("ERROR", _at("provenance.json"), F.col("m"))))
    out.append(bundles.filter(F.col("annotations").isNotNull() & ~json("annotations")).select(*_problem("ERROR", _at("annotations.json"), "invalid JSON")))
    read = (parsed(bundles) if provenance is None else provenance).filter("ok").select("slug", "p")
    prov = _at("provenance.json")

    active = read.select("slug", F.col("p.manifest_file").alias("file")).filter("file <> ''")
    out.append(active.filter(~safe(F.col("file"))).select(*_problem("ERROR", prov, "unsafe manifest file")))
    named = active.filter(safe(F.col("file"))).join(texts, ["slug", "file"], "left")
    m = F.when(F.col("body").isNull(), "cannot read active manifest").when(~json("body"), "invalid JSON")
    out.append(named.withColumn("m", m).filter("m is not null").select(*_problem("ERROR", _at(F.col("file")), F.col("m"))))

    images = read.select("slug", F.posexplode("p.images").alias("pos", "i")).select("slug", "pos", "i.file", "i.tile_dir")
    linked = read.select("slug", F.posexplode("p.linked_resources").alias("pos", "r")).select("slug", "pos", "r.*")
    for kind, rows in (("image", images), ("linked resource", linked)):
        out.append(rows.filter(~safe(F.col("file"))).select(*_problem("ERROR", prov, F.concat(F.lit(f"{kind} "), F.col("pos") + 1, F.lit(" has an unsafe file path")))))
    twice = repeated_files(images.filter(safe(F.col("file"))), "slug", "file")
    out.append(twice.select(*_problem("ERROR", prov, F.concat(F.lit("repeated image file "), F.col("file")))))

    tiled = images.filter(safe(F.col("file")) & (F.coalesce("tile_dir", F.lit("")) != ""))
    out.append(tiled.filter(~safe(F.col("tile_dir"))).select(*_problem("ERROR", prov, F.concat(F.lit("image "), F.col("pos") + 1, F.lit(" has an unsafe tile folder")))))
    info = tiled.filter(safe(F.col("tile_dir"))).select("slug", F.col("tile_dir").alias("prefix"), F.concat("tile_dir", F.lit("/info.json")).alias("file")).distinct()
    described = spread(written(info.join(texts, ["slug", "file"], "left"), "descriptions"), ["slug"])  # many files of each
    out.append(described.filter("body is null").select(*_problem("ERROR", _at(F.col("file")), "cannot read tile description")))
    promised = advertised(described.filter("body is not null").select("slug", "prefix", "body"), ["slug", "prefix"])
    out.append(promised.filter("error is not null").select(*_problem("ERROR", _at(F.concat("prefix", F.lit("/info.json"))), F.col("error"))))
    every = [images.filter(safe(F.col("file"))).select("slug", "file"), linked.filter(safe(F.col("file"))).select("slug", "file"), promised.filter("file is not null").select("slug", "file")]
    out.append(_absent(every[0].unionByName(every[1]).unionByName(every[2]), files))

    held = linked.filter(safe(F.col("file")) & (F.coalesce("sha256", F.lit("")) != "")).join(texts, ["slug", "file"])
    out.append(held.filter(F.sha2(F.col("body").cast("binary"), 256) != F.col("sha256")).select(*_problem("ERROR", _at(F.col("file")), "SHA-256 does not match provenance")))
    stored = linked.select("slug", "url").withColumn("stored", F.lit(True)).distinct()
    gone = links.join(stored, ["slug", "url"], "left_anti").join(read.select("slug"), "slug", "left_semi")
    gone = gone.groupBy("slug", "kind").agg(F.count("*").alias("missing"), F.min_by("url", "ord").alias("first"))
    out.append(gone.select(*_problem("WARN", _at("manifest.json"), F.concat("missing", F.lit(" linked "), "kind", F.lit(" not preserved, first "), "first"))))
    failed = read.select("slug", F.explode("p.linked_failures").alias("f"))
    where = F.when(F.coalesce("f.url", F.lit("")) != "", F.col("f.url")).otherwise(prov)
    out.append(failed.select(*_problem("WARN", where, F.concat(F.lit("unpreserved linked "), F.coalesce("f.kind", F.lit("")), F.lit(": "), F.coalesce("f.error", F.lit(""))))))

    state = reconcile(catalogue.select("dir", F.lit(1).alias("stamp")).distinct(), bundles.select(F.col("slug").alias("dir"), F.lit(1).alias("stamp")), "dir")
    message = F.concat("state", F.lit(" catalogue entry "), "dir")
    out.append(state.filter("state in ('stale', 'missing')").select(*_problem("WARN", F.lit("catalogue"), message)))
    found = out[0]
    for rows in out[1:]:
        found = found.unionByName(rows)
    return found


def reruns(bundles: DataFrame, links: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """``(url)`` of manifests whose linked resources are missing, or failed when they were stored."""
    read = parsed(bundles) if provenance is None else provenance
    stored = read.select("slug", F.explode("p.linked_resources").alias("r")).select("slug", "r.url")
    gone = links.select("slug", "url").join(stored, ["slug", "url"], "left_anti").select("slug")
    failed = read.filter(F.size("p.linked_failures") > 0).select("slug")
    return read.join(gone.union(failed).distinct(), "slug", "left_semi").select(F.col("p.manifest_url").alias("url")).filter("url <> ''").distinct()


def report(bundles: DataFrame, found: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """One row: bundles, images, pyramids and linked resources that provenance names, errors, warnings, and whether it is healthy."""
    read = parsed(bundles) if provenance is None else provenance
    some = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0))
    tiled = F.filter("p.images", lambda i: F.coalesce(i["tile_dir"], F.lit("")) != "")
    counts = read.agg(F.count("*").alias("bundles"), some(F.col("p.images")).alias("images"), some(tiled).alias("pyramids"), some(F.col("p.linked_resources")).alias("linked"))
    marks = found.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARN").alias("warnings"))
    return counts.join(marks).withColumn("healthy", F.col("errors") == 0)  # one row each


__all__ = ["advertised", "missing_by_kind", "problems", "report", "reruns"]
