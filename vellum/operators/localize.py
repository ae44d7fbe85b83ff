"""Documents rewritten to stored copies.

A document is a tree without bounded depth, so each is rewritten by one Arrow-batched
function; the stored targets of a document come to it by a join, never by broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..jsontree import decode, encode


def node_id(node: object) -> tuple[str, str]:
    """Name and value of the id member; ``@id`` goes first when documents are rewritten."""
    if isinstance(node, dict):
        for name in ("@id", "id"):
            if isinstance(node.get(name), str):
                return name, node[name]
    return "", ""


def thumbnail_url(value: object) -> str:
    """A string, an object's id, or the first of a list that has one."""
    left = [value]
    while left:
        x = left.pop()
        if isinstance(x, list):
            left += reversed(x)
        elif found := x if isinstance(x, str) else node_id(x)[1]:
            return found
    return ""


def service_anchor(service: object) -> str:
    options = service if isinstance(service, list) else [service]
    return next((i for i in (node_id(s)[1] for s in options) if i), "")


class Localizer:
    """``targets``: dicts with anchor, image, service, w, h; ``links``: stored file by URL."""

    def __init__(self, targets: list[dict], links: dict[str, str], base: str):
        self.targets = {t["anchor"]: t for t in targets}
        self.links, self.base = {u: f for u, f in links.items() if f}, base

    def match(self, url: str) -> dict | None:
        """The target whose anchor is the URL or its longest ancestor at a '/'."""
        while url:
            if url in self.targets:
                return self.targets[url]
            url = url.rpartition("/")[0]
        return None

    def _image(self, node: dict, canvas: dict | None) -> bool:
        name, value = node_id(node)
        target = self.match(value) or self.match(service_anchor(node.get("service")))
        if not target or not name:
            return False
        node[name], node["format"] = target["image"], "image/jpeg"
        node.pop("service", None)
        if target.get("service"):
            node["service"] = [{"id": target["service"], "type": "ImageService3", "profile": "level0"}]
            if (target.get("w") or 0) > 0 and (target.get("h") or 0) > 0:
                for sized in filter(None, (node, canvas)):
                    sized["width"], sized["height"] = target["w"], target["h"]
        return True

    def rewrite(self, root: object) -> object:
        """``root`` changed in place: stored images and files, and no thumbnails but stored ones.

        An image that is stored isn't looked into.  Nodes wait on a stack, each with the canvas it
        stands in; a node's thumbnail is judged when all below it are done.
        """
        top = [root]
        left: list[tuple] = [(top, 0, None)]
        while left:
            holder, name, canvas = left.pop()
            if name is None:
                if not thumbnail_url(holder["thumbnail"]).startswith(self.base):
                    del holder["thumbnail"]
                continue
            node = holder[name]
            if isinstance(node, str):
                holder[name] = self.links.get(node, node)
            elif isinstance(node, list):
                left += [(node, k, canvas) for k in range(len(node) - 1, -1, -1)]
            elif isinstance(node, dict) and not self._image(node, canvas):
                if "thumbnail" in node:
                    left.append((node, None, None))
                inside = node if str(node.get("type") or node.get("@type") or "").endswith("Canvas") else canvas
                # sizes are left alone: an image below may set its canvas's
                left += [(node, member, inside) for member in reversed(node) if member not in ("width", "height")]
        return top[0]


def localize(documents: DataFrame, key: str, body: str, targets: DataFrame, links: DataFrame, base: str) -> DataFrame:
    """``(key, body)`` with stored images, linked files and thumbnails; other documents stay as they are.

    ``targets(key, anchor, image, service, w, h)`` and ``links(key, url, file)`` are gathered
    per document.  A body that isn't JSON, or nests too deep, stays unchanged.
    """
    t = targets.groupBy(key).agg(F.collect_list(F.struct("anchor", "image", "service", "w", "h")).alias("t"))
    m = links.groupBy(key).agg(F.collect_list(F.struct("url", "file")).alias("l"))
    joined = documents.select(key, body).join(t, key, "left").join(m, key, "left")

    @F.pandas_udf("string")
    def run(bodies: pd.Series, targets: pd.Series, links: pd.Series) -> pd.Series:
        def one(text, ts, ls):
            try:
                tree = decode(text)
            except ValueError:
                return text
            made = Localizer(list(ts if ts is not None else []), {x["url"]: x["file"] for x in (ls if ls is not None else [])}, base)
            return encode(made.rewrite(tree))

        return pd.Series([one(*row) for row in zip(bodies, targets, links, strict=True)])

    return joined.select(key, run(F.col(body), "t", "l").alias(body))


def with_request_id(info: Column, url: Column) -> Column:
    """An image description with the ``id`` it is asked for under."""
    shape = "`@context` string, id string, type string, protocol string, profile string, width bigint, height bigint, sizes array<struct<width:bigint,height:bigint>>, tiles array<struct<width:bigint,scaleFactors:array<bigint>>>"
    return F.to_json(F.from_json(info, shape).withField("id", url))
