"""Stored bundles as data sources.

``bundles``: a row is one bundle, ``(slug, manifest, provenance, annotations)`` with the texts of its documents (null: no
such file).  ``bundle_files`` lists instead of reading: ``(slug, file, length, modified)`` of every file of
every bundle.  A folder with a manifest is a bundle, and nothing below it is; folders whose names begin with
``.`` or ``_`` are no bundles.  A partition is one folder below the root, so folders are listed and read by
the executors that need them.  Paths are what pyarrow's file systems open: local folders, ``hdfs://``, ``s3://``.

:func:`load` takes the slugs or the prefix that are asked for, and looks at their folders alone.
``bundles_by_filter`` takes them from a query's filters on ``slug`` (equality, ``in``, a prefix); load it
anew for each query, as Spark 4.1 keeps the filters of one query for the next one of the same DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "slug string, manifest string, provenance string, annotations string"
FILE_SCHEMA = "slug string, file string, length long, modified timestamp"
#: Documents of a bundle; a folder with the first is one.
FILES = ("manifest.json", "provenance.json", "annotations.json")
BATCH = 256


@dataclass
class Folder(InputPartition):
    """A folder below the root, and whether it is read with all below it or looked at alone."""

    path: str
    deep: bool = True


def _names(store: fs.FileSystem, path: str) -> tuple[set[str], list[str]]:
    """Files and folders in a folder; hidden folders are none of the library's bundles."""
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    folders = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name[0] not in "._")
    return {f.base_name for f in found if f.type == fs.FileType.File}, folders


class BundleReader(DataSourceReader):
    def __init__(self, root: str, slugs: set[str] | None = None, prefix: str = ""):
        self.root = root.rstrip("/")
        self.slugs, self.prefix = slugs, prefix

    def _store(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.root or self.root.startswith("file:"):
            return fs.FileSystem.from_uri(self.root)
        return fs.LocalFileSystem(), self.root

    def partitions(self) -> list[Folder]:
        """The folders to look at.  Only the first level of names is listed here; with slugs asked for, nothing is."""
        if self.slugs is not None:
            safe = (s for s in self.slugs if s and s.startswith(self.prefix) and not {"", ".", ".."} & set(s.split("/")))
            return [Folder(s, deep=False) for s in sorted(safe)] or [Folder("", deep=False)]
        store, root = self._store()
        above = self.prefix.rpartition("/")[0]
        names = _names(store, f"{root}/{above}" if above else root)[1]
        paths = [f"{above}/{n}" if above else n for n in names]
        # the folder of the prefix may be a bundle of its own
        fits = [Folder(p) for p in paths if p.startswith(self.prefix) or self.prefix.startswith(p)]
        return fits or [Folder("", deep=False)]

    def _found(self, partition: Folder, store: fs.FileSystem, root: str) -> Iterator[tuple[str, set[str]]]:
        """Bundles of a partition, each with the names of its files."""
        above = partition.path.split("/")[:-1]
        if not partition.path or any(FILES[0] in _names(store, f"{root}/{'/'.join(above[:n])}")[0] for n in range(1, len(above) + 1)):
            return  # below a bundle
        left = [partition.path]
        while left:
            slug = left.pop()
            files, folders = _names(store, f"{root}/{slug}")
            if FILES[0] in files:
                if slug.startswith(self.prefix):
                    yield slug, files
            elif partition.deep:  # nothing below a bundle is one
                left += [f"{slug}/{n}" for n in reversed(folders)]

    def _rows(self, store: fs.FileSystem, root: str, slug: str, files: set[str]) -> Iterator[tuple]:
        yield slug, *(self._text(store, f"{root}/{slug}/{f}") if f in files else None for f in FILES)

    #: Names and kinds of what :meth:`_rows` makes.
    columns = {"slug": pa.string(), "manifest": pa.string(), "provenance": pa.string(), "annotations": pa.string()}

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, root = self._store()
        rows: list[tuple] = []
        for slug, files in self._found(partition, store, root):
            for row in self._rows(store, root, slug, files):
                rows.append(row)
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        values = list(zip(*rows, strict=True)) or [()] * len(self.columns)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, self.columns.values(), strict=True)], names=list(self.columns))

    def _text(self, store: fs.FileSystem, path: str) -> str:
        with store.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")


class FilteredReader(BundleReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("slug",):
                asked = set(f.value if isinstance(f, In) else [f.value])
                self.slugs = asked if self.slugs is None else self.slugs & asked
            elif isinstance(f, StringStartsWith) and f.attribute == ("slug",):
                if not (f.value.startswith(self.prefix) or self.prefix.startswith(f.value)):
                    self.slugs = set()  # no slug begins both ways
                self.prefix = max(self.prefix, f.value, key=len)
            else:
                yield f


class FileReader(BundleReader):
    columns = {"slug": pa.string(), "file": pa.string(), "length": pa.int64(), "modified": pa.timestamp("us", "UTC")}

    def _rows(self, store: fs.FileSystem, root: str, slug: str, files: set[str]) -> Iterator[tuple]:
        left = [""]
        while left:  # a folder at a time: a pyramid has tens of thousands of tiles
            at = left.pop()
            for f in store.get_file_info(fs.FileSelector(f"{root}/{slug}/{at}".rstrip("/"))):
                if f.type == fs.FileType.Directory:
                    left.append(f"{at}{f.base_name}/")
                elif f.type == fs.FileType.File:
                    yield slug, f"{at}{f.base_name}", f.size, f.mtime


class Bundles(DataSource):
    """Options: ``path``; ``slugs``, a JSON list; ``prefix``."""

    made: type[BundleReader] = BundleReader

    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BundleReader:
        asked = self.options.get("slugs")
        return self.made(self.options["path"], None if asked is None else set(json.loads(asked)), self.options.get("prefix", ""))


class BundleFiles(Bundles):
    made = FileReader

    @classmethod
    def name(cls) -> str:
        return "bundle_files"

    def schema(self) -> str:
        return FILE_SCHEMA


class FilteredBundles(Bundles):
    made = FilteredReader

    @classmethod
    def name(cls) -> str:
        return "bundles_by_filter"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let filters reach those that take them."""
    for source in (Bundles, BundleFiles, FilteredBundles):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, root: str, slugs: Iterable[str] | None = None, prefix: str = "", kind: str = "bundles") -> DataFrame:
    """Bundles (or their files: ``kind="bundle_files"``) of a library; of these ``slugs``, and of slugs that begin with ``prefix``, alone."""
    register(spark)
    source = spark.read.format(kind).option("prefix", prefix)
    if slugs is not None:
        source = source.option("slugs", json.dumps(sorted(slugs)))
    return source.load(root)
