"""Source trees as formats of ``spark.read`` and ``spark.readStream``.

    register(spark)
    spark.read.format("source_tree").option("root", "/src").load().where("size <= 3145728 and extension in ('.py', '.go')")

Directories are planned as partitions, a few levels below the root, and each task walks its own. Filters on extension, size, mtime and path go to
the walk, so files that they rule out are never opened. As a stream each micro-batch has the files that were
changed since the last one.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from textloom.sources import tree

SCHEMA = "rel string, abs_path string, extension string, size long, mtime double, content string, error string"
#: Directories that are planned as partitions at least, if the tree has so many.
PARTITIONS = 64
#: A stream takes files that haven't changed for so many seconds, so that one being written isn't read half.
QUIET_SECONDS = 1.0


@dataclass
class Directory(InputPartition):
    """A directory, with all below it or its own files only."""

    path: str
    whole: bool
    since: float = 0.0
    until: float = float("inf")


def plan(root: str, wanted: int) -> list[Directory]:
    """Directories that make up a tree, each file in exactly one: levels are opened until there are enough."""
    open_, out = [root], []
    while open_ and len(open_) + len(out) < wanted:
        below = [e.path for d in open_ for e in tree.entries(d) if e.is_dir() and not tree.ignored(e.name)]
        out += [Directory(d, False) for d in open_]
        open_ = below
    return out + [Directory(d, True) for d in open_]


def files(part: Directory) -> Iterator[tuple[str, os.stat_result]]:
    pending = [part.path]
    while pending:
        for e in tree.entries(pending.pop()):
            if e.is_dir():
                if part.whole and not tree.ignored(e.name):
                    pending.append(e.path)
                continue
            try:
                st = os.stat(e.path)
            except OSError:
                continue
            if part.since < st.st_mtime <= part.until:
                yield e.path, st


def extension(path: str) -> str:
    return os.path.splitext("x" + os.path.basename(path))[1].lower()


class _Tree:
    """What a batch and a stream have in common."""

    def __init__(self, options: dict) -> None:
        if not options.get("root"):
            raise ValueError("source_tree needs the option root")
        self.root = os.path.abspath(options["root"])
        self.max_bytes = int(options.get("maxBytes", tree.MAX_BYTES))
        self.filters: list[tuple[str, str, object]] = []

    def _fits(self, path: str, st: os.stat_result) -> bool:
        value = {"size": st.st_size, "mtime": st.st_mtime, "extension": extension(path), "rel": os.path.relpath(path, self.root), "abs_path": path}
        tests = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        return all(tests[op](value[column], wanted) for column, op, wanted in self.filters)

    def rows(self, part: Directory) -> Iterator[tuple]:
        for path, st in files(part):
            if not self._fits(path, st):
                continue
            head = (os.path.relpath(path, self.root), path, extension(path), st.st_size, st.st_mtime)
            try:
                with open(path, "rb") as f:
                    yield *head, tree.decode(f.read(self.max_bytes + 1), self.max_bytes), None
            except OSError as e:
                yield *head, None, type(e).__name__


_PUSHED = {EqualTo: "=", In: "in", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}


class TreeReader(_Tree, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _PUSHED and column in ("size", "mtime", "extension", "rel", "abs_path") and f.value is not None:
                self.filters.append((column, _PUSHED[type(f)], tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[Directory]:
        return plan(self.root, PARTITIONS)

    def read(self, partition: Directory) -> Iterator[tuple]:
        return self.rows(partition)


class TreeStreamReader(_Tree, DataSourceStreamReader):
    """Offsets are times: a batch has the files that were changed after one and up to the next."""

    def initialOffset(self) -> dict:
        return {"mtime": 0.0}

    def latestOffset(self) -> dict:
        newest, quiet = 0.0, time.time() - QUIET_SECONDS
        for _, st in files(Directory(self.root, True, until=quiet)):
            newest = max(newest, st.st_mtime)
        return {"mtime": newest}

    def partitions(self, start: dict, end: dict) -> list[Directory]:
        return [Directory(p.path, p.whole, start["mtime"], end["mtime"]) for p in plan(self.root, PARTITIONS)] if end["mtime"] > start["mtime"] else []

    def read(self, partition: Directory) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    """Options: root, maxBytes (larger files have no content)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
