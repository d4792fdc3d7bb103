"""Source trees as DataFrames: a Python data source that lists with ignore rules and reads whole files.

Spark's own file sources drop empty files and names that begin with `_` or `.`; this one doesn't. The folder must be
visible to driver and executors alike. Anything unreadable fails the query: there are no partial results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ready
from .ignore import walk

#: Up to so many files are read in one partition.
SMALL_TREE = 128
#: Files beyond that go to partitions of about so many bytes.
PARTITION_BYTES = 32 << 20
DETECTION_BYTES = 16 * 1024


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def listed(path: str, use_git: bool = True) -> list[str]:
    """Files of a folder by its rules, or a file itself, to which none applies."""
    if os.path.isdir(path):
        return list(walk(Path(path), use_git))
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: no such file or directory")
    if not os.path.isfile(path):
        raise ValueError(f"{path} is not a regular file or directory")
    with open(path, "rb"):
        return [path]


def dealt(paths: list[str], tasks: int | None) -> list[list[str]]:
    """Lists of files by partition: one for a small tree or one task, else by size."""
    if len(paths) <= SMALL_TREE or tasks is not None and tasks <= 1:
        return [paths] if paths else []
    sizes = [os.lstat(p).st_size for p in paths]
    least = max(1, sum(sizes) // tasks) if tasks else PARTITION_BYTES
    out: list[list[str]] = [[]]
    held = 0
    for p, n in zip(paths, sizes, strict=True):
        if out[-1] and held + n > least:
            out.append([])
            held = 0
        out[-1].append(p)
        held += n
    return out


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.use_git = str(options.get("all", "false")).lower() != "true"
        self.tasks = int(options["threads"]) if options.get("threads") else None

    def partitions(self) -> list[Paths]:
        return [Paths(x) for x in dealt(listed(self.path, self.use_git), self.tasks)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                first = f.read(DETECTION_BYTES)
                if b"\0" in first:  # no text: its bytes stay where they are
                    continue
                yield path, first + f.read()


class SourceTree(DataSource):
    """spark.read.format("source_tree").option("all", ...).option("threads", ...).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, all_files: bool = False, threads: int | None = None) -> DataFrame:
    """(path, content) of a folder's or a file's text candidates."""
    ready(spark).dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("all", str(all_files).lower())
    return (reader.option("threads", threads) if threads is not None else reader).load(path)
