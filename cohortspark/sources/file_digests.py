"""A data source of digests: files of any size are read block by block, and only digest states are kept.

    spark.dataSource.register(FileDigestSource)
    spark.read.format("file_digests").load("<folder or glob>")

gives a row per file: path, size, md5, sha1, sha256, sha512. Files are planned into tasks by their sizes, the largest
first to the task with the least, so a few large files do not wait behind many small ones. Columns that a query does not
need are digested all the same; name the digests that are needed with the option ``digests``, others are null then.
"""

from __future__ import annotations

import fnmatch
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that are read at a time, and bytes of files per task, about.
BLOCK_BYTES, TASK_BYTES = 4 << 20, 512 << 20
#: Files per task, at most.
TASK_FILES = 10_000
# The digests.
DIGESTS = ("md5", "sha1", "sha256", "sha512")
SCHEMA = "path string, size long, " + ", ".join(f"{name} string" for name in DIGESTS)


def digests_of(handle, names: tuple[str, ...], block_bytes: int = BLOCK_BYTES) -> tuple[int, dict[str, str]]:
    """Length and digests of an open file."""
    states, size = {name: hashlib.new(name) for name in names}, 0
    while block := handle.read(block_bytes):
        size += len(block)
        for state in states.values():
            state.update(block)
    return size, {name: state.hexdigest() for name, state in states.items()}


def planned(files: list[tuple[str, int]], tasks: int) -> list[list[str]]:
    """Files (name, size) dealt to tasks, the largest first to the task with the least."""
    heap = [(0, number) for number in range(tasks)]
    out: list[list[str]] = [[] for _ in heap]
    for name, size in sorted(files, key=lambda f: (-f[1], f[0])):
        held, number = heap[0]
        out[number].append(name)
        heapq.heapreplace(heap, (held + size + 1, number))
    return [names for names in out if names]


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class FileDigestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.names = tuple(options["digests"].split(",")) if "digests" in options else DIGESTS
        self.block_bytes = int(options.get("block_bytes", BLOCK_BYTES))
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def _listed(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        fixed = self.path.rstrip("/")
        while any(c in fixed for c in "*?["):
            fixed = fixed.rsplit("/", 1)[0]
        system, root = fs.FileSystem.from_uri(fixed)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        asked = root + self.path.rstrip("/")[len(fixed):]
        depth = asked.count("/")
        fits = (lambda p: True) if asked == root else (lambda p: p.count("/") == depth and fnmatch.fnmatchcase(p, asked))
        # as elsewhere in Spark, names with these beginnings are not data
        return system, [f for f in found if f.is_file and fits(f.path) and not f.base_name.startswith((".", "_"))]

    def partitions(self) -> list[_Files]:
        _, found = self._listed()
        files = [(f.path, f.size) for f in found]
        tasks = max(1, sum(s for _, s in files) // self.task_bytes, -(-len(files) // TASK_FILES), min(len(files), 8))
        return [_Files(names) for names in planned(files, tasks)] or [_Files([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fixed = self.path
        while any(c in fixed for c in "*?["):
            fixed = fixed.rsplit("/", 1)[0]
        system, _ = fs.FileSystem.from_uri(fixed.rstrip("/"))
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), *((name, pa.string()) for name in DIGESTS)])
        rows = []
        for name in partition.names:
            with system.open_input_stream(name) as handle:
                size, found = digests_of(handle, self.names, self.block_bytes)
            rows.append({"path": name, "size": size, **found})
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class FileDigestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FileDigestReader:
        return FileDigestReader(dict(self.options))


def file_digests(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Digests of the files below a folder or of those that match a pattern."""
    spark.dataSource.register(FileDigestSource)
    return spark.read.format("file_digests").options(**options).load(path)
