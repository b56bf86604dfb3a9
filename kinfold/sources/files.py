"""Files as rows.

``read_files`` uses Spark's ``binaryFile`` reader: distributed listing, size filter pushed to the scan, ``content`` read only if asked for. It skips names that begin with a
point or an underscore. ``walk`` is a Python data source that keeps those, prunes skipped directories while walking, and reports what could not be read; one
partition a root, for folders that the executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinfold.functions.paths import category, extension, file_name, in_excluded_dir, local_path, plain_path
from kinfold.schema import EXCLUDED_DIRS

#: Fixed value: the least size of a file in a duplicate scan.
SCAN_MIN_BYTES = 1024


def described(files: DataFrame) -> DataFrame:
    f = files.withColumn("name", file_name(F.col("path"))).withColumn("extension", extension(F.col("name")))
    return f.withColumn("category", category(F.col("extension")))


def read_files(spark: SparkSession, roots: list[str], recursive: bool = True, categories: list[str] | None = None, min_size: int = 0, max_size: int | None = None, content: bool = False) -> DataFrame:
    """path, name, extension, category, size, modified [, content] of files below the roots; each path once, skipped directories left out, unknown extensions dropped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(roots)
    found = found.filter(F.col("length") >= min_size)
    if max_size is not None:
        found = found.filter(F.col("length") <= max_size)
    cols = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.col("content")] if content else [])]
    files = described(found.select(*cols))
    known = files.filter(F.col("category").isin(*categories) if categories else F.col("category").isNotNull())
    kept = known.filter(outside_excluded(roots))
    out = kept.select("path", "name", "extension", "category", "size", "modified", *(["content"] if content else []))
    # overlapping roots list a file twice; one root never does
    return out.dropDuplicates(["path"]) if len(roots) > 1 else out


def outside_excluded(roots: list[str]):
    """No directory of the path below a root, nor the root itself, is one that scans skip."""
    out = F.lit(False)
    for root in roots:
        bare = root.split("://", 1)[-1].split(":", 1)[-1] if root.startswith("file:") else root
        bare = "/" + bare.strip("/")
        place = F.instr(F.col("path"), bare + "/")
        rest = F.substr(F.col("path"), place + len(bare) + 1)
        out = out | ((place > 0) & (in_excluded_dir(rest) | F.lit(os.path.basename(bare) in EXCLUDED_DIRS)))
    return ~out


class _Walker(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", options.get("path", "")).split("\n") if r]
        self.recursive = options.get("recursive", "true") == "true"
        self.prune = options.get("prune", "true") == "true"

    def partitions(self):
        return [InputPartition(r) for r in self.roots]

    def read(self, partition) -> Iterator[tuple]:
        root = partition.value
        stack = [root]
        if self.prune and os.path.basename(os.path.abspath(root)) in EXCLUDED_DIRS:
            return
        if os.path.isfile(root):
            s = os.stat(root)
            yield (root, s.st_size, int(s.st_mtime), "found")
            return
        while stack:
            here = stack.pop()
            try:
                entries = sorted(os.scandir(here), key=lambda e: e.name)
            except PermissionError:
                yield (here, None, None, "skipped_permission")
                continue
            except OSError:
                yield (here, None, None, "skipped_other")
                continue
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if self.recursive and not (self.prune and e.name in EXCLUDED_DIRS):
                            stack.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        yield (e.path, s.st_size, int(s.st_mtime), "found")
                except PermissionError:
                    yield (e.path, None, None, "skipped_permission")
                except OSError:
                    yield (e.path, None, None, "skipped_other")


class FileTree(DataSource):
    """Data source ``filetree``: every regular file below the roots, hidden ones too, and what could not be read."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, size long, modified_at long, status string"

    def reader(self, schema):
        return _Walker(self.options)


def walk(spark: SparkSession, roots: list[str], recursive: bool = True, prune: bool = True) -> DataFrame:
    """path, size, modified, status, name, extension, category of everything below the roots."""
    spark.dataSource.register(FileTree)
    rows = spark.read.format("filetree").option("roots", "\n".join(roots)).option("recursive", str(recursive).lower()).option("prune", str(prune).lower()).load()
    return described(rows.withColumn("modified", F.timestamp_seconds("modified_at")))


def listed(spark: SparkSession, roots: list[str], recursive: bool = True, categories: list[str] | None = None, min_size: int = 0, max_size: int | None = None) -> DataFrame:
    """path, name, extension, category, size, modified, status of a scan, each path once, no content read. Local roots are walked, hidden names and unreadable ones included; of others Spark lists what its readers show."""
    if all(local_path(r).startswith("/") or "://" not in r for r in roots):
        found = walk(spark, [os.path.abspath(local_path(r)) for r in roots], recursive)
        found = classify_status(found, categories, min_size, max_size)
    else:
        found = read_files(spark, roots, recursive, categories, min_size, max_size).withColumn("path", plain_path(F.col("path"))).withColumn("status", F.lit("found"))
    found = found.select("path", "name", "extension", "category", "size", "modified", "status")
    return found.dropDuplicates(["path"]) if len(roots) > 1 else found


def classify_status(files: DataFrame, categories: list[str] | None = None, min_size: int = 0, max_size: int | None = None) -> DataFrame:
    """``files`` of ``walk`` with the status of a scan: found, skipped_other (size out of range), unselected, no_extension, or the walk's own."""
    size = F.col("size")
    fits = (size >= min_size) & ((size <= max_size) if max_size is not None else F.lit(True))
    chosen = F.col("category").isin(*categories) if categories else F.col("category").isNotNull()
    status = F.when(F.col("status") != "found", F.col("status")).when(F.col("extension").isNull(), "no_extension").when(~F.coalesce(chosen, F.lit(False)), "unselected").when(~fits, "skipped_other").otherwise("found")
    return files.withColumn("status", status)
