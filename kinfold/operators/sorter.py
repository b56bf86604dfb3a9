"""Where each file goes: destination folders, clash suffixes, counts; moving is opt-in."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.paths import category, extension, file_name
from kinfold.plans.ranks import with_rank


def destinations(files: DataFrame, root: str, sub_folder: Column | None = None) -> DataFrame:
    """path, name, extension, status and dest_dir: ``root/<category>s[/<class>]``, ``others`` for unknown extensions; files without an extension are skipped."""
    f = files.withColumn("name", file_name(F.col("path"))).withColumn("extension", extension(F.col("name")))
    kind = category(F.col("extension"))
    folder = F.coalesce(F.concat(kind, F.lit("s")), F.lit("others"))
    sub = F.when(kind == "image", sub_folder) if sub_folder is not None else F.lit(None).cast("string")
    status = F.when(F.col("extension").isNull(), "skipped").otherwise("moved")
    return f.select("path", "name", "extension", status.alias("status"), F.when(F.col("extension").isNotNull(), F.concat_ws("/", F.lit(root.rstrip("/")), folder, sub)).alias("dest_dir"))


def split_name(name: Column) -> tuple[Column, Column]:
    """Stem and extension with its point; a name whose only point leads it is all stem."""
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.substr(name, F.lit(1), F.length(name) - F.length(ext)), ext


def resolve(plan: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``plan`` with ``dest_path``: the k-th file of a name in a folder gets ``_k`` from the second on.

    Suffixes that another file of the folder bears, or that ``taken`` (dest_path) holds, are skipped: file k takes the k-th free number. A taken number with t free ones below it stands
    before file t, so with files and taken numbers in one order a file's place in its group is its number. Places come from ``with_rank``: no task or row holds all files of a name.
    """
    stem, ext = split_name(F.col("name"))
    group = ["dest_dir", "name"]

    def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
        """``rows`` with their place in their group, from 0."""
        ranked = with_rank(rows, [*group, *order], "_g")
        first = ranked.groupBy(*group).agg(F.min("_g").alias("_first"))
        return ranked.join(first, group).withColumn(name, F.col("_g") - F.col("_first")).drop("_g", "_first")

    files = placed(plan.filter("status = 'moved'").select("path", *group), ["path"], "_k")
    groups = files.select(*group).distinct()
    # names that files of a folder bear themselves block generated names only; what lies there blocks both
    there = taken.select("dest_path") if taken is not None else groups.select(F.lit("").alias("dest_path")).limit(0)
    own = groups.select(F.concat_ws("/", *group).alias("dest_path"))
    made = own.unionByName(there).select(F.regexp_extract("dest_path", r"^(.*)/[^/]*$", 1).alias("dest_dir"), F.regexp_extract("dest_path", r"([^/]*)$", 1).alias("_n"))
    parts = r"^(.+)_([1-9][0-9]{0,17})(\.[^.]*)?$"
    made = made.select("dest_dir", F.concat(F.regexp_extract("_n", parts, 1), F.regexp_extract("_n", parts, 3)).alias("name"), F.nullif(F.regexp_extract("_n", parts, 2), F.lit("")).cast("long").alias("_b"))
    base = there.select(F.regexp_extract("dest_path", r"^(.*)/[^/]*$", 1).alias("dest_dir"), F.regexp_extract("dest_path", r"([^/]*)$", 1).alias("name"), F.lit(0).cast("long").alias("_b"))
    blocked = made.filter("_b is not null").unionByName(base).distinct().join(groups, group, "left_semi")
    blocked = placed(blocked, ["_b"], "_r").select(*group, (F.col("_b") - F.col("_r")).alias("_k"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("path"))
    both = blocked.unionByName(files.select(*group, "_k", F.lit(1).alias("_kind"), "path"))
    number = placed(both, ["_k", "_kind", "path"], "_i").filter("_kind = 1")
    dest = F.when(F.col("_i") == 0, F.concat_ws("/", *group)).otherwise(F.concat(F.col("dest_dir"), F.lit("/"), stem, F.lit("_"), F.col("_i").cast("string"), ext))
    return number.select("path", "name", "dest_dir", dest.alias("dest_path"))


def stats(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "moved").alias("moved"), F.lit(0).cast("long").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"))


def move_files(resolved: DataFrame) -> DataFrame:
    """Carry a resolved plan out where the executors see the files: rename, else copy and remove. path, dest_path, moved. A task done twice finds the source gone and the target there, which counts as moved."""

    def run(batches: Iterator):
        for batch in batches:
            ok = []
            for src, dst in zip(batch["path"], batch["dest_path"], strict=True):
                try:
                    os.makedirs(os.path.dirname(dst), exist_ok=True)
                    if os.path.exists(src):
                        shutil.move(src, dst)
                    ok.append(os.path.exists(dst))
                except OSError:
                    ok.append(False)
            yield batch.assign(moved=ok)

    return resolved.select("path", "dest_path").mapInPandas(run, "path string, dest_path string, moved boolean")
