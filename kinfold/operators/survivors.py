"""Which file of a group stays, and what happens to the others. Plans are DataFrames; deleting is opt-in."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.formats import delete_line

STRATEGIES = ("newest", "oldest", "largest")


def parse_strategy(text: str) -> str:
    if text.strip().lower() not in STRATEGIES:
        raise ValueError(f"unknown strategy {text!r}; known: {', '.join(STRATEGIES)}")
    return text.strip().lower()


def mark_survivors(entries: DataFrame, keep: str) -> DataFrame:
    """``entries`` (id, group_id, file_path, file_size, modified) with ``kept``. Ties: newest and largest keep the last id, oldest the first.

    The best of a group is a pre-aggregated maximum joined back, so a huge group is never sorted in one task.
    """
    keep = parse_strategy(keep)
    epoch = F.coalesce(F.col("modified").cast("long"), F.lit(0))
    key = {"newest": F.struct(epoch, F.col("id")), "oldest": F.struct(-epoch, -F.col("id")), "largest": F.struct(F.col("file_size"), F.col("id"))}[keep]
    best = entries.groupBy("group_id").agg(F.max(key).alias("_best"), F.count("*").alias("_n"))
    return entries.join(best, "group_id").withColumn("kept", (key == F.col("_best")) | (F.col("_n") < 2)).drop("_best", "_n")


def delete_plan(entries: DataFrame, groups: DataFrame, keep: str) -> DataFrame:
    """group_id, id, file_path, file_size, action line of every file that would go."""
    gone = mark_survivors(entries, keep).filter("not kept")
    g = groups.select(F.col("id").alias("group_id"), "similarity_score")
    return gone.join(g, "group_id").select("group_id", "id", "file_path", "file_size", delete_line(F.col("file_path"), F.col("file_size"), F.col("group_id"), F.col("similarity_score")).alias("action"))


def delete_stats(plan: DataFrame) -> DataFrame:
    """A dry run's one row: nothing deleted, nothing failed, as many actions as files."""
    return plan.agg(F.lit(0).alias("deleted"), F.lit(0).alias("failed"), F.count("*").alias("actions"))


def delete_files(plan: DataFrame) -> DataFrame:
    """Delete the planned files where the executors see them; path, deleted, action. Only files named in the plan are touched; a second try of a task finds them gone and says so."""

    def run(batches: Iterator):
        for batch in batches:
            done, lines = [], []
            for path in batch["file_path"]:
                try:
                    os.remove(path)
                    done.append(True)
                    lines.append(f"Deleted: {path}")
                except OSError as e:
                    done.append(False)
                    lines.append(f"Failed: {path} ({e.strerror})")
            batch = batch.assign(deleted=done, action=lines)
            yield batch[["file_path", "deleted", "action"]]

    return plan.select("file_path").mapInPandas(run, "file_path string, deleted boolean, action string")


def without(members: DataFrame, removed: DataFrame, least: int = 2) -> DataFrame:
    """Members of groups after files were removed; groups that fall under ``least`` files vanish."""
    left = members.join(removed.select("path"), "path", "left_anti")
    enough = left.groupBy("group_path").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("group_path")
    return left.join(enough, "group_path", "left_semi")
