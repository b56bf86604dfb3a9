"""Reports over groups: totals, histogram, numbered lists, pages, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.formats import fixed, quoted

PAGE = 50
CSV_HEADER = "group_id,file_type,similarity,file_path,file_size_bytes,modified_time"


def totals(groups: DataFrame) -> DataFrame:
    """Groups and files in them."""
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n_files"), F.lit(0)).cast("long").alias("n_files"))


def histogram(groups: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Groups by similarity in percent: from 95, from 80, from 60, below."""
    p = F.col(similarity) * 100
    return groups.agg(F.count_if(p >= 95).alias("above_95"), F.count_if((p >= 80) & (p < 95)).alias("from_80"), F.count_if((p >= 60) & (p < 80)).alias("from_60"), F.count_if(p < 60).alias("below_60"))


def numbered(groups: DataFrame, *order) -> DataFrame:
    """``groups`` with ``number`` from 1 in the given order.

    Numbers over all groups need one order; it is taken by a range sort and counts a partition (``plans.ranks``), not by a window without a partition.
    """
    from kinfold.plans.ranks import with_rank

    return with_rank(groups, list(order), "number")


def page(groups: DataFrame, number: int, size: int = PAGE, order=None) -> DataFrame:
    """Page ``number`` (from 0, cut to the last one) of groups by falling similarity, then path."""
    order = order or [F.desc("similarity"), F.asc("first_path")]
    ranked = numbered(groups, *order)
    n = ranked.count()
    first = min(max(0, number), max(0, (n - 1) // size)) * size
    return ranked.filter(F.col("number").between(first + 1, first + size)).orderBy("number").drop("number")


def csv_lines(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Export lines without the header: the path always quoted, similarity with four digits, a null time empty."""
    g = groups.select(F.col("id").alias("group_id"), "file_type", "similarity_score")
    j = entries.join(g, "group_id")
    line = F.concat_ws(",", F.col("group_id").cast("string"), "file_type", fixed(F.col("similarity_score"), 4), quoted(F.col("file_path")), F.col("file_size").cast("string"), F.coalesce("modified_time", F.lit("")))
    return j.select("group_id", "id", line.alias("line"))


def write_csv(groups: DataFrame, entries: DataFrame, path: str) -> None:
    lines = csv_lines(groups, entries)
    spark = groups.sparkSession
    header = spark.createDataFrame([(-1, -1, CSV_HEADER)], "group_id long, id long, line string")
    header.unionByName(lines).repartitionByRange("group_id", "id").sortWithinPartitions("group_id", "id").select("line").write.text(path)


def display_csv_lines(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """The short export: groups numbered from 1, no time."""
    g = numbered(groups.select(F.col("id").alias("group_id"), "file_type", "similarity_score"), "group_id")
    j = entries.join(g, "group_id")
    return j.select("number", "id", F.concat_ws(",", F.col("number").cast("string"), "file_type", fixed(F.col("similarity_score"), 4), quoted(F.col("file_path")), F.col("file_size").cast("string")).alias("line"))


def json_groups(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """One JSON object a group with its files, for groups that fit a row."""
    files = entries.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("file_path", F.col("file_size").alias("file_size_bytes"), "modified_time"))).alias("files"))
    j = groups.select("session_id", F.col("id").alias("group_id"), "file_type", F.col("similarity_score").alias("similarity")).join(files, "group_id")
    return j.select("session_id", "group_id", F.to_json(F.struct("group_id", "file_type", "similarity", "files")).alias("json"))


def write_json(groups: DataFrame, entries: DataFrame, session: int, path: str) -> None:
    """One JSON document, ``{"session_id": .., "groups": [..]}``, a group a line; its part files in order are the document. No group of the list waits in one task for the others."""
    spark = groups.sparkSession
    lines = numbered(json_groups(groups, entries).select("group_id", "json"), "group_id")
    body = lines.select(F.col("number"), F.concat(F.when(F.col("number") > 1, ",").otherwise(""), F.col("json")).alias("value"))
    ends = spark.createDataFrame([(0, f'{{"session_id": {int(session)}, "groups": ['), (1 << 62, "]}")], "number long, value string")
    body.unionByName(ends).repartitionByRange("number").sortWithinPartitions("number").select("value").write.text(path)


def export(groups: DataFrame, entries: DataFrame, path: str, fmt: str, session: int = 0) -> None:
    """Write as ``json`` or ``csv``; another format is an error."""
    if fmt == "json":
        write_json(groups, entries, session, path)
    elif fmt == "csv":
        write_csv(groups, entries, path)
    else:
        raise ValueError(f"unknown export format {fmt!r}; known: csv, json")


def of_category(groups: DataFrame, category: str | None) -> DataFrame:
    """Groups of one category, or all of them."""
    return groups if category is None else groups.filter(F.col("file_type") == category)


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("n"))
