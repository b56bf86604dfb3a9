"""A number for every row of a global order without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with ``name`` counting from 1 in ``order`` (give it a unique tail to make it repeatable).

    Rows are range-partitioned and sorted in place; a row's number is its place in its partition plus the rows of the partitions before. The counts of
    partitions, one row each, are summed by a window that sees as many rows as there are partitions. The sorted table is checkpointed, so both
    readings see one and the same partitioning, also after an executor was lost.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        from kinfold.sources.store import shared_folder

        sc.setCheckpointDir(shared_folder(spark))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    dealt = dealt.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")
    return dealt.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_id", "_p", "_i", "_before")
