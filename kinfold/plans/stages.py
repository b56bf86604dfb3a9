"""Cuts between the stages of a plan: work that is done once, and small inputs over all cores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from kinfold.sources.store import shared_folder


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if the plan knows it to be small (8 MB a core at most): a small file is often one row group and so one task. A larger table is never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * (8 << 20) else df


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows reads it, and never makes it again."""
    at = f"{shared_folder(df.sparkSession)}/kinfold/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
