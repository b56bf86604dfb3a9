"""Incremental rescans: signatures are computed for new or changed files only.

``signed`` is the batch form and the default: cache hits by (path, size, time, category), the rest computed, the cache merged. ``watch`` runs the same on ``binaryFile`` streams, whose
content column is never asked for; that source reports a file once, so it covers additions, not rewrites.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.paths import plain_path
from kinfold.schema import CATEGORIES
from kinfold.sources.store import SessionStore, probe

KEYS = ["file_path", "file_size", "modified_at", "category"]


def keyed(files: DataFrame) -> DataFrame:
    """``files`` with the cache's key columns."""
    return files.withColumn("file_path", F.col("path")).withColumn("file_size", F.col("size")).withColumn("modified_at", F.unix_seconds("modified"))


def split_by_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Keyed ``files`` with ``signature`` and ``from_cache``."""
    return probe(files, cache.select(*KEYS, "signature"), KEYS).withColumn("from_cache", F.col("signature").isNotNull())


def hit_counts(split: DataFrame) -> DataFrame:
    return split.agg(F.count_if("from_cache").alias("cached"), F.count_if(~F.col("from_cache")).alias("computed"))


def signed(files: DataFrame, store: SessionStore, detectors: dict, context: tuple) -> tuple[DataFrame, dict[str, int]]:
    """``files`` (path, category, size, modified, ...; no content) with signatures, cached or new (null ones dropped), and how many were which. The cache is probed on metadata; only
    files that miss are opened. New signatures go to the cache, and all are read from it, so nothing is computed twice."""
    split = store.scratch(split_by_cache(keyed(files), store.read("signature_cache")), "probed")
    counts = split.groupBy("category", "from_cache").count().collect()  # a row a category
    hits = {"cached": sum(r["count"] for r in counts if r.from_cache), "computed": sum(r["count"] for r in counts if not r.from_cache)}
    fresh = None
    for kind, detector in detectors.items():
        if any(r.category == kind and not r.from_cache for r in counts):
            missed = split.filter((F.col("category") == kind) & ~F.col("from_cache")).drop("signature")
            # paths are few bytes: dealt out, so that many tasks open the files of one folder
            own = detector.sign(missed.repartition("path"), context).filter("signature is not null").select("path", "signature")
            own = missed.join(own, "path").select(*KEYS, "signature")
            fresh = own if fresh is None else fresh.unionByName(own)
    if fresh is not None:
        store.cache_signatures(store.scratch(fresh, "fresh"))
    known = split.drop("signature", "from_cache").join(store.read("signature_cache").select(*KEYS, "signature"), KEYS)
    return known, hits


def watch(spark, roots: list[str], store: SessionStore, checkpoint: str, once: bool = True, categories: tuple[str, ...] = CATEGORIES, min_size: int = 0, max_size: int | None = None, detectors: dict | None = None):
    """A streaming query over files that appear below the roots, by the rules of a scan (skipped folders, sizes, categories); each micro-batch goes through the detectors and the cache merge."""
    from kinfold.plans.detectors import defaults
    from kinfold.sources.files import described, outside_excluded

    chosen = {k: d for k, d in (detectors or defaults()).items() if k in categories}
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    stream = reduce(DataFrame.unionByName, [reader.load(root) for root in roots])
    files = described(stream.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")))
    files = files.filter(F.col("category").isin(*chosen) & (F.col("size") >= min_size) & outside_excluded(roots))
    if max_size is not None:
        files = files.filter(F.col("size") <= max_size)

    def merge(batch: DataFrame, _: int) -> None:
        signed(batch.dropDuplicates(["path"]), store, chosen, (spark, roots))  # overlapping roots report a file twice

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
