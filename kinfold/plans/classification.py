"""Classes of image files: cache, rules on the head of a file, rules on its pixels, an encoder, a remote call. Each tier opens only the files that the tiers before could not settle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import classify
from kinfold.schema import IMAGE_CLASSES
from kinfold.sources import images
from kinfold.sources.content import with_content, with_head_facts
from kinfold.sources.store import SessionStore
from kinfold.streaming.incremental import keyed

#: From the input of an image encoder (1 x 3 x side x side floats) to its vector.
Encoder = Callable[[np.ndarray], np.ndarray]
_RESULT = "struct<category:string,confidence:float>"


def embeddings(spark: SparkSession, files: DataFrame, roots: list[str], encoder: Encoder) -> DataFrame:
    """path, embedding of images by an outside encoder; one that fails has none."""
    pixels = spark.read.format("image").option("recursiveFileLookup", "true").load(roots)
    named = pixels.select(images.origin_path(F.col("image.origin")).alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))

    def run(batches):
        for batch in batches:
            for path, h, w, c, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rgb = images.pixels(data, h, w, c) if data is not None else None
                try:
                    vec = None if rgb is None else np.asarray(encoder(images.preprocess(rgb)), np.float32).ravel().tolist()
                except Exception:  # an encoder that fails on one image leaves it to the tiers after
                    vec = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([vec], pa.list_(pa.float32()))], ["path", "embedding"])

    return named.join(files.select("path").distinct(), "path", "left_semi").mapInArrow(run, "path string, embedding array<float>").filter("embedding is not null")


def classified(spark: SparkSession, files: DataFrame, roots: list[str], store: SessionStore, gates: classify.Gates = classify.Gates(), encoder: Encoder | None = None, prototypes: DataFrame | None = None, remote: Callable[[str, bytes], str | None] | None = None) -> DataFrame:
    """path, sub_category, confidence, tier of image ``files`` (path, size, modified). Known ones come from the cache, by path, size and time; new ones go to it."""
    own = keyed(files.filter("category = 'image'")).select("path", "file_path", "file_size", "modified_at", "size", "modified")
    probed = store.scratch(store.cached_classes(own), "classes")
    missed = probed.filter("sub_category is null").select("path", "file_path", "file_size", "modified_at", "size", "modified")
    if missed.take(1):
        t0 = with_head_facts(missed.repartition("path"))
        rows = store.scratch(t0.withColumn("t0", classify.tier0(F.col("width"), F.col("height"), F.col("has_exif"), F.col("size"))), "tier0")
        open0 = rows.filter(F.col("t0").isNull() | (F.col("t0.confidence") < gates.tier0))
        t1 = None
        if open0.take(1):
            facts = images.facts_of(spark, open0, roots)
            t1 = store.scratch(facts.select("path", classify.tier1(F.col("mean_luma"), F.col("edge_energy")).alias("t1")), "tier1")
        rows = rows.join(t1, "path", "left") if t1 is not None else rows.withColumn("t1", F.lit(None).cast(_RESULT))
        rest = rows.filter((F.col("t0").isNull() | (F.col("t0.confidence") < gates.tier0)) & (F.col("t1").isNull() | (F.col("t1.confidence") < gates.tier1)))
        t2 = t3 = None
        if encoder is not None and prototypes is not None:
            near = classify.nearest_prototype(embeddings(spark, rest, roots, encoder), prototypes, "path")
            t2 = store.scratch(near.select("path", F.struct(F.col("label").alias("category"), F.col("confidence").cast("float").alias("confidence")).alias("t2")), "tier2")
        rows = rows.join(t2, "path", "left") if t2 is not None else rows.withColumn("t2", F.lit(None).cast(_RESULT))
        if remote is not None:
            weak = rest.select("path") if t2 is None else rest.select("path").join(t2.filter(F.col("t2.confidence") >= min(gates.tier2, gates.remote)).select("path"), "path", "left_anti")
            t3 = store.scratch(classify.categorize_with(with_content(weak), remote, tuple(c[0] for c in IMAGE_CLASSES)), "tier3")
        rows = rows.join(t3.select("path", F.col("label").alias("t3")), "path", "left") if t3 is not None else rows.withColumn("t3", F.lit(None).cast("string"))
        got = rows.withColumn("r", classify.escalate(F.col("t0"), F.col("t1"), F.col("t2"), F.col("t3"), gates))
        fresh = got.select("file_path", "file_size", "modified_at", F.col("r.category").alias("sub_category"), F.col("r.confidence").cast("double").alias("confidence"), F.col("r.tier").cast("int").alias("tier"))
        store.cache_classes(store.scratch(fresh, "classified"))
    return store.cached_classes(own).select("path", "sub_category", "confidence", "tier")
