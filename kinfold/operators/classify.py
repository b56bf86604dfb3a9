"""Image classes by escalating tiers: rules on metadata, rules on pixels, nearest prototype, a pluggable remote call, relaxed fallbacks.

Confidences are 32-bit floats, as stored. Each tier is one expression giving struct(category, confidence) or null; ``escalate`` picks the first that
passes its gate, so all local tiers are one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.schema import DESKTOP_SIZES


@dataclass(frozen=True)
class Gates:
    """Least confidence of each tier, and the one under which a remote call is tried."""

    tier0: float = 0.62
    tier1: float = 0.48
    tier2: float = 0.45
    remote: float = 0.40


def _result(label: str, confidence: float) -> Column:
    return F.struct(F.lit(label).alias("category"), F.lit(confidence).cast("float").alias("confidence"))


def tier0(width: Column, height: Column, has_exif: Column, size: Column) -> Column:
    """Rules on dimensions, camera data and size, first match wins."""
    known = width.isNotNull() & height.isNotNull() & (width > 0) & (height > 0)
    long, short = F.greatest(width, height), F.least(width, height)
    ratio = long.cast("float") / short.cast("float")
    ratio = ratio.cast("float")
    f32 = lambda x: F.lit(x).cast("float")
    screen = F.lit(False)
    for a, b in DESKTOP_SIZES:
        screen = screen | ((long == a) & (short == b))
    exif = F.coalesce(has_exif, F.lit(False))
    wide = (width > height) & ratio.between(f32(1.5), f32(2.4)) & (width >= 1280)
    tall = (height > width) & ratio.between(f32(1.7), f32(2.3))
    ladder = F.when((long <= 256) & (size < 512 * 1024), _result("logo_icon", 0.85)).when(exif, _result("photo_general", 0.65))
    ladder = ladder.when(screen | wide, _result("screenshot_desktop", 0.75)).when(tall, _result("screenshot_mobile", 0.72))
    return F.when(known, ladder)


def tier1(mean_luma: Column, edge_energy: Column) -> Column:
    """Rules on brightness and edges."""
    f = lambda x: F.lit(x).cast("float")
    diagram = (edge_energy > f(0.35)) & (mean_luma > f(0.2)) & (mean_luma < f(0.92))
    scan = (mean_luma > f(0.85)) & (edge_energy < f(0.2))
    return F.when(diagram, _result("diagram", 0.45)).when(scan, _result("scanned_document", 0.40))


def escalate(t0: Column, t1: Column, t2: Column | None = None, remote: Column | None = None, gates: Gates = Gates()) -> Column:
    """struct(category, confidence, tier) from the tiers' results; ``t2`` and ``remote`` may be left out. ``remote`` is a class label or null."""
    as_tier = lambda r, tier, factor=1.0: F.struct(r["category"].alias("category"), (r["confidence"] * F.lit(factor).cast("float")).cast("float").alias("confidence"), F.lit(tier).cast("tinyint").alias("tier"))
    f = lambda x: F.lit(x).cast("float")
    named = lambda label, confidence, tier: F.struct(label.alias("category"), f(confidence).alias("confidence"), F.lit(tier).cast("tinyint").alias("tier"))
    out = F.when(t0["confidence"] >= f(gates.tier0), as_tier(t0, 0)).when(t1["confidence"] >= f(gates.tier1), as_tier(t1, 1))
    if t2 is not None:
        if remote is not None:
            out = out.when((t2["confidence"] < f(gates.remote)) & (t2["confidence"] < f(gates.tier2)) & remote.isNotNull(), named(remote, 0.8, 3))
        out = out.when(t2.isNotNull(), as_tier(t2, 2))
    if remote is not None:
        out = out.when(remote.isNotNull(), named(remote, 0.75, 3))
    out = out.when(t0.isNotNull(), as_tier(t0, 0, 0.9)).when(t1.isNotNull(), as_tier(t1, 1, 0.85))
    return out.otherwise(named(F.lit("other"), 0.2, 0))


def nearest_prototype(vectors: DataFrame, prototypes: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, idx, label, confidence: the prototype with the largest cosine, the first one on a tie.

    ``prototypes`` (idx, label, embedding) has one row a class (24 for images), a bound that the class list sets, so it is broadcast.
    """
    from kinfold.functions.similarity import cosine

    p = prototypes.select("idx", "label", F.col("embedding").alias("_proto"))
    scored = vectors.select(key, F.col(vector).alias("_v")).crossJoin(F.broadcast(p)).withColumn("s", cosine(F.col("_v"), F.col("_proto")))
    best = scored.groupBy(key).agg(F.max(F.struct(F.col("s"), -F.col("idx"), F.col("label"))).alias("b"))
    return best.select(key, (-F.col("b.col2")).alias("idx"), F.col("b.label").alias("label"), F.col("b.s").alias("confidence"))


def categorize_with(images: DataFrame, call: Callable[[str, bytes], str | None], known: tuple[str, ...]) -> DataFrame:
    """path, label: a remote categorizer applied to (path, content) rows; an error or an unknown label becomes null. One call a row, batches streamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    got = call(path, content)
                except Exception:  # a failed call escalates no further
                    got = None
                labels.append(got if got in known else None)
            yield pd.DataFrame({"path": batch["path"], "label": pd.Series(labels, dtype=object)})

    return images.select("path", "content").mapInPandas(run, "path string, label string")
