"""Pixels: brightness and edges, three perceptual hashes. Pixels come from Spark's ``image`` reader (BGR bytes); numpy works on whole images in Arrow batches.

The hashes are of the same families as usual tools' (mean, block, gradient on a 12 x 12 grid), but bits depend on the resize filter, so they compare only with hashes made here.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.paths import plain_path
from kinfold.sources.content import copied
from kinfold.sources.store import shared_folder

SIDE = 12
STEP = 2


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    """Rows x columns x (red, green, blue)."""
    if height < 1 or width < 1 or len(data) != height * width * channels:
        return None
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def luma(rgb: np.ndarray) -> np.ndarray:
    f = rgb.astype(np.float32)
    return np.float32(0.299) * f[:, :, 0] + np.float32(0.587) * f[:, :, 1] + np.float32(0.114) * f[:, :, 2]


def structure(rgb: np.ndarray) -> tuple[float, float]:
    """Mean brightness over every second pixel each way, and edge energy: colour steps to the right at every fourth, over the number of inner second pixels.

    The two strides differ, so ordinary images stay under 0.25; kept as it is because the gates were set on it. Sides under two steps have no edges.
    """
    h, w = rgb.shape[:2]
    total = int(luma(rgb)[::STEP, ::STEP].astype(np.int64).sum())
    mean = total / ((w // STEP + 1) * (h // STEP + 1))
    ys, xs = np.arange(STEP, max(STEP, h - STEP), 2 * STEP), np.arange(STEP, max(STEP, w - STEP), 2 * STEP)
    edges = 0
    if len(ys) and len(xs):
        x = rgb.astype(np.int64)
        edges = int(np.abs(x[np.ix_(ys, xs)] - x[np.ix_(ys, xs + STEP)]).sum())
    inner = max(1, max(0, w // STEP - 2) * max(0, h // STEP - 2))
    return float(np.float32(mean / 255.0)), float(np.float32(edges / inner / 765.0))


def shrink(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over a grid of cells, by running sums; small images repeat pixels."""
    h, w = gray.shape
    if h < rows or w < cols:
        gray = gray[np.arange(max(h, rows)) * h // max(h, rows)][:, np.arange(max(w, cols)) * w // max(w, cols)]
        h, w = gray.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = gray.cumsum(0).cumsum(1)
    y, x = np.arange(rows + 1) * h // rows, np.arange(cols + 1) * w // cols
    area = np.diff(y)[:, None] * np.diff(x)[None]
    return (s[np.ix_(y[1:], x[1:])] - s[np.ix_(y[:-1], x[1:])] - s[np.ix_(y[1:], x[:-1])] + s[np.ix_(y[:-1], x[:-1])]) / area


def hashes(rgb: np.ndarray, side: int = SIDE) -> tuple[bytes, bytes, bytes]:
    """Mean, block (median by band) and gradient hash, side * side bits each."""
    gray = luma(rgb)
    grid = shrink(gray, side, side)
    mean = grid > grid.mean()
    band = np.concatenate([part > np.median(part) for part in np.array_split(grid, 4)])
    wide = shrink(gray, side, side + 1)
    return tuple(np.packbits(b.ravel(), bitorder="little").tobytes() for b in (mean, band, wide[:, 1:] > wide[:, :-1]))


@F.pandas_udf(T.StructType([T.StructField("mean_luma", T.FloatType()), T.StructField("edge_energy", T.FloatType()), T.StructField("hash_size", T.IntegerType()), T.StructField("signature", T.StringType())]))
def _facts(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    out = []
    for d, h, w, c in zip(data, height, width, channels, strict=True):
        rgb = pixels(d, h, w, c) if d is not None else None
        out.append((None, None, None, None) if rgb is None else (*structure(rgb), 8, "|".join(base64.b64encode(x).decode() for x in hashes(rgb))))
    return pd.DataFrame(out, columns=["mean_luma", "edge_energy", "hash_size", "signature"]).astype({"mean_luma": "float32", "edge_energy": "float32", "hash_size": "Int32"})


def origin_path(origin):
    """The path of an image as scans write it: the reader gives a URI with its special characters escaped."""
    return plain_path(F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B"))))


def image_facts(spark: SparkSession, roots: list[str], since: str | None = None) -> DataFrame:
    """path, width, height, mean_luma, edge_energy, hash_size, signature of images below the roots; unreadable ones have nulls. ``since``: only files modified after it are opened."""
    reader = spark.read.format("image").option("recursiveFileLookup", "true")
    i = (reader.option("modifiedAfter", since) if since else reader).load(roots)
    f = i.select(origin_path(F.col("image.origin")).alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), _facts("image.data", "image.height", "image.width", "image.nChannels").alias("f"))
    return f.select("path", "width", "height", "f.*")


def facts_of(spark: SparkSession, images: DataFrame, roots: list[str]) -> DataFrame:
    """``image_facts`` of the rows of ``images`` (path, modified): pixels are decoded only of files as new as the oldest of them. Names that Spark's reader skips (a leading
    point or underscore in any part) are copied to the shared folder under plain names first."""
    columns = ["path", "width", "height", "mean_luma", "edge_energy", "hash_size", "signature"]
    hidden = F.col("path").rlike("/[._]")
    one = images.agg(F.count_if(~hidden).alias("plain"), F.count_if(hidden).alias("hidden"), F.date_format(F.min("modified") - F.expr("interval 2 seconds"), "yyyy-MM-dd'T'HH:mm:ss").alias("since")).first()
    out = spark.createDataFrame([], "path string, width int, height int, mean_luma float, edge_energy float, hash_size int, signature string")
    if one.plain:
        out = out.unionByName(image_facts(spark, roots, one.since).select(columns).join(images.filter(~hidden).select("path").distinct(), "path", "left_semi"))
    if one.hidden:
        folder = f"{shared_folder(spark)}/kinfold/images-{uuid.uuid4().hex}"
        copied(images.filter(hidden), folder).write.parquet(f"{folder}-names")
        made = spark.read.parquet(f"{folder}-names")
        if made.take(1):
            facts = image_facts(spark, [folder]).withColumn("copy", F.regexp_extract("path", r"([^/]*)$", 1)).drop("path")
            out = out.unionByName(facts.join(made, "copy").select(columns))
    return out


def preprocess(rgb: np.ndarray, side: int = 224) -> np.ndarray:
    """1 x 3 x side x side float input of an image encoder: resized, scaled to 0..1, normalised by the fixed channel means and deviations."""
    mean, dev = np.array([0.48145466, 0.4578275, 0.40821073]), np.array([0.26862954, 0.26130258, 0.27577711])  # fixed values
    x = np.stack([shrink(rgb[:, :, c].astype(np.float64), side, side) for c in range(3)], 2) / 255.0
    return ((x - mean) / dev).transpose(2, 0, 1)[None].astype(np.float32)
