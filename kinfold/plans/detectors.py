"""Detectors: how files of a category are signed and compared. A scan takes any table of them, so other kinds of file plug in here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import similarity as sim
from kinfold.functions.text import decoded, normal_code, normal_text, signature
from kinfold.operators import grouping
from kinfold.sources import images
from kinfold.sources.content import with_content, with_digest
from kinfold.sources.extract import PLAIN, READERS, packed_text

#: What a detector's ``sign`` is given beside the files: the session and the roots of the scan.
Context = tuple[SparkSession, list[str]]


@dataclass(frozen=True)
class Detector:
    """``sign`` gives path, signature of files (path, extension, size, modified, ...; null signatures drop out); ``compare`` the similarity of two signatures. Files of an ``exact``
    detector are grouped by equal signatures, others in strict clusters of near ones. ``normal`` gives the text that the Dice mode compares, where there is one."""

    category: str
    sign: Callable[[DataFrame, Context], DataFrame]
    compare: Callable[[Column, Column], Column] = sim.equality
    exact: bool = True
    normal: Callable[[DataFrame], DataFrame] | None = None


def texts(files: DataFrame, normal: Callable[[Column], Column]) -> DataFrame:
    """path, normal of documents or code: packed documents are unpacked by their reader, others decoded in the JVM."""
    packed = F.col("extension").isin(*READERS)
    slim = files.select("path", "extension", "category")
    plain = with_content(slim.filter(~packed)).withColumn("text", F.when(F.col("extension").isin(*PLAIN) | (F.col("category") == "code"), decoded(F.col("content"))))
    unpacked = with_content(slim.filter(packed)).withColumn("text", packed_text("content", "extension"))
    both = plain.select("path", "text").unionByName(unpacked.select("path", "text"))
    return both.select("path", normal(F.col("text")).alias("normal"))


def _text_detector(category: str, normal: Callable[[Column], Column]) -> Detector:
    made = lambda files: texts(files, normal)
    return Detector(category, lambda files, _: made(files).select("path", signature(F.col("normal")).alias("signature")), normal=made)


def image_hash_similarity(a: Column, b: Column) -> Column:
    pa, pb = sim.parse_image_signature(a), sim.parse_image_signature(b)
    return sim.image_similarity([(sim.hash_words(F.get(pa, i)), sim.hash_words(F.get(pb, i))) for i in range(3)])


def video_hash_similarity(a: Column, b: Column) -> Column:
    pa, pb = sim.parse_video_signature(a), sim.parse_video_signature(b)
    return sim.video_similarity(pa["hash"], pb["hash"])


def video_detector(hasher: Callable[[DataFrame], DataFrame] | None = None) -> Detector:
    """``hasher``: path, signature (JSON with hash, src_path, duration) of files; frames are decoded by an outside tool. Without one, videos have no signature."""
    none = lambda files, _: files.select("path", F.lit(None).cast("string").alias("signature"))
    return Detector("video", (lambda files, _: hasher(files)) if hasher else none, video_hash_similarity, exact=False)


def table_detector(category: str, signatures: DataFrame, compare: Callable[[Column, Column], Column], exact: bool = False) -> Detector:
    """A detector whose signatures lie in a table (path, signature) already."""
    return Detector(category, lambda files, _: files.select("path").join(signatures.select("path", "signature"), "path"), compare, exact)


DOCUMENT = _text_detector("document", normal_text)
CODE = _text_detector("code", normal_code)
ARCHIVE = Detector("archive", lambda files, _: with_digest(files.select("path")).select("path", F.col("digest").alias("signature")))
IMAGE = Detector("image", lambda files, context: images.facts_of(context[0], files, context[1]).select("path", "signature"), image_hash_similarity, exact=False)


def defaults() -> dict[str, Detector]:
    return {d.category: d for d in (IMAGE, DOCUMENT, video_detector(), ARCHIVE, CODE)}


def groups_of(signed: DataFrame, detectors: dict[str, Detector], threshold: float) -> DataFrame:
    """path, category, group_path, similarity from signed files (path, category, signature): equal signatures for exact detectors, strict clusters of near ones for others."""
    exact = [c for c, d in detectors.items() if d.exact]
    out = grouping.exact_members(signed.filter(F.col("category").isin(*exact) if exact else F.lit(False))).select("path", "category", "group_path", F.lit(1.0).alias("similarity"))
    for kind, d in detectors.items():
        if not d.exact:
            out = out.unionByName(grouping.fuzzy_groups(signed.filter(F.col("category") == kind), d.compare, threshold))
    return out


def dice_groups(files: DataFrame, detector: Detector, threshold: float) -> DataFrame:
    """path, category, group_path, similarity of files whose normalised texts reach ``threshold`` by the Sorensen-Dice coefficient of their bigrams, in strict clusters."""
    return grouping.dice_groups(detector.normal(files).filter("normal is not null").withColumn("category", F.lit(detector.category)), "normal", threshold)


def compare_files(spark: SparkSession, a: str, b: str, detectors: dict[str, Detector] | None = None) -> float:
    """The similarity of two files of one category by its detector; 0 where the categories differ or one has no signature."""
    from kinfold.functions.paths import category, extension, file_name, local_path
    from kinfold.sources.files import listed

    rows = listed(spark, [local_path(a), local_path(b)]).filter("status = 'found'").select("path", "extension", "category", "size", "modified")
    kinds = [r[0] for r in spark.createDataFrame([(a,), (b,)], "p string").select(category(extension(file_name(F.col("p"))))).collect()]
    detectors = detectors or defaults()
    if kinds[0] is None or kinds[0] != kinds[1] or kinds[0] not in detectors:
        return 0.0
    d = detectors[kinds[0]]
    there = [r.path for r in rows.select("path").collect()]  # two at most
    if not {local_path(a), local_path(b)} <= set(there):
        return 0.0
    got = {r.path: r.signature for r in d.sign(rows, (spark, there)).select("path", "signature").collect()}
    x, y = got.get(local_path(a)), got.get(local_path(b))
    if x is None or y is None:
        return 0.0
    return float(spark.createDataFrame([(x, y)], "x string, y string").select(d.compare(F.col("x"), F.col("y"))).first()[0])
