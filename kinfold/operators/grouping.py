"""Duplicate groups: exact groups, blocked candidate pairs, strict clusters.

Files are rows (path, category, signature, ...). Exact groups are one pre-aggregated group-by. Fuzzy groups pair files whose signatures share a prefix, keep pairs at or
above a threshold and merge clusters only while *every* cross pair is similar. A pair never leaves its prefix, so that last step is independent by
(category, prefix); it sees pairs of ids and similarities only, never signatures.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import prefix
from kinfold.plans.stages import written


def exact_groups(files: DataFrame, sig: str = "signature") -> DataFrame:
    """category, signature, n_files, first_path, similarity of signatures that two files or more share. Members stay rows (``exact_members``), so no group is collected."""
    known = files.filter(F.col(sig).isNotNull())
    return known.groupBy("category", F.col(sig).alias("signature")).agg(F.count("*").alias("n_files"), F.min("path").alias("first_path")).filter("n_files >= 2").withColumn("similarity", F.lit(1.0))


def exact_members(files: DataFrame, sig: str = "signature") -> DataFrame:
    """path, category, signature and group (its first path) of every file in an exact group."""
    groups = exact_groups(files, sig).select("category", "signature", F.col("first_path").alias("group_path"))
    return files.withColumnRenamed(sig, "signature").join(groups, ["category", "signature"]).select("path", "category", "signature", "group_path")


def bucket_sizes(files: DataFrame, sig: str = "signature", length: int = 8) -> DataFrame:
    """Files in each prefix bucket and the pairs it would compare."""
    known = files.filter(F.col(sig).isNotNull())
    n = F.count("*")
    return known.groupBy("category", prefix(F.col(sig), length).alias("prefix")).agg(n.alias("n_files"), (n * (n - 1) / 2).cast("long").alias("n_pairs"))


def candidate_pairs(files: DataFrame, sig: str = "signature", length: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs (path_a < path_b) within a prefix bucket, with both signatures and the columns in ``carry`` suffixed _a and _b. An equi-join: AQE splits a hot bucket."""
    side = files.filter(F.col(sig).isNotNull()).select("category", prefix(F.col(sig), length).alias("prefix"), "path", F.col(sig).alias("signature"), *[c for c in carry if c != sig])
    names = ["path", "signature", *[c for c in carry if c != sig]]
    a = side.select("category", "prefix", *[F.col(c).alias(f"{c}_a") for c in names])
    b = side.select("category", "prefix", *[F.col(c).alias(f"{c}_b") for c in names])
    return a.join(b, ["category", "prefix"]).filter("path_a < path_b")


def similar_pairs(pairs: DataFrame, similarity: Column, threshold: float) -> DataFrame:
    """category, prefix, path_a, path_b, similarity of pairs at or above the threshold."""
    return pairs.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).select("category", "prefix", "path_a", "path_b", "similarity")


def merge_strictly(pairs: list[tuple[str, str, float]]) -> list[tuple[list[str], float]]:
    """Clusters of two or more and their least similarity. Pairs are taken by falling similarity, ties by path; two clusters merge only if every cross pair is listed."""
    listed = {frozenset(p[:2]): p[2] for p in pairs}
    home: dict[str, list[str]] = {}
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        left, right = home.setdefault(a, [a]), home.setdefault(b, [b])
        if left is right or any(frozenset((x, y)) not in listed for x in left for y in right):
            continue
        left += right
        for x in right:
            home[x] = left
    found = {id(c): c for c in home.values() if len(c) > 1}
    return [(sorted(c), min(listed[frozenset((x, y))] for i, x in enumerate(c) for y in c[i + 1 :])) for c in found.values()]


def strict_groups(similar: DataFrame) -> DataFrame:
    """path, category, group_path, similarity: the strict clusters of ``similar_pairs``' rows, one task a prefix."""

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(p, rows["category"].iloc[0], files[0], least) for files, least in merge_strictly(list(rows[["path_a", "path_b", "similarity"]].itertuples(index=False, name=None))) for p in files]
        return pd.DataFrame(out, columns=["path", "category", "group_path", "similarity"])

    return similar.groupBy("category", "prefix").applyInPandas(cluster, "path string, category string, group_path string, similarity double")


def _with_copies(classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """path, category, group_path, similarity from ``classes`` (path, category, first: the path that stands for files with equal content) and the ``clusters`` of those that stand for
    others: copies join the cluster of theirs, or are one on their own."""
    several = classes.groupBy("category", "first").agg(F.count("*").alias("_n")).filter("_n > 1").select("category", F.col("first").alias("path"))
    alone = several.join(clusters.select("category", "path"), ["category", "path"], "left_anti").select("path", "category", F.col("path").alias("group_path"), F.lit(1.0).alias("similarity"))
    found = clusters.select("path", "category", "group_path", "similarity").unionByName(alone).withColumnRenamed("path", "first")
    return classes.join(found, ["category", "first"]).select("path", "category", "group_path", "similarity")


def fuzzy_groups(files: DataFrame, similarity: Callable[[Column, Column], Column], threshold: float, sig: str = "signature", length: int = 8) -> DataFrame:
    """Strict clusters of files by a similarity of two signatures. Files with equal signatures are one in every cluster, so their smallest path stands for them while pairs are made."""
    known = files.filter(F.col(sig).isNotNull()).select("category", "path", F.col(sig).alias("signature"))
    one = known.groupBy("category", "signature").agg(F.min("path").alias("path"))
    pairs = candidate_pairs(one, "signature", length)
    clusters = strict_groups(similar_pairs(pairs, similarity(F.col("signature_a"), F.col("signature_b")), threshold))
    return _with_copies(known.join(one.withColumnRenamed("path", "first"), ["category", "signature"]).select("category", "path", "first"), clusters)


def _dealt(kept: DataFrame, ratio: float, rows: int, bigrams: int) -> DataFrame:
    """``kept`` (id, category, prefix, n, big) with tasks, an array of (block, side: 0 and 1 of two parts, 2 of one with itself): pairs of a prefix whose lengths allow the
    threshold meet in exactly one block.

    A small prefix is one block. A big one is cut into bands of length, so that a pair lies in one band or in neighbours, and a band into as many parts as its texts need; blocks are
    the pairs of parts. So no task grows with a prefix, and a text is sent once for each part of its band and of the two beside it.
    """
    width = max(1e-3, -math.log(max(ratio, 1e-9))) * (1 + 1e-9)
    all_bands = ratio > 1e-9
    band = F.when(F.col("big"), F.floor(F.log("n") / width)).otherwise(0) if all_bands else F.lit(0)
    kept = kept.withColumn("band", band.cast("long"))
    here = ["category", "prefix", "band"]
    parts = kept.filter("big").groupBy(*here).agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n") / bigrams)).alias("k"))
    above = parts.select("category", "prefix", (F.col("band") - 1).alias("band"), F.col("k").alias("up"))
    below = parts.select("category", "prefix", (F.col("band") + 1).alias("band"), F.col("k").alias("down"))
    parts = parts.join(above, here, "left").join(below, here, "left").select("*", F.lit(True).alias("big"))
    # ``parts`` has a row for thousands of texts, whatever the table
    dealt = kept.join(F.broadcast(parts), [*here, "big"], "left").withColumns({"k": F.coalesce("k", F.lit(1)), "up": F.coalesce("up", F.lit(0)), "down": F.coalesce("down", F.lit(0))})
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("k")))

    def block(band: Column, kind: int, i: Column, j: Column, side: Column) -> Column:
        name = F.concat_ws("|", band, F.lit(kind), i, j, F.length("category"), "category", "prefix")
        return F.struct(name.alias("block"), side.cast("int").alias("side"))

    def each(n: str, f: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col(n)), lambda t: t < F.col(n)), f)

    part, at = F.col("part"), F.col("band")
    own = each("k", lambda t: block(at, 0, F.least(part, t), F.greatest(part, t), F.when(part == t, 2).when(part > t, 1).otherwise(0)))
    tasks = F.concat(own, each("up", lambda t: block(at, 1, part, t, F.lit(0))), each("down", lambda t: block(at - 1, 1, t, part, F.lit(1))))
    return dealt.select("id", tasks.alias("tasks"))


def dice_pairs(files: DataFrame, text: str, threshold: float, length: int = 8, rows: int = 2048, bigrams: int = 1 << 22) -> DataFrame:
    """Pairs of different texts with the same first ``length`` characters whose Sorensen-Dice coefficient on character bigrams (multisets) reaches the threshold.

    Texts are read once, into packed profiles (``operators.bigrams``) in the shared folder. Equal texts (by SHA-256) are one class, and their first path stands for them. All pairs of a
    prefix are judged exactly, block by block, where only profiles travel: a part of a block holds about ``rows`` texts and ``bigrams`` bigrams at most, or one text. Lengths
    prune pairs before: Dice >= t needs min / max of the bigram counts >= t / (2 - t).
    """
    from kinfold.operators.bigrams import block_pairs, profiles

    known = files.filter(F.col(text).isNotNull() & F.col("category").isNotNull() & F.col("path").isNotNull())
    known = known.select("category", "path", prefix(F.col(text), length).alias("prefix"), F.sha2(F.col(text).cast("binary"), 256).alias("digest"), F.col(text).cast("binary").alias("t"))
    made = known.mapInArrow(profiles, "category string, path string, prefix string, digest string, n long, profile binary")
    made = written(made.filter("n > 0").withColumn("id", F.monotonically_increasing_id()), "profiles")
    one = made.groupBy("category", "digest").agg(F.min(F.struct("path", "id", "prefix", "n")).alias("r")).select("category", "r.prefix", "r.id", "r.n")
    sizes = one.groupBy("category", "prefix").agg(F.count("*").alias("c"), F.sum("n").alias("s")).filter("c > 1")
    kept = written(one.join(sizes, ["category", "prefix"]).select("id", "category", "prefix", "n", ((F.col("c") > rows) | (F.col("s") > bigrams)).alias("big")), "classes")
    sent = _dealt(kept, threshold / (2 - threshold), rows, bigrams).join(made.select("id", "path", "n", "profile"), "id")
    sent = sent.select(F.explode("tasks").alias("x"), "path", "n", "profile").select("x.block", "x.side", "path", "n", "profile")
    return sent.repartition("block").sortWithinPartitions("block").mapInArrow(block_pairs(threshold), "path_a string, path_b string, similarity double")


def dice_groups(files: DataFrame, text: str, threshold: float, length: int = 8) -> DataFrame:
    """Strict clusters of files by ``dice_pairs`` of their texts, equal texts together."""
    known = files.filter(F.col(text).isNotNull())
    one = known.groupBy("category", F.col(text).alias(text)).agg(F.min("path").alias("first"))
    pairs = dice_pairs(files, text, threshold, length)
    start = one.select("category", F.col("first").alias("path_a"), prefix(F.col(text), length).alias("prefix"))
    clusters = strict_groups(pairs.join(start, "path_a").select("category", "prefix", "path_a", "path_b", "similarity"))
    return _with_copies(known.join(one, ["category", text]).select("category", "path", "first"), clusters)
