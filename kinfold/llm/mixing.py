"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations. DataFrame functions only.

With p_i the share of source i among all tokens, an exponent a in [0, 1] gives the weights w_i ~ p_i ** a (temperature 1 / a: 1 is proportional, 0 uniform). The
exponent is the largest whose entropy reaches ``entropy`` of the uniform one, found by bisection, unless some source would be repeated more
than ``max_repeat`` times; then it is the smallest exponent that keeps that limit, by bisection too. Every document is in the mixture at least once: the total
budget is the least that lets each source have all its tokens.

A source's budget b_i buys whole epochs, each a permutation of its documents by a hash of (seed, epoch, id), and a part of one more, up to the document that
crosses the budget. A copy's place in its source's stream, (tokens before it) / b_i, puts it in one of the blocks of about ``block_tokens`` of
the mixture, so every block has the target weights.

Running sums have three levels: documents fall in hash buckets of about ``bucket_rows`` rows, buckets in groups of ``group_buckets``; sums of groups are added up per source, then sums of
buckets in a group and sums inside a bucket. No window holds more than a bucket, a group, or one row a group, however large a source is. What comes to the driver is some sums.

Tokens are words, runs of anything but white space (0x20, 0x09-0x0D).

Defined cases: a null text has no tokens; a null source is the source ''. A source without tokens has weight 0 and its documents come once. Rows with equal ids
are ordered by their tokens; equal rows take neighbouring places. Empty table: no rows. Of extra columns only those asked for are carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import shared


@dataclass(frozen=True)
class MixConfig:
    entropy: float = 0.9
    max_repeat: float = 1.5
    block_tokens: int = 1 << 16
    bucket_rows: int = 512
    group_buckets: int = 1024
    seed: int = 17
    steps: int = 40
    broadcast_sources: int = 50_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(seed: int, epoch: Column, doc: Column) -> Column:
    """48 bits of a hash: a document's place in the permutation of an epoch."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def exponent(sources: DataFrame, cfg: MixConfig) -> float:
    """The exponent for a table of (source, n): five halvings a job, each a handful of sums over one row a source."""
    live = sources.filter("n > 0")
    total, k, most, least = live.agg(F.sum("n"), F.count("*"), F.max("n"), F.min("n")).first()
    if not k or k == 1:
        return 1.0
    log_p = F.log(F.col("n") / F.lit(float(total)))
    target = cfg.entropy * math.log(k)

    def entropies(points: list[float]) -> list[float]:
        z = [F.sum(F.exp(F.lit(a) * log_p)) for a in points]
        y = [F.sum(F.exp(F.lit(a) * log_p) * log_p) for a in points]
        row = live.agg(*[c.alias(f"c{i}") for i, c in enumerate(z + y)]).first()
        return [math.log(row[i]) - a * row[len(points) + i] / row[i] for i, a in enumerate(points)]

    by_entropy = 1.0
    if entropies([1.0])[0] < target:
        lo, hi, done = 0.0, 1.0, 0
        while done < cfg.steps:
            levels = min(5, cfg.steps - done)
            grid = [lo + (hi - lo) * i / 2**levels for i in range(1, 2**levels)]
            enough = [h >= target for h in entropies(grid)]
            ends = [lo, *grid, hi]
            i = max([j + 1 for j, ok in enumerate(enough) if ok], default=0)
            lo, hi, done = ends[i], ends[i + 1], done + levels
        by_entropy = lo
    spread = math.log(most) - math.log(least)
    by_repeat = 0.0
    if spread > math.log(cfg.max_repeat):
        lo, hi = 0.0, 1.0
        for _ in range(cfg.steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if (1 - mid) * spread <= math.log(cfg.max_repeat) else (mid, hi)
        by_repeat = hi
    return max(by_entropy, by_repeat)


def budgets(slim: DataFrame, cfg: MixConfig) -> tuple[DataFrame, int]:
    """Per source: n (tokens), docs, budget, weight; and how many sources there are."""
    sources = slim.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"))
    a = exponent(sources, cfg)
    most, count = sources.agg(F.max("n"), F.count("*")).first()
    repeat = F.exp(F.lit(a - 1.0) * (F.log(F.col("n").cast("double")) - F.lit(math.log(most) if most else 0.0)))
    out = sources.withColumn("budget", F.when(F.col("n") > 0, F.floor(F.col("n") * repeat + 0.5)).otherwise(0).cast("long"))
    total = out.agg(F.sum("budget")).first()[0] or 0
    return out.withColumn("weight", F.col("budget") / F.lit(float(max(1, total)))).withColumn("total", F.lit(int(total))), count


def mix(docs: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a copy: doc_id, source, epoch, block, tokens, weight (of the source) and the columns named in ``keep``."""
    spark = docs.sparkSession
    tmp = shared.Scratch(spark, "mixing")
    own = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(source_col, F.lit("")).alias("source"), tokens(F.col("text")).alias("tokens"), *own)
    slim = tmp.write(base.select("doc_id", "source", "tokens"))
    plan, n_sources = budgets(slim, cfg)
    plan = tmp.write(plan)
    rows = slim.count()
    buckets = max(1, -(-rows // cfg.bucket_rows))
    # One row a source; broadcast only while their number is small, else a merge join, whose hot keys AQE splits.
    small = F.broadcast(plan) if n_sources <= cfg.broadcast_sources else plan

    def copies(df: DataFrame) -> DataFrame:
        full = F.when(F.col("n") > 0, F.floor(F.col("budget") / F.col("n"))).otherwise(1)
        part = F.when((F.col("n") > 0) & (F.col("budget") % F.col("n") > 0), 1).otherwise(0)
        df = df.join(small, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), (full + part - 1).cast("int"))))
        df = df.withColumn("key", place(cfg.seed, F.col("epoch"), F.col("doc_id")))
        return df.withColumn("bucket", F.floor(F.col("key") / F.lit(float(1 << 48)) * buckets).cast("int"))

    sums = copies(slim).groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("s"))
    # sums before a bucket: within its group of buckets, and over the groups; both windows stay short
    group = sums.withColumn("group", F.floor(F.col("bucket") / cfg.group_buckets))
    within = Window.partitionBy("source", "epoch", "group").orderBy("bucket")
    ahead = group.groupBy("source", "epoch", "group").agg(F.sum("s").alias("g"))
    ahead = ahead.withColumn("ahead", F.sum("g").over(Window.partitionBy("source", "epoch").orderBy("group")) - F.col("g")).drop("g")
    before = group.withColumn("inside", F.sum("s").over(within) - F.col("s")).join(ahead, ["source", "epoch", "group"]).select("source", "epoch", "bucket", (F.col("inside") + F.col("ahead")).alias("start"))
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    dealt = copies(base if keep else slim).withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    at = dealt.join(before, ["source", "epoch", "bucket"]).withColumn("at", F.col("epoch") * F.col("n") + F.col("start") + F.col("inner"))
    # the first epoch is whole: a document without tokens may lie behind the last token
    at = at.filter((F.col("n") == 0) | (F.col("epoch") == 0) | (F.col("at") < F.col("budget")))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / cfg.block_tokens))
    block = F.when(F.col("n") > 0, F.least(F.floor(F.col("at") / F.col("budget") * blocks), blocks - 1)).otherwise(0).cast("long")
    return at.select("doc_id", "source", "epoch", block.alias("block"), "tokens", F.round("weight", 9).alias("weight"), *[F.col(f"_keep_{i}").alias(c if c not in {"doc_id", "source", "epoch", "block", "tokens", "weight"} else f"_{c}") for i, c in enumerate(keep)])


def mixed_documents(docs: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` as the mixture has it: its own columns, one row a copy."""
    names = docs.columns
    # by place, so that no name of theirs meets one of the mixture's; the text keeps its own, as tokens are counted in it
    own = docs.select(*[F.col(f"`{c}`").alias(f"column_{i}") for i, c in enumerate(names)], "text")
    out = mix(own, cfg, f"column_{names.index(id_col)}", f"column_{names.index(source_col)}", keep=tuple(f"column_{i}" for i in range(len(names))))
    return out.select(*[F.col(f"column_{i}").alias(c) for i, c in enumerate(names)])


def sql(cfg: MixConfig = MixConfig()) -> str:
    """The same mixture in DuckDB's SQL, with plain running sums."""
    e, r, s = repr(cfg.entropy), repr(cfg.max_repeat), cfg.steps
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
src AS (SELECT source, sum(tokens)::DOUBLE AS n FROM base GROUP BY source),
live AS (SELECT list(ln(n / (SELECT sum(n) FROM src)) ORDER BY source) AS lp, ln(max(n)) - ln(min(n)) AS spread, {e} * ln(count(*)) AS target FROM src WHERE n > 0),
ent(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      ln(list_sum(list_transform(lp, lambda x: exp((lo + hi) / 2 * x)))) - (lo + hi) / 2 * list_sum(list_transform(lp, lambda x: exp((lo + hi) / 2 * x) * x)) / list_sum(list_transform(lp, lambda x: exp((lo + hi) / 2 * x))) >= target AS ok
    FROM ent, live WHERE i < {s})),
rep(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, (1 - (lo + hi) / 2) * spread <= ln({r}) AS ok FROM rep, live WHERE i < {s})),
pick AS (
  SELECT greatest(
    CASE WHEN len(lp) = 1 OR -list_sum(list_transform(lp, lambda x: exp(x) * x)) >= target THEN 1.0 ELSE (SELECT lo FROM ent WHERE i = {s}) END,
    CASE WHEN spread > ln({r}) THEN (SELECT hi FROM rep WHERE i = {s}) ELSE 0.0 END) AS a FROM live),
plan AS (SELECT source, n, CASE WHEN n > 0 THEN floor(n * exp((SELECT a - 1 FROM pick) * (ln(n) - (SELECT ln(max(n)) FROM src))) + 0.5) ELSE 0 END AS budget FROM src),
tot AS (SELECT sum(budget) AS total FROM plan),
copies AS (
  SELECT b.*, p.n, p.budget, e.epoch, ('0x' || substr(md5(concat_ws('|', '{cfg.seed}', e.epoch::VARCHAR, coalesce(doc_id::VARCHAR, ''))), 1, 12))::BIGINT AS key
  FROM base b JOIN plan p USING (source), range(0, 1000) e(epoch)
  WHERE e.epoch < CASE WHEN p.n > 0 THEN ceil(p.budget / p.n) ELSE 1 END),
placed AS (
  SELECT *, epoch * n + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM copies)
SELECT doc_id, source, epoch::INTEGER AS epoch,
  CASE WHEN n > 0 THEN least(floor(pos / budget * greatest(1, ceil(total / {cfg.block_tokens}))), greatest(1, ceil(total / {cfg.block_tokens})) - 1) ELSE 0 END::BIGINT AS block,
  tokens::BIGINT AS tokens, round(budget / greatest(1, total), 9) AS weight
FROM placed, tot WHERE n = 0 OR epoch = 0 OR pos < budget"""
