"""Registered queries of the engine's own operators over the driver's tables, and the same in DuckDB's SQL.

The tables are no files, so ``documents`` stands for a folder of texts: path source/doc_id.txt, size in bytes, a time made from the id. The signs of ``embeddings`` stand for
perceptual hashes, ``part`` for image facts, ``events`` for sessions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import formats, paths, similarity, text
from kinfold.operators import classify, grouping, report, sorter, survivors
from kinfold.plans.ranks import with_rank
from kinfold.plans.stages import spread, written
from kinfold.schema import DESKTOP_SIZES, EXCLUDED_DIRS, EXTENSIONS
from kinfold.sources import store as stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_EXTS = sorted(e for v in EXTENSIONS.values() for e in v)
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    seconds = F.lit(1_600_000_000) + F.col("doc_id") * 7919 % 1_000_000
    return d.select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("document").alias("category"), F.octet_length("text").cast("long").alias("size"), F.timestamp_seconds(seconds).alias("modified"), seconds.alias("modified_at"), "text", "lang")


_FILES_SQL = f"""files AS (SELECT doc_id, coalesce(source, '') || '/' || doc_id || '.txt' AS path, 'document' AS category, strlen(text) AS size, 1600000000 + doc_id * 7919 % 1000000 AS modified_at, text, lang,
  trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS flat FROM documents),
signed AS (SELECT *, CASE WHEN strlen(flat) >= 10 THEN sha256(flat) END AS signature FROM files)"""
_GROUPS_SQL = (
    _FILES_SQL
    + """,
g AS (SELECT signature, count(*) AS n_files, min(path) AS first_path FROM signed WHERE signature IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
grp AS (SELECT *, row_number() OVER (ORDER BY first_path) AS id FROM g),
ent AS (SELECT row_number() OVER (ORDER BY grp.id, path) AS id, grp.id AS group_id, path AS file_path, size AS file_size, modified_at FROM signed JOIN grp USING (signature))"""
)


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_files(spark, sf_dir)).withColumn("signature", text.text_signature(F.col("text"), "document"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Groups and entries as the store holds them."""
    signed = written(_signed(spark, sf_dir).drop("text"), "signed")  # each text is read and normalised once
    groups = with_rank(grouping.exact_groups(signed), ["first_path"], "id")
    entries = signed.join(groups.select("signature", F.col("id").alias("group_id")), "signature")
    entries = with_rank(entries.select("group_id", F.col("path").alias("file_path"), F.col("size").alias("file_size"), "modified", "modified_at"), ["group_id", "file_path"], "id")
    return groups.select("id", F.lit(1).cast("long").alias("session_id"), F.col("category").alias("file_type"), F.col("similarity").alias("similarity_score"), "n_files", "first_path"), entries


# ---------------------------------------------------------------- signatures and groups


@query(f"WITH {_FILES_SQL} SELECT path, signature FROM signed WHERE signature IS NOT NULL")
def doc_signature(spark, sf_dir):
    return _signed(spark, sf_dir).filter("signature is not null").select("path", "signature")


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '' AND x[1:1] <> '#' AND x[1:2] <> '//' AND x[1:2] <> '/*') AS k FROM documents)
SELECT doc_id, sha256(array_to_string(k, ' ')) AS signature FROM l WHERE len(k) > 0""")
def code_normalize(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", text.text_signature(F.col("text"), "code").alias("signature"))
    return d.filter("signature is not null")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def file_digest(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.text_signature(F.col("text"), "archive").alias("sha256"))


@query(f"WITH {_GROUPS_SQL} SELECT 'document' AS category, signature, n_files, first_path, 1.0::DOUBLE AS similarity FROM g")
def exact_groups(spark, sf_dir):
    return grouping.exact_groups(_signed(spark, sf_dir))


@query(f"WITH {_GROUPS_SQL} SELECT path, 'document' AS category, signature, first_path AS group_path FROM signed JOIN g USING (signature)")
def group_members(spark, sf_dir):
    return grouping.exact_members(_signed(spark, sf_dir).drop("text"))


@query(f"WITH {_FILES_SQL} SELECT 'document' AS category, signature[1:2] AS prefix, count(*) AS n_files, (count(*) * (count(*) - 1) // 2)::BIGINT AS n_pairs FROM signed WHERE signature IS NOT NULL GROUP BY 2")
def prefix_buckets(spark, sf_dir):
    return grouping.bucket_sizes(_signed(spark, sf_dir), length=2)


@query(f"WITH {_FILES_SQL}, b AS (SELECT count(*) AS n FROM signed WHERE signature IS NOT NULL GROUP BY signature[1:8]) SELECT sum(n * (n - 1) // 2)::BIGINT AS comparisons, max(n)::BIGINT AS largest FROM b")
def comparison_estimate(spark, sf_dir):
    return grouping.bucket_sizes(_signed(spark, sf_dir)).agg(F.sum("n_pairs").alias("comparisons"), F.max("n_files").alias("largest"))


@query(f"WITH {_FILES_SQL} SELECT a.path AS path_a, b.path AS path_b, CASE WHEN a.signature = b.signature THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity FROM signed a JOIN signed b ON a.signature[1:8] = b.signature[1:8] AND a.path < b.path")
def candidate_pairs(spark, sf_dir):
    p = grouping.candidate_pairs(_signed(spark, sf_dir).drop("text"))
    return p.select("path_a", "path_b", similarity.equality(F.col("signature_a"), F.col("signature_b")).alias("similarity"))


@query(f"""WITH {_FILES_SQL},
t AS (SELECT min(path) AS path, flat, regexp_replace(flat, '{_WS}', '', 'g') AS bare FROM signed WHERE signature IS NOT NULL GROUP BY flat),
p AS (SELECT a.path AS path_a, b.path AS path_b, length(a.bare) - 1 AS na, length(b.bare) - 1 AS nb FROM t a JOIN t b ON a.flat[1:8] = b.flat[1:8] AND a.path < b.path WHERE length(a.bare) > 1 AND length(b.bare) > 1 AND least(length(a.bare), length(b.bare)) - 1 >= 0.9 / 1.1 * (greatest(length(a.bare), length(b.bare)) - 1)),
w AS (SELECT path, bare FROM t WHERE path IN (SELECT path_a FROM p UNION SELECT path_b FROM p)),
gr AS (SELECT path, ch[i] || ch[i + 1] AS g, count(*) AS c FROM (SELECT path, string_split(bare, '') AS ch, unnest(range(1, length(bare))) AS i FROM w) GROUP BY ALL),
s AS (SELECT path_a, path_b, na, nb, sum(least(x.c, y.c)) AS both_n FROM p JOIN gr x ON x.path = path_a JOIN gr y ON y.path = path_b AND y.g = x.g GROUP BY ALL)
SELECT path_a, path_b, round(2.0 * both_n / (na + nb), 9)::DOUBLE AS similarity FROM s WHERE 2.0 * both_n / (na + nb) >= 0.9""")
def dice_pairs(spark, sf_dir):
    f = spread(_files(spark, sf_dir)).select("path", "category", text.normal_text(F.col("text")).alias("normal"))
    return grouping.dice_pairs(f, "normal", 0.9).withColumn("similarity", F.round("similarity", 9))


# ---------------------------------------------------------------- hashes


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of a vector as 64 characters of 0 and 1 and as one 64-bit word."""
    e = _table(spark, sf_dir, "embeddings").filter("embedding is not null")
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    half = lambda i: F.conv(F.substring("signature", i, 32), 2, 10).cast("long")
    e = e.select(F.format_string("v%06d", F.col("vec_id")).alias("path"), F.lit("video").alias("category"), bits.alias("signature"))
    return e.withColumn("word", F.shiftleft(half(1), 32).bitwiseOR(half(33)))


_BITS_SQL = "b AS (SELECT printf('v%06d', vec_id) AS path, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS s FROM embeddings WHERE embedding IS NOT NULL)"


def _near_hashes(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    pairs = grouping.candidate_pairs(_hashed(spark, sf_dir), carry=("word",))
    return grouping.similar_pairs(pairs, similarity.video_similarity(F.array("word_a"), F.array("word_b")), threshold)


@query(f"WITH {_BITS_SQL} SELECT x.path AS path_a, y.path AS path_b, (1 - hamming(x.s, y.s) / 64.0)::DOUBLE AS similarity FROM b x JOIN b y ON x.s[1:8] = y.s[1:8] AND x.path < y.path WHERE 1 - hamming(x.s, y.s) / 64.0 >= 0.6")
def hamming_pairs(spark, sf_dir):
    return _near_hashes(spark, sf_dir, 0.6).select("path_a", "path_b", "similarity")


@query(f"WITH {_BITS_SQL} SELECT x.path AS path_a, y.path AS path_b, round(least(1 - hamming(x.s[1:20], y.s[1:20]) / 20.0, 1 - hamming(x.s[21:40], y.s[21:40]) / 20.0, 1 - hamming(x.s[41:60], y.s[41:60]) / 20.0), 9)::DOUBLE AS similarity FROM b x JOIN b y ON x.s[1:8] = y.s[1:8] AND x.path < y.path WHERE least(1 - hamming(x.s[1:20], y.s[1:20]) / 20.0, 1 - hamming(x.s[21:40], y.s[21:40]) / 20.0, 1 - hamming(x.s[41:60], y.s[41:60]) / 20.0) >= 0.55")
def multi_hash_min(spark, sf_dir):
    h = _hashed(spark, sf_dir)
    for i in range(3):
        h = h.withColumn(f"h{i}", F.array(F.conv(F.substring("signature", 20 * i + 1, 20), 2, 10).cast("long")))
    p = grouping.candidate_pairs(h, carry=("h0", "h1", "h2"))
    s = similarity.image_similarity([(F.col(f"h{i}_a"), F.col(f"h{i}_b")) for i in range(3)], 20)
    return p.select("path_a", "path_b", F.round(s, 9).alias("similarity")).filter("similarity >= 0.55")


@query()
def strict_groups(spark, sf_dir):
    return grouping.strict_groups(_near_hashes(spark, sf_dir, 0.6))


@query(f"WITH {_BITS_SQL}, p AS (SELECT (1 - hamming(x.s, y.s) / 64.0) * 100 AS p FROM b x JOIN b y ON x.s[1:8] = y.s[1:8] AND x.path < y.path) SELECT count(*) FILTER (p >= 95) AS above_95, count(*) FILTER (p >= 80 AND p < 95) AS from_80, count(*) FILTER (p >= 60 AND p < 80) AS from_60, count(*) FILTER (p < 60) AS below_60 FROM p")
def similarity_histogram(spark, sf_dir):
    return report.histogram(_near_hashes(spark, sf_dir, 0.0))


@query("""WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM u GROUP BY 1), k AS (SELECT label, sqrt(sum(m * m)) AS k FROM m GROUP BY 1),
d AS (SELECT u.vec_id, m.label, sum(u.x * m.m) AS d FROM u JOIN m ON m.i = u.i GROUP BY ALL),
s AS (SELECT vec_id, label, greatest(0, least(1, d / (greatest(n, 1e-12) * greatest(k, 1e-12)))) AS s FROM d JOIN n USING (vec_id) JOIN k USING (label))
SELECT vec_id, label::VARCHAR AS label, round(s, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM s) WHERE r = 1""")
def nearest_prototype(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    proto = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(F.col("label").alias("idx"), F.col("label").cast("string").alias("label"), F.col("v.m").alias("embedding"))
    best = classify.nearest_prototype(e.select("vec_id", "embedding"), proto, "vec_id")
    return best.select("vec_id", "label", F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- survivors and reports


def _keep(keep: str):
    def run(spark, sf_dir):
        _, entries = _stored(spark, sf_dir)
        return survivors.mark_survivors(entries, keep).filter("kept").select("group_id", "file_path", "file_size")

    return run


_ORDER = {"newest": "modified_at DESC, id DESC", "oldest": "modified_at, id", "largest": "file_size DESC, id DESC"}
for _name, _order in _ORDER.items():
    QUERIES[f"keep_{_name}"] = _keep(_name)
    SQL[f"keep_{_name}"] = f"WITH {_GROUPS_SQL} SELECT group_id, file_path, file_size FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {_order}) AS r FROM ent) WHERE r = 1"


@query(f"WITH {_GROUPS_SQL} SELECT group_id, id, file_path, file_size, 'Would delete: ' || file_path || ' (' || printf('%.2f', file_size / 1048576.0) || ' MB) [group ' || group_id || ' - 100.0% similar]' AS action FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY modified_at DESC, id DESC) AS r FROM ent) WHERE r > 1")
def delete_plan(spark, sf_dir):
    groups, entries = _stored(spark, sf_dir)
    return survivors.delete_plan(entries, groups, "newest")


@query(f"WITH {_GROUPS_SQL} SELECT 0 AS deleted, 0 AS failed, (SELECT count(*) FROM ent) - (SELECT count(*) FROM grp) AS actions")
def delete_stats(spark, sf_dir):
    groups, entries = _stored(spark, sf_dir)
    return survivors.delete_stats(survivors.delete_plan(entries, groups, "largest"))


@query(f"WITH {_GROUPS_SQL} SELECT count(*) AS n_groups, coalesce(sum(n_files), 0)::BIGINT AS n_files FROM g")
def scan_totals(spark, sf_dir):
    return report.totals(grouping.exact_groups(_signed(spark, sf_dir)))


@query(f"WITH {_GROUPS_SQL} SELECT first_path, n_files, similarity FROM (SELECT *, 1.0::DOUBLE AS similarity FROM g) ORDER BY similarity DESC, first_path LIMIT 50")
def paginate_groups(spark, sf_dir):
    return report.page(grouping.exact_groups(_signed(spark, sf_dir)), 0).select("first_path", "n_files", "similarity")


@query(f"WITH {_GROUPS_SQL} SELECT group_id, id, group_id || ',document,1.0000,\"' || file_path || '\",' || file_size || ',' || modified_at AS line FROM ent")
def export_csv_rows(spark, sf_dir):
    groups, entries = _stored(spark, sf_dir)
    return report.csv_lines(groups, entries.withColumn("modified_time", F.col("modified_at").cast("string")))


@query(f"WITH {_GROUPS_SQL} SELECT group_id AS number, id, group_id || ',document,1.0000,\"' || file_path || '\",' || file_size AS line FROM ent")
def export_display_rows(spark, sf_dir):
    groups, entries = _stored(spark, sf_dir)
    return report.display_csv_lines(groups, entries)


@query(f"""WITH {_GROUPS_SQL}, f AS (SELECT group_id, string_agg('{{"file_path":"' || file_path || '","file_size_bytes":' || file_size || ',"modified_time":"' || modified_at || '"}}', ',' ORDER BY file_path, file_size, modified_at) AS files FROM ent GROUP BY 1)
SELECT 1::BIGINT AS session_id, group_id, '{{"group_id":' || group_id || ',"file_type":"document","similarity":1.0,"files":[' || files || ']}}' AS json FROM f""")
def export_json_groups(spark, sf_dir):
    groups, entries = _stored(spark, sf_dir)
    return report.json_groups(groups, entries.withColumn("modified_time", F.col("modified_at").cast("string")))


@query(f"WITH {_GROUPS_SQL} SELECT 'Group ' || id || ' [document] - 100.0% similar' AS line FROM grp UNION ALL SELECT '  ' || file_path || ' (' || printf('%.2f', file_size / 1048576.0) || ' MB)' FROM ent")
def group_list(spark, sf_dir):
    groups, entries = _stored(spark, sf_dir)
    heads = groups.select(formats.group_line(F.col("id"), F.col("file_type"), F.col("similarity_score")).alias("line"))
    return heads.unionByName(entries.select(F.concat(F.lit("  "), F.col("file_path"), F.lit(" ("), formats.megabytes(F.col("file_size")), F.lit(")")).alias("line")))


# ---------------------------------------------------------------- paths, sizes, sorting


_NAME_SQL = "n AS (SELECT doc_id, coalesce(source, '') || '/' || lang || (doc_id // 20) || CASE WHEN doc_id % 48 = 47 THEN '' ELSE '.' || (CASE WHEN doc_id % 2 = 0 THEN upper(e) ELSE e END) END AS path FROM (SELECT *, [" + ", ".join(f"'{e}'" for e in _EXTS) + "][doc_id % 47 + 1] AS e FROM documents))"
_CATEGORY_SQL = "CASE " + " ".join(f"WHEN extension IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in EXTENSIONS.items()) + " END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up names: every known extension in turn, half in capitals, some names without any, clashes among neighbours."""
    d = _table(spark, sf_dir, "documents")
    e = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % 47 + 1).cast("int"))
    e = F.when(F.col("doc_id") % 2 == 0, F.upper(e)).otherwise(e)
    tail = F.when(F.col("doc_id") % 48 == 47, "").otherwise(F.concat(F.lit("."), e))
    return d.select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), "lang", F.floor(F.col("doc_id") / 20).cast("string"), tail).alias("path"))


@query(f"WITH {_NAME_SQL}, x AS (SELECT doc_id, path, nullif(lower(regexp_extract(path, '^.+\\.([^.]*)$', 1)), '') AS extension FROM n) SELECT doc_id, extension, {_CATEGORY_SQL} AS category FROM x")
def extension_category(spark, sf_dir):
    f = _named(spark, sf_dir).withColumn("extension", paths.extension(paths.file_name(F.col("path"))))
    return f.select("doc_id", "extension", paths.category(F.col("extension")).alias("category"))


@query("SELECT category, extensions FROM (VALUES " + ", ".join(f"('{k}', '{','.join(sorted(v))}')" for k, v in EXTENSIONS.items()) + ") t(category, extensions)")
def category_extensions(spark, sf_dir):
    rows = spark.createDataFrame([(k, e) for k, v in EXTENSIONS.items() for e in v], "category string, ext string")
    return rows.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("extensions"))


@query("SELECT CASE WHEN strlen(text) < 1024 OR strlen(text) > 8192 THEN 'skipped_other' ELSE 'found' END AS status, count(*) AS n FROM documents GROUP BY 1")
def size_filter_stats(spark, sf_dir):
    f = _files(spark, sf_dir).select("size", F.lit("found").alias("status"), F.lit("txt").alias("extension"), "category")
    from kinfold.sources.files import classify_status

    return report.status_counts(classify_status(f, None, 1024, 8192))


_DIRS = [*EXCLUDED_DIRS, "src", "docs", "photos"]


@query(f"WITH p AS (SELECT page_id, 'root/' || [{', '.join(repr(d) for d in _DIRS)}][page_id % {len(_DIRS)} + 1] || '/' || regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) SELECT page_id, path FROM p WHERE NOT list_has_any(string_split(path, '/')[1:-2], [{', '.join(repr(d) for d in EXCLUDED_DIRS)}])")
def excluded_dirs(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    d = F.element_at(F.array(*map(F.lit, _DIRS)), (F.col("page_id") % len(_DIRS) + 1).cast("int"))
    p = p.select("page_id", F.concat(F.lit("root/"), d, F.lit("/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))
    return p.filter(~paths.in_excluded_dir(F.col("path")))


_DEST_SQL = f"{_NAME_SQL}, x AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, nullif(lower(regexp_extract(path, '^.+\\.([^.]*)$', 1)), '') AS extension FROM n), d AS (SELECT path, name, extension, CASE WHEN extension IS NULL THEN 'skipped' ELSE 'moved' END AS status, CASE WHEN extension IS NOT NULL THEN '/sorted/' || coalesce({_CATEGORY_SQL} || 's', 'others') END AS dest_dir FROM x)"


@query(f"WITH {_DEST_SQL} SELECT * FROM d")
def sort_destinations(spark, sf_dir):
    return sorter.destinations(_named(spark, sf_dir).select("path"), "/sorted")


@query(f"WITH {_DEST_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dest_dir, name ORDER BY path) - 1 AS k FROM d WHERE status = 'moved') SELECT path, name, dest_dir, dest_dir || '/' || CASE WHEN k = 0 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '_' || k || regexp_extract(name, '(\\.[^.]*)$', 1) END AS dest_path FROM r")
def sort_conflicts(spark, sf_dir):
    return sorter.resolve(sorter.destinations(_named(spark, sf_dir).select("path"), "/sorted"))


@query(f"WITH {_DEST_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'moved') AS moved, 0::BIGINT AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM d")
def sort_stats(spark, sf_dir):
    return sorter.stats(sorter.destinations(_named(spark, sf_dir).select("path"), "/sorted"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_totalprice * 100 AS BIGINT) * (o_orderkey % 1000) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS by_1024,
CASE WHEN n >= 1000000000 THEN printf('%.1f GB', n / 1e9) WHEN n >= 1000000 THEN printf('%.1f MB', n / 1e6) WHEN n >= 1000 THEN printf('%.0f KB', n / 1e3) ELSE n || ' B' END AS by_1000,
CASE WHEN o_orderkey >= 3600 THEN printf('%dh%02dm%02ds', o_orderkey // 3600, o_orderkey % 3600 // 60, o_orderkey % 60) WHEN o_orderkey >= 60 THEN printf('%dm%02ds', o_orderkey // 60, o_orderkey % 60) ELSE o_orderkey || 's' END AS took FROM s""")
def format_sizes(spark, sf_dir):
    n = F.rint(F.col("o_totalprice") * 100).cast("long") * (F.col("o_orderkey") % 1000)
    o = _table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"))
    return o.select("o_orderkey", formats.binary_size(F.col("n")).alias("by_1024"), formats.decimal_size(F.col("n")).alias("by_1000"), formats.duration(F.col("o_orderkey")).alias("took"))


# ---------------------------------------------------------------- caches, sessions


_CACHE_SQL = f"{_FILES_SQL}, lab AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1), cache AS (SELECT path AS file_path, size + toxic AS file_size, modified_at, category, signature FROM signed JOIN lab USING (doc_id) WHERE signature IS NOT NULL)"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label are cached; toxic ones with a stale size."""
    lab = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    s = _signed(spark, sf_dir).drop("text").join(lab, "doc_id").filter("signature is not null")
    return s.select(F.col("path").alias("file_path"), (F.col("size") + F.col("toxic")).alias("file_size"), "modified_at", "category", "signature")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.streaming.incremental import split_by_cache

    f = _files(spark, sf_dir).select(F.col("path").alias("file_path"), F.col("size").alias("file_size"), "modified_at", "category")
    return split_by_cache(f, _cache(spark, sf_dir))


@query(f"WITH {_CACHE_SQL} SELECT count(*) FILTER (c.signature IS NOT NULL) AS cached, count(*) FILTER (c.signature IS NULL) AS computed FROM files f LEFT JOIN cache c ON c.file_path = f.path AND c.file_size = f.size AND c.modified_at = f.modified_at AND c.category = f.category")
def cache_hits(spark, sf_dir):
    from kinfold.streaming.incremental import hit_counts

    return hit_counts(_split(spark, sf_dir))


@query(f"WITH {_CACHE_SQL} SELECT f.path AS file_path FROM files f LEFT JOIN cache c ON c.file_path = f.path AND c.file_size = f.size AND c.modified_at = f.modified_at AND c.category = f.category WHERE c.signature IS NULL")
def cache_misses(spark, sf_dir):
    return _split(spark, sf_dir).filter("not from_cache").select("file_path")


@query(f"WITH {_CACHE_SQL}, new AS (SELECT path AS file_path, size AS file_size, modified_at + 1 AS modified_at, category, coalesce(signature, '-') AS signature FROM signed WHERE lang = 'en') SELECT * FROM new UNION ALL SELECT * FROM cache WHERE (file_path, category) NOT IN (SELECT file_path, category FROM new)")
def cache_upsert(spark, sf_dir):
    new = _signed(spark, sf_dir).filter("lang = 'en'").select(F.col("path").alias("file_path"), F.col("size").alias("file_size"), (F.col("modified_at") + 1).alias("modified_at"), "category", F.coalesce("signature", F.lit("-")).alias("signature"))
    return stores.upsert(_cache(spark, sf_dir), new, ["file_path", "category"])


@query("SELECT event_id, rpad(event_id::VARCHAR, 6, ' ') || ' ' || rpad('completed', 12, ' ') || ' ' || rpad(strftime(ts, '%Y-%m-%d %H:%M:%S'), 22, ' ') || ' ' || event_type AS line FROM events")
def session_list(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    line = formats.session_line(F.col("event_id"), F.lit("completed"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_type"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", line.alias("line"))


@query("SELECT c_custkey AS id, c_nationkey::BIGINT AS group_id, c_name AS file_path FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1")
def cascade_delete(spark, sf_dir):
    sessions = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    groups = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("session_id"))
    entries = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("group_id"), F.col("c_name").alias("file_path"))
    gone = stores.cascade(sessions, groups, entries, 1)
    return gone[2]


@query("SELECT n_regionkey::BIGINT AS session_id, n_nationkey::BIGINT AS group_id, count(c_custkey) AS n_files, coalesce(min(c_name), '') AS first_path FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def session_files(spark, sf_dir):
    groups = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_regionkey").cast("long").alias("session_id"))
    per = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("group_id")).agg(F.count("*").alias("n_files"), F.min("c_name").alias("first_path"))
    return groups.join(per, "group_id", "left").select("session_id", "group_id", F.coalesce("n_files", F.lit(0).cast("long")).alias("n_files"), F.coalesce("first_path", F.lit("")).alias("first_path"))


@query("SELECT DISTINCT source AS path FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]*)', 1) FROM pages WHERE url IS NOT NULL")
def incremental_union(spark, sf_dir):
    a = _table(spark, sf_dir, "documents").filter("source is not null").select(F.col("source").alias("path"))
    b = _table(spark, sf_dir, "pages").filter("url is not null").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("path"))
    return a.unionByName(b).distinct()


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def select_difference(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {_GROUPS_SQL}, k AS (SELECT * FROM ent JOIN documents ON file_path = coalesce(source, '') || '/' || doc_id || '.txt' WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT file_path AS path, group_id FROM k WHERE group_id IN (SELECT group_id FROM k GROUP BY 1 HAVING count(*) >= 2)")
def prune_groups(spark, sf_dir):
    _, entries = _stored(spark, sf_dir)
    lab = _table(spark, sf_dir, "labels").select("doc_id").distinct()
    gone = _files(spark, sf_dir).join(lab, "doc_id").select("path")
    members = entries.select(F.col("file_path").alias("path"), F.col("group_id").alias("group_path"))
    return survivors.without(members, gone).select("path", F.col("group_path").alias("group_id"))


# ---------------------------------------------------------------- image classes


_PART_SQL = "i AS (SELECT p_partkey, (p_size * 40)::INTEGER AS w, (p_partkey % 50 * 45)::INTEGER AS h, p_partkey % 7 = 0 AS e, CAST(p_retailprice * 400 AS BIGINT) AS s, (p_size / 50.0)::FLOAT AS luma, (p_partkey % 10 / 20.0)::FLOAT AS edge FROM part)"
_SCREENS = " OR ".join(f"(greatest(w, h) = {a} AND least(w, h) = {b})" for a, b in DESKTOP_SIZES)
_T0_SQL = f"t0 AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN NULL WHEN greatest(w, h) <= 256 AND s < 524288 THEN 'logo_icon' WHEN e THEN 'photo_general' WHEN ({_SCREENS}) OR (w > h AND w::FLOAT / h::FLOAT BETWEEN 1.5 AND 2.4::FLOAT AND w >= 1280) THEN 'screenshot_desktop' WHEN h > w AND h::FLOAT / w::FLOAT BETWEEN 1.7::FLOAT AND 2.3::FLOAT THEN 'screenshot_mobile' END AS c0 FROM i)"
_T1_SQL = "CASE WHEN edge > 0.35::FLOAT AND luma > 0.2::FLOAT AND luma < 0.92::FLOAT THEN 'diagram' WHEN luma > 0.85::FLOAT AND edge < 0.2::FLOAT THEN 'scanned_document' END"
_CONF = {"logo_icon": 0.85, "photo_general": 0.65, "screenshot_desktop": 0.75, "screenshot_mobile": 0.72, "diagram": 0.45, "scanned_document": 0.4}
_CONF_SQL = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}::FLOAT" for k, v in _CONF.items()) + " END"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", (F.col("p_size") * 40).cast("int").alias("w"), (F.col("p_partkey") % 50 * 45).cast("int").alias("h"), (F.col("p_partkey") % 7 == 0).alias("e"), F.round(F.col("p_retailprice") * 400).cast("long").alias("s"), (F.col("p_size") / 50.0).cast("float").alias("luma"), (F.col("p_partkey") % 10 / 20.0).cast("float").alias("edge"))


def _tier0():
    return classify.tier0(F.col("w"), F.col("h"), F.col("e"), F.col("s"))


def _tier1():
    return classify.tier1(F.col("luma"), F.col("edge"))


@query(f"WITH {_PART_SQL}, {_T0_SQL} SELECT p_partkey, c0 AS category, round(({_CONF_SQL('c0')})::DOUBLE, 6) AS confidence FROM t0")
def tier0_classify(spark, sf_dir):
    r = _images(spark, sf_dir).withColumn("r", _tier0())
    return r.select("p_partkey", F.col("r.category").alias("category"), F.round(F.col("r.confidence").cast("double"), 6).alias("confidence"))


@query(f"WITH {_PART_SQL} SELECT p_partkey, c1 AS category, round(({_CONF_SQL('c1')})::DOUBLE, 6) AS confidence FROM (SELECT *, {_T1_SQL} AS c1 FROM i)")
def tier1_classify(spark, sf_dir):
    r = _images(spark, sf_dir).withColumn("r", _tier1())
    return r.select("p_partkey", F.col("r.category").alias("category"), F.round(F.col("r.confidence").cast("double"), 6).alias("confidence"))


@query(f"""WITH {_PART_SQL}, {_T0_SQL}, t1 AS (SELECT *, {_T1_SQL} AS c1 FROM t0)
SELECT p_partkey, CASE WHEN c0 IS NOT NULL THEN c0 WHEN c1 IS NOT NULL THEN c1 ELSE 'other' END AS category,
round((CASE WHEN c0 IS NOT NULL THEN {_CONF_SQL('c0')} WHEN c1 IS NOT NULL THEN {_CONF_SQL('c1')} * 0.85::FLOAT ELSE 0.2::FLOAT END)::DOUBLE, 6) AS confidence,
CASE WHEN c0 IS NULL AND c1 IS NOT NULL THEN 1 ELSE 0 END AS tier FROM t1""")
def tier_escalation(spark, sf_dir):
    r = _images(spark, sf_dir).withColumn("r", classify.escalate(_tier0(), _tier1()))
    return r.select("p_partkey", F.col("r.category").alias("category"), F.round(F.col("r.confidence").cast("double"), 6).alias("confidence"), F.col("r.tier").cast("int").alias("tier"))
