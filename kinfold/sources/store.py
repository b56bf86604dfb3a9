"""The session store: six Parquet tables, each a folder of numbered versions (v=) and additions (a=).

A reader takes the last whole version and the additions after it, each seen once its ``_SUCCESS`` mark is there. New rows are an addition; a change or an upsert writes a whole version,
as plain Parquet has no merge: a union and one pre-aggregated pick a key. Numbers are claimed by a mark that only one writer can make, so two writers never share a folder; of two that
replace the same table at once the later one stands.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.schema import TABLES


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``; a local one only for a local master without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinfold-")
    return found.rstrip("/")


class SessionStore:
    """Scan sessions, their groups and entries, and the two caches, below ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_folder(spark)}/store").rstrip("/")

    # -- tables

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, table: str) -> list[tuple[int, str]]:
        """Number and name of every version and addition of a table, finished or not."""
        path, fs = self._path(table)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(n[2:]), n) for n in names if n[:2] in ("v=", "a="))

    def _parts(self, table: str) -> list[str]:
        """The last whole version and the finished additions after it."""
        done = [(n, name) for n, name in self._folders(table) if (p := self._path(table, name, "_SUCCESS")) and p[1].exists(p[0])]
        whole = [n for n, name in done if name[0] == "v"]
        return [name for n, name in done if n >= (whole[-1] if whole else 0)]

    def _claim(self, table: str) -> int:
        """A number that no other writer has: the mark is made by one of them only."""
        n = max([n for n, _ in self._folders(table)], default=0) + 1
        while True:
            path, fs = self._path(table, f"_claim-{n:08d}")
            if fs.createNewFile(path):
                return n
            n += 1

    def read(self, table: str) -> DataFrame:
        parts = self._parts(table)
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{table}/{p}" for p in parts])

    def _write(self, table: str, kind: str, rows: DataFrame) -> None:
        names = [f.name for f in self.spark.createDataFrame([], TABLES[table]).schema]
        full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in names])
        full.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], TABLES[table]).schema]).write.parquet(f"{self.root}/{table}/{kind}={self._claim(table):08d}")

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace a table. The new version is whole before it is seen; the one before stays for readers under way."""
        self._write(table, "v", rows)

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows; what is there already is not written again."""
        self._write(table, "a", rows)

    def scratch(self, rows: DataFrame, label: str) -> DataFrame:
        """``rows`` written once and read back, so what follows does not make them anew; ``vacuum`` removes it."""
        at = f"{self.root}/_scratch/{label}-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def vacuum(self, file_bytes: int = 128 << 20) -> None:
        """Write every table anew in files of about ``file_bytes``, and drop older versions and scratch tables. For a time without readers or writers."""
        for table in TABLES:
            old = self._folders(table)
            if not old:
                continue
            rows = self.read(table)
            size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            self.write(table, rows.repartition(max(1, -(-size // file_bytes))))
            for n, name in old:
                for path, fs in (self._path(table, name), self._path(table, f"_claim-{n:08d}")):
                    fs.delete(path, True)
        path, fs = self._path("_scratch")
        fs.delete(path, True)

    # -- sessions

    def _next_id(self, table: str) -> int:
        return (self.read(table).agg(F.max("id")).first()[0] or 0) + 1

    def create_session(self, name: str, file_types: list[str], threshold: float) -> int:
        import json

        new = self._next_id("scan_sessions")
        row = self.spark.createDataFrame([(new, name, None, "pending", json.dumps(file_types), float(threshold))], "id long, name string, completed_at string, status string, file_types string, similarity_threshold double")
        self.append("scan_sessions", row.withColumn("created_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")))
        return new

    def update_status(self, session: int, status: str) -> None:
        """Set the status; ``completed`` also stamps the time."""
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
        s, hit = self.read("scan_sessions"), F.col("id") == session
        s = s.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
        self.write("scan_sessions", s.withColumn("completed_at", F.when(hit & F.lit(status == "completed"), now).otherwise(F.col("completed_at"))))

    def session(self, session: int):
        found = self.read("scan_sessions").filter(F.col("id") == session).take(1)
        if not found:
            raise KeyError(f"no session {session}")
        return found[0]

    def sessions(self) -> DataFrame:
        return self.read("scan_sessions").orderBy(F.desc("created_at"), F.desc("id"))

    def clear_sessions(self) -> int:
        """Drop all sessions, and with them groups and entries; how many there were."""
        n = self.read("scan_sessions").count()
        for table in ("file_entries", "duplicate_groups", "scan_sessions"):
            self.write(table, self.spark.createDataFrame([], TABLES[table]))
        return n

    def delete_session(self, session: int) -> None:
        sessions, groups, entries = cascade(*(self.read(t) for t in ("scan_sessions", "duplicate_groups", "file_entries")), session)
        for table, rows in (("file_entries", entries), ("duplicate_groups", groups), ("scan_sessions", sessions)):
            self.write(table, rows)

    # -- groups and entries

    def groups(self, session: int) -> DataFrame:
        return self.read("duplicate_groups").filter(F.col("session_id") == session).orderBy(F.desc("similarity_score"), "id")

    def entries(self, group: int) -> DataFrame:
        return self.read("file_entries").filter(F.col("group_id") == group)

    def session_entries(self, session: int) -> DataFrame:
        """Entries of all groups of a session in one join."""
        own = self.read("duplicate_groups").filter(F.col("session_id") == session).select(F.col("id").alias("group_id"), "file_type", "similarity_score")
        return self.read("file_entries").join(own, "group_id")

    def delete_entry(self, entry: int) -> None:
        self.write("file_entries", self.read("file_entries").filter(F.col("id") != entry))

    def add_groups(self, session: int, members: DataFrame) -> None:
        """Append groups from rows (category, group_path, similarity, path, size, modified); ids go on from the last, in order of the group's path. Also how a merge adds a second scan to a session."""
        from kinfold.plans.ranks import with_rank

        first_group, first_entry = self._next_id("duplicate_groups"), self._next_id("file_entries")
        groups = members.groupBy("category", "group_path").agg(F.min("similarity").alias("similarity_score"))
        groups = with_rank(groups, ["category", "group_path"], "id").withColumn("id", F.col("id") + first_group - 1)
        rows = members.join(groups, ["category", "group_path"]).select(F.col("id").alias("group_id"), F.col("path").alias("file_path"), F.col("size").alias("file_size"), F.unix_seconds("modified").cast("string").alias("modified_time"))
        rows = with_rank(rows, ["group_id", "file_path"], "id").withColumn("id", F.col("id") + first_entry - 1).withColumn("marked_for_deletion", F.lit(False))
        self.append("duplicate_groups", groups.select("id", F.lit(session).cast("long").alias("session_id"), F.col("category").alias("file_type"), "similarity_score"))
        self.append("file_entries", rows)

    # -- caches

    def cache_signatures(self, rows: DataFrame) -> None:
        self.write("signature_cache", upsert(self.read("signature_cache"), rows, ["file_path", "category"]))

    def cache_classes(self, rows: DataFrame) -> None:
        self.write("classification_cache", upsert(self.read("classification_cache"), rows, ["file_path"]))

    def cached_classes(self, files: DataFrame) -> DataFrame:
        return probe(files, self.read("classification_cache"), ["file_path", "file_size", "modified_at"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; of several new ones the largest by modified_at, then by value."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    order = F.struct("_new", *(["modified_at"] if "modified_at" in rest else []), *[c for c in rest if c != "modified_at"])
    best = both.groupBy(*keys).agg(F.max(order).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in old.columns])


def probe(files: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """``files`` left-joined with a cache on all keys: stale rows (size or time changed) miss."""
    return files.join(cache, keys, "left")


def cascade(sessions: DataFrame, groups: DataFrame, entries: DataFrame, session: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left after a session, its groups and their entries are gone."""
    gone = groups.filter(F.col("session_id") == session).select(F.col("id").alias("group_id"))
    return sessions.filter(F.col("id") != session), groups.filter(F.col("session_id") != session), entries.join(gone, "group_id", "left_anti")
