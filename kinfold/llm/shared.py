"""What several operators of this folder share: scratch tables, byte-level text views, hashing, components.

Scratch tables are Parquet files below the folder named in ``spark.checkpoint.dir`` (which every executor reaches), so a lost
executor costs a re-read and never a lost table. Texts are handled as the UTF-8 bytes of Arrow string buffers, so
one numpy call covers megabytes of text and no Python object is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handed to one numpy pass. A longer single text is handled alone, whole.
CHUNK_BYTES = 512 << 10


# ---------------------------------------------------------------- tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local folder only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one that a later table replaces."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{scratch_root(spark)}/kinfold/{label}-{uuid.uuid4().hex}", 0
        self.paths: list[tuple[DataFrame, str]] = []

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        at = self.path()
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.paths.append((out, at))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing still reads, and let Spark drop shuffle files that nothing refers to."""
        jvm = self.spark.sparkContext._jvm
        for at in [at for df, at in self.paths if any(df is x for x in tables)]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = [(df, at) for df, at in self.paths if not any(df is x for x in tables)]
        jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if the plan knows it to be small (8 MB a core at most): a small file is often one row group and so one task. A larger table is never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * (8 << 20) else df


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send workers batches of so many rows at most: a batch lies off the JVM's heap and in the worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``fold``; a null id counts as held out, so it is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


# ---------------------------------------------------------------- memory of workers

#: What operators keep in a worker process between tasks: name, and how to let it go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(name: str, clear: Callable[[], None]) -> None:
    """An operator's module says how to drop what it keeps in a worker (vocabularies, remembered words)."""
    _KEPT[name] = clear


def claim(name: str) -> None:
    """Called first in a task: a worker is used again by other operators, and holds the belongings of one at a time."""
    for other, clear in _KEPT.items():
        if other != name:
            clear()
    release()


def release() -> None:
    """Give free memory back to the machine, so a worker that waits for its next task is small."""
    gc.collect()
    trim()


def trim() -> None:
    """As ``release``, of what is known to be free."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: the allocator decides
        pass


# ---------------------------------------------------------------- bytes of texts

SPACE, WORD, MARK = 0, 1, 2
#: ASCII letters, digits and every byte of a longer UTF-8 character are WORD; ASCII punctuation MARK; the rest SPACE.
PLAIN = np.zeros(256, np.uint8)
for _b in range(33, 127):
    PLAIN[_b] = WORD if chr(_b).isalnum() else MARK
PLAIN[128:] = WORD
#: Words are runs of anything but 0x20 and 0x09-0x0D.
UNSPACED = np.full(256, WORD, np.uint8)
UNSPACED[[32, 9, 10, 11, 12, 13]] = SPACE
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi with the bytes of their texts end to end and their offsets in it; null is an empty text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 40)) | np.uint64(1)


_PLACES = seeds(64, 1)


def words(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and document of each word: runs of WORD, and each MARK alone. Words never span documents."""
    kind = classes[data]
    n = len(kind)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == MARK
    first[off[:-1][off[:-1] < n]] = True
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, n))
    full = kind[at] != SPACE
    at, length = at[full], length[full]
    return at, length, np.searchsorted(off, at, "right") - 1


def word_hashes(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word and its length."""
    global _PLACES
    if not len(at):
        return np.zeros(0, np.uint64)
    longest = int(length.max())
    if longest > len(_PLACES):
        _PLACES = seeds(1 << longest.bit_length(), 1)
    total = int(length.sum())
    ends = np.cumsum(length)
    begin = ends - length
    place = np.arange(total) - np.repeat(begin, length)
    value = data[np.repeat(at, length) + place].astype(np.uint64)
    value += np.uint64(1)
    value *= _PLACES[place]
    return mix(np.add.reduceat(value, begin) + length.astype(np.uint64))


def utf8(batch: pa.RecordBatch, name: str, lower: bool = True) -> pa.Array:
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(name))
    return pc.utf8_lower(col) if lower else col


# ---------------------------------------------------------------- components


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``: the smallest node of its component.

    Large-star / small-star contraction over two long columns: each round is two pre-aggregated group-bys and two joins on the
    node, so a star of any size is spread by AQE's skew join; rounds grow with the logarithm of the longest chain.
    Nothing but one count a round comes to the driver. A null end is ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = scratch.write(e)
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v").distinct()
        nxt = scratch.write(small)
        # A forest of stars is reached when no centre is itself below another node.
        done = nxt.select(F.col("v").alias("u")).distinct().join(nxt.select("u").distinct(), "u", "left_semi").isEmpty()
        # and every node has one centre
        done = done and nxt.groupBy("u").count().filter("count > 1").isEmpty()
        scratch.drop(e)
        e = nxt
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
