"""N-gram Jaccard join by parity sketches: every pair of documents whose shingle sets have Jaccard similarity T / 100 or more, as classes.

Sketch. A shingle is a 64-bit hash; its leading bits choose one of P parts, and a part holds the XOR of the hashes that fell there. XOR cancels what two sets
share, so a part of A XOR the same part of B is the XOR of the shingles that only one of them has there: two sketches differ in at most |A delta B| parts. The
Hamming distance of the sketches, counted in parts, thus bounds the symmetric difference from below.

Size bands. Linked sizes differ at most by the factor 100 / T, so with bands that wide (edges in integers) the two lie in the same band or in neighbours. A
document shows a sketch for its own band and one for the next; family j serves all pairs whose larger member is in band j. There
|A delta B| <= D_j = (100 - T) / (100 + T) * 2 * (largest size of the band).

Pigeonhole with slack. With P = D + 1 + s parts, linked sketches agree in at least s + 1 parts. Let all documents order keys (family, part, value) alike, most frequent first,
and leave out the first s of their own: the rarest key that two linked documents share is past the first s in both, so it stays. This removes empty parts and
passages that many documents share from the candidate search without losing a pair; no cap exists.

Verify. Documents of a key are first held against the smallest of them; exact intersections of whole shingle sets decide. Then the documents that were held against the same
one, which every two documents of a key are, are compared among themselves where they still lie in several components: chunk by chunk, all pairs by matrix products, only
a forest of links leaving a task. Pairs inside a component cannot change the classes. Documents with equal sets are one node throughout.

Cost: about 0.4 * (100 - T) / 15 keys of 16 bytes per shingle cross the network twice; texts move once, for the documents that are in a candidate pair.

Defined cases: null or empty text, or no word: n_shingles 0, linked with nothing, also not with each other. Fewer words than a shingle has: the whole sequence is the one
shingle. Rows that share an id are one node. A null id: its size is given, it links with nothing, component null. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import shared


@dataclass(frozen=True)
class JaccardConfig:
    shingle: int = 5
    percent: int = 80
    slack: float = 0.1
    chunk: int = 1024
    largest: int = 1 << 40
    range_bytes: int = 8 << 20
    hot: int = 64

    def bands(self) -> list[tuple[int, int, int, int]]:
        """(smallest size, largest size, parts, slack) of each band; no parts where linked sets must be equal."""
        out, e = [], 1
        while e < self.largest:
            nxt = e * 100 // self.percent + 1
            d = 2 * (nxt - 1) * (100 - self.percent) // (100 + self.percent)
            s = max(1, int(np.ceil(self.slack * (d + 1)))) if d else 0
            out.append((e, nxt - 1, d + 1 + s if d else 0, s))
            e = nxt
        return out


_PLACE = shared.seeds(64, 3)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, by document and then hash."""
    place = _PLACE if k <= len(_PLACE) else shared.seeds(k, 3)
    at, length, doc = shared.words(data, off, shared.UNSPACED)
    h = shared.word_hashes(data, at, length)
    m, w = len(off) - 1, len(h)
    if not w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = np.bincount(doc, minlength=m)
    first = np.cumsum(n) - n
    full = w - k + 1
    g, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if full > 0:
        g = h[:full] * place[0]
        for j in range(1, k):
            g += h[j : j + full] * place[j]
        inside = doc[:full] == doc[k - 1 :]
        g, own = shared.mix(g[inside]), doc[:full][inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        size = n[short]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        part = h[np.repeat(first[short], size) + step] * place[step]
        one = shared.mix(np.add.reduceat(part, np.cumsum(size) - size) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        g, own = np.concatenate([g, one]), np.concatenate([own, short])
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    keep = np.append(True, (g[1:] != g[:-1]) | (own[1:] != own[:-1]))
    return own[keep], g[keep]


def _keys(own: np.ndarray, g: np.ndarray, n: np.ndarray, band: np.ndarray, parts: np.ndarray, shift: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the family ``band + shift`` of each document of ``n`` shingles: how many each has, and all of them. The last bit tells even families from odd ones."""
    fam = band + shift
    p = np.where(n > 0, parts[fam], 0)
    base = np.cumsum(p) - p
    value = np.zeros(int(p.sum()), np.uint64)
    live = p[own] > 0
    own, g = own[live], g[live]
    if len(g):
        cell = base[own] + ((g >> np.uint64(32)) * p[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        value[cell[first]] = np.bitwise_xor.reduceat(g, first)
    doc = np.repeat(np.arange(len(n)), p)
    part = np.arange(len(value)) - base[doc]
    tag = shared.mix((fam[doc].astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64) + np.uint64(1))
    return p, shared.mix(value + tag) >> np.uint64(65 - bits) << np.uint64(1) | (fam[doc] & 1).astype(np.uint64)


#: Rows of the packed table: keys of sets in blocks, sizes of rows, sets of frequent keys.
_BLOCK, _SIZES, _OFTEN = 0, 1, 2
_PACKED = "kind byte, range int, p0 binary, p1 binary, p2 binary, p3 binary, p4 binary, p5 binary"
#: Rows of what it is answered with: sizes of rows, shared keys of sets, keys of sets that wait for their count, those counts.
SIZE, MET, WAITING, COUNT = 0, 1, 2, 3
#: Keys and sets of one block; a set's place in its block has 14 bits.
_BLOCK_KEYS, _BLOCK_SETS = 1 << 20, 1 << 14


def _layout(docs: DataFrame, cfg: JaccardConfig) -> tuple[int, int]:
    """Ranges of keys and bits of a key, by the size of the table as the plan knows it (measured where it does not). They shape the work and the number of candidates, never the result."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a byte of text makes less than one key, so chance agreement of two keys stays under one in 2 ** 14
    return max(16, min(1 << 20, size // cfg.range_bytes)), max(40, min(63, size.bit_length() + 14))


def _packed(lists) -> pa.Array:
    return pa.array([x.tobytes() for x in lists], pa.binary())


def _block(key: np.ndarray, who: np.ndarray, name: np.ndarray, ranges: int, bits: int, hot: int):
    """Packed rows of sorted keys, of sets ``who`` (places in ``name``): by range first key, steps, places, sets, frequent keys and their counts; frequent keys with their sets apart."""
    n = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
    first = np.cumsum(n) - n
    often = n > hot
    hot_key, hot_n, warm = key[first[often]], n[often], np.repeat(~often, n)
    apart_key, apart_who, key, who = key[~warm], who[~warm], key[warm], who[warm]
    of = lambda k: (k >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)
    edges = np.arange(ranges + 1, dtype=np.uint64)
    cut, cut_hot = np.searchsorted(of(key), edges), np.searchsorted(of(hot_key), edges)
    live = np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_hot) > 0))
    for lo in range(0, len(live), 256):
        some, rows = live[lo : lo + 256], []
        for r in some.tolist():
            part = key[cut[r] : cut[r + 1]]
            step = np.diff(part, prepend=part[:1])
            own, place = np.unique(who[cut[r] : cut[r + 1]], return_inverse=True)
            wide = len(step) and int(step.max()) >= 1 << 32
            rows.append((part[:1], step if wide else step.astype(np.uint32), place.astype(np.uint16), name[own], hot_key[cut_hot[r] : cut_hot[r + 1]], hot_n[cut_hot[r] : cut_hot[r + 1]]))
        yield [_BLOCK, some, *map(_packed, zip(*rows, strict=True))]
    for lo in range(0, len(apart_key), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        # dealt by what they hold; only the spread matters
        yield [_OFTEN, np.array([int(apart_key[lo] + name[apart_who[lo]]) % ranges]), *map(_packed, [[apart_key[s]], [name[apart_who[s]]], *[[np.zeros(0)]] * 4])]


def _answers(t: pa.Table) -> pa.Table:
    """The answer to one range of keys, or the rows of other blocks as they are."""
    kind = t.column("kind")[0].as_py()
    col = [t.column(f"p{i}").combine_chunks() for i in range(6)]
    get = lambda c, dtype: [np.frombuffer(x.as_buffer(), dtype) for x in col[c]]
    if kind == _SIZES:
        unknown = np.concatenate(get(1, np.int64)) == 0
        out = [SIZE, pa.array(np.concatenate(get(0, np.int64)), mask=unknown), *(np.concatenate(get(i, np.int64)) for i in (2, 3, 4))]
        return _answer([out])
    if kind == _OFTEN:
        return _answer([[WAITING, np.concatenate(get(0, np.int64)), np.concatenate(get(1, np.int64))]])
    keys, names = [], []
    for start, step, place, name in zip(get(0, np.uint64), col[1], get(2, np.uint16), get(3, np.uint64), strict=True):
        if len(place):
            step = np.frombuffer(step.as_buffer(), np.uint64 if len(step.as_buffer()) == 8 * len(place) else np.uint32)
            keys.append(np.cumsum(step, dtype=np.uint64) + start)
            names.append(name[place])
    often, n_often = np.concatenate(get(4, np.uint64)), np.concatenate(get(5, np.int64))
    out = []
    hot, at = np.unique(often, return_inverse=True)
    total = np.bincount(at, n_often, len(hot)).astype(np.int64)
    if keys:
        key, name = np.concatenate(keys), np.concatenate(names)
        order = np.argsort(key)
        key, name = key[order], name[order]
        same = np.append(False, key[1:] == key[:-1])
        several = same | np.append(same[1:], False)
        if len(hot):
            several |= hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        key, name = key[several], name[several]
        # a set that several tasks gave counts once
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        once = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])) if len(key) else np.zeros(0, bool)
        key, name = key[once], name[once]
        own, back, n = np.unique(key, return_inverse=True, return_counts=True)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
            n = n + np.where(hot[place] == own, total[place], 0)
            extra = np.minimum(np.searchsorted(own, hot), max(0, len(own) - 1))
            total = np.where(own[extra] == hot, n[extra], total) if len(own) else total
        f = n[back]
        keep = f > 1
        out.append([MET, key[keep].view(np.int64), name[keep].view(np.int64), f[keep]])
    if len(hot):
        out.append([COUNT, hot.view(np.int64), None, total])
    return _answer(out)


def _answer(parts: list[list]) -> pa.Table:
    tables = []
    for kind, *cols in parts:
        n = len(cols[0])
        cols += [None] * (4 - len(cols))
        tables.append(pa.table([pa.array(np.full(n, kind, np.int8)), *(pa.nulls(n, pa.int64()) if c is None else c if isinstance(c, pa.Array) else pa.array(c) for c in cols)], ["kind", "a", "b", "c", "d"]))
    return pa.concat_tables(tables) if tables else pa.table({"kind": pa.array([], pa.int8()), **{c: pa.array([], pa.int64()) for c in "abcd"}})


def sketches(docs: DataFrame, cfg: JaccardConfig, id_col: str) -> DataFrame:
    """Rows (kind, a, b, c, d). SIZE: id, n, c1, c2 (a 128-bit hash of the set) of each row of ``docs``. MET: key, c1, number of sets with the key; WAITING: key, c1 of sets
    whose count is in COUNT: key, -, count. One pass over the texts, one shuffle of packed keys.

    A task packs the keys of its different sets in sorted blocks, one row a range of keys and about six bytes a key. Who gets a range sorts its keys and answers those that several
    sets have. A key of more than ``hot`` sets of a block is counted there and its sets travel as rows of their own, so what meets in a range grows with the number of tasks, not with a key.
    """
    bands = cfg.bands()
    low, parts = np.array([b[0] for b in bands]), np.array([b[2] for b in bands] + [0])
    ranges, bits = _layout(docs, cfg)

    def run(batches):
        shared.claim("jaccard")
        here = TaskContext.get().partitionId()
        seen: set[tuple[int, int]] = set()
        keys, who, names, sizes = [], [], [], []

        def rows(found):
            for kind, of, *cols in found:
                n = len(of)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(np.asarray(of, np.int32)), *cols], ["kind", "range", *(f"p{i}" for i in range(6))])

        def block():
            key, place = np.concatenate(keys), np.concatenate(who)
            if bits <= 50:  # place and key sort as one number
                key <<= np.uint64(14)
                key |= place
                key.sort()
                place = (key & np.uint64((1 << 14) - 1)).astype(np.uint16)
                key >>= np.uint64(14)
            else:
                order = np.argsort(key)
                key, place = key[order], place[order]
            yield from rows(_block(key, place, np.concatenate(names), ranges, bits, cfg.hot))

        def described():
            cols = [[x] for x in np.concatenate(sizes, axis=1)] + [[np.zeros(0)]]
            yield from rows([[_SIZES, [here % ranges], *map(_packed, cols)]])

        n_names = n_keys = n_sizes = 0
        for batch in batches:
            known = ~np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy()
            for lo, hi, data, off in shared.chunks(shared.utf8(batch, "text", lower=False)):
                own, g = shingle_sets(shared.ASCII_LOWER[data], off, cfg.shingle)
                n = np.bincount(own, minlength=hi - lo)
                c1, c2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                if len(g):
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    c1[own[first]] = np.add.reduceat(g, first)
                    c2[own[first]] = np.add.reduceat(shared.mix(g ^ np.uint64(0x5851F42D4C957F2D)), first)
                sizes.append(np.stack([ids[lo:hi], known[lo:hi].astype(np.int64), n, c1.view(np.int64), c2.view(np.int64)]))
                n_sizes += hi - lo
                new = []
                for i in np.flatnonzero((n > 0) & known[lo:hi]).tolist():
                    name = (int(c1[i]), int(c2[i]))
                    if name not in seen:
                        seen.add(name)
                        new.append(i)
                band = np.searchsorted(low, np.maximum(n, 1), "right") - 1
                for at in range(0, len(new), _BLOCK_SETS):
                    some = np.array(new[at : at + _BLOCK_SETS])
                    if n_keys and (n_names + len(some) > _BLOCK_SETS or n_keys > _BLOCK_KEYS):
                        yield from block()
                        keys, who, names, n_names, n_keys = [], [], [], 0, 0
                    place = np.full(hi - lo, -1)
                    place[some] = n_names + np.arange(len(some))
                    live = place[own] >= 0
                    for shift in (0, 1):
                        count, k = _keys(own[live], g[live], np.where(place >= 0, n, 0), band, parts, shift, bits)
                        keys.append(k)
                        who.append(np.repeat(np.maximum(place, 0), count).astype(np.uint16))
                        n_keys += len(k)
                    names.append(c1[some])
                    n_names += len(some)
            if n_sizes > 1 << 16:
                yield from described()
                sizes, n_sizes = [], 0
        if n_keys:
            yield from block()
        if n_sizes:
            yield from described()
        del keys, who, names, sizes, seen
        shared.release()

    packed = docs.select(F.col(id_col).cast("long").alias("id"), "text").mapInArrow(run, _PACKED)
    return packed.groupBy("kind", "range").applyInArrow(_answers, "kind byte, a long, b long, c long, d long")


def _sets(docs: DataFrame, cfg: JaccardConfig, id_col: str) -> DataFrame:
    """Per row: id and its sorted shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in shared.chunks(shared.utf8(batch, "text", lower=False)):
                own, g = shingle_sets(shared.ASCII_LOWER[data], off, cfg.shingle)
                cut = np.searchsorted(own, np.arange(hi - lo + 1))
                sets = pa.array([g[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], sets], ["id", "set"])

    return docs.select(F.col(id_col).cast("long").alias("id"), "text").mapInArrow(run, "id long, set binary")


def _enough(both, x, y, percent: int):
    """The limit on an intersection of sets of sizes x and y, in integers."""
    return (both > 0) & (100 * both >= percent * (x + y - both))


def _verified(pairs: DataFrame, sets: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Those of ``pairs`` (a, b) that reach the limit, by exact intersections of whole sets."""
    percent = cfg.percent

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if len(x):
                    at = np.searchsorted(y, x)
                    ok[i] = _enough(int((y[np.minimum(at, len(y) - 1)] == x).sum()), len(x), len(y), percent)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    first = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = first.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of incidence matrices over the members that both lists have, a slice at a time."""
    l_of, r_of = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    l_all, r_all = np.concatenate(left), np.concatenate(right)
    names = np.intersect1d(l_all, r_all)
    total = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(names), columns):
        part = names[lo : lo + columns]
        sides = []
        for of, every, n in ((l_of, l_all, len(left)), (r_of, r_all, len(right))):
            at = np.minimum(np.searchsorted(part, every), len(part) - 1)
            hit = part[at] == every
            m = np.zeros((n, len(part)), np.float32)
            m[of[hit], at[hit]] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total.astype(np.int64)


def _across(groups: DataFrame, sets: DataFrame, cfg: JaccardConfig, tmp: shared.Scratch) -> DataFrame:
    """Links (a, b) between documents of one group (lead, id, root) that lie in different components.

    A group is dealt in chunks of about ``chunk`` documents by a hash; a task judges two chunks, all pairs by matrix products, and gives only a spanning forest of the links
    it found. No pair is a row, and no task grows with a group.
    """
    percent = cfg.percent
    size = groups.groupBy("lead").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    # written, so the plan knows its size: a small one is sent to the groups where they lie, a large one meets them in a merge join, whose hot groups AQE splits
    size = tmp.write(size.select("lead", F.ceil(F.col("n") / cfg.chunk).cast("int").alias("k")))
    dealt = groups.join(size, "lead").withColumn("i", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    dealt = dealt.join(sets, "id").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = dealt.select("lead", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "id", "root", "set")

    def judge(t: pa.Table) -> pa.Table:
        i, ids, root = t.column("i").to_numpy(), t.column("id").to_numpy(), t.column("root").to_numpy()
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        n = np.array([len(x) for x in sets])
        a, b = np.flatnonzero(i == p), np.flatnonzero(i == q)
        out = []
        if len(a) and len(b) and len(np.unique(root)) > 1:
            both = shared_counts([sets[x] for x in a], [sets[x] for x in b])
            hit = _enough(both, n[a][:, None], n[b][None], percent) & (root[a][:, None] != root[b][None])
            up = {int(r): int(r) for r in root}
            for x, y in np.argwhere(hit).tolist():
                u, v = int(root[a[x]]), int(root[b[y]])
                while up[u] != u:
                    u = up[u]
                while up[v] != v:
                    v = up[v]
                if u != v:
                    up[max(u, v)] = min(u, v)
                    out.append((int(ids[a[x]]), int(ids[b[y]])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return cells.groupBy("lead", "p", "q").applyInArrow(judge, "a long, b long")


def near_duplicates(docs: DataFrame, cfg: JaccardConfig = JaccardConfig(), id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    docs = docs.select(id_col, "text")
    tmp = shared.Scratch(spark, "jaccard")
    told = tmp.write(sketches(docs, cfg, id_col))
    tmp.drop()
    sizes = tmp.write(told.filter(F.col("kind") == SIZE).select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("c").alias("c1"), F.col("d").alias("c2")))
    # Documents with equal sets are one node, named by their smallest id. The aggregate is done before the shuffle, so a hot set is one row a task.
    named = sizes.filter("n > 0 and id is not null")
    node = tmp.write(named.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.max("n").alias("n")))
    # The other side of this join is as skewed as the copies are; a row has 32 bytes and AQE splits what is hot.
    member = tmp.write(named.select("id", "c1", "c2").join(node.select("c1", "c2", "rep"), ["c1", "c2"]).select("id", "rep"))
    # the sets of keys that are frequent within a task get the count of all tasks; a merge join, whose hot keys AQE splits
    met = told.filter(F.col("kind") == MET).select(F.col("a").alias("key"), F.col("b").alias("c1"), F.col("c").alias("f"))
    waiting = told.filter(F.col("kind") == WAITING).select(F.col("a").alias("key"), F.col("b").alias("c1"))
    count = told.filter(F.col("kind") == COUNT).select(F.col("a").alias("key"), F.col("c").alias("f"))
    met = met.unionByName(waiting.join(count, "key").distinct().select("key", "c1", "f"))
    # leave out the s most frequent keys that a set shows in a family; a set has few, so the window is small whatever the table, and it needs no exchange but the join's
    bands = cfg.bands()
    edges, slack = F.array(*[F.lit(int(b[0])).cast("long") for b in bands]), F.array(*[F.lit(int(b[3])) for b in bands], F.lit(0))
    band = F.size(F.filter(edges, lambda e: e <= F.col("n")))  # 1-based place of the own band
    family = F.when(F.pmod(band - 1, F.lit(2)) == F.col("key").bitwiseAND(F.lit(1)), band).otherwise(band + 1)
    placed = met.join(node.select("c1", "c2", "rep", "n"), "c1").withColumn("family", family)
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("c1", "c2", "family").orderBy(F.desc("f"), "key")))
    left = tmp.write(ranked.filter(F.col("rank") > F.element_at(slack, F.col("family"))).select("key", "rep"))
    tmp.drop(told)

    lead = left.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("c")).filter("c > 1").select("key", "a")
    tried = tmp.write(left.join(lead, "key").filter("rep != a").select("a", F.col("rep").alias("b")).distinct())
    tmp.drop(left, node)
    # One pass over the texts of documents in a pair; by merge at every size, so that what is moved follows the input.
    ids = tried.select(F.explode(F.array("a", "b")).alias("_id")).distinct().hint("merge")
    sets = tmp.write(_sets(docs.join(ids, F.col(id_col).cast("long") == F.col("_id"), "left_semi"), cfg, id_col))
    links = tmp.write(_verified(tried, sets, cfg))
    roots = tmp.write(shared.components(links, tmp))

    # Two documents of a key have its first document in common. So every candidate pair lies in the group of some first document: judge those groups that still are in several components.
    groups = tried.select(F.col("a").alias("lead"), F.col("b").alias("id")).unionByName(tried.select(F.col("a").alias("lead"), F.col("a").alias("id")).distinct())
    groups = tmp.write(groups.join(roots, groups["id"] == roots["node"], "left").select("lead", "id", F.coalesce("root", "id").alias("root")))
    more = tmp.write(_across(groups, sets, cfg, tmp))
    tmp.drop(sets, groups, tried, roots)
    roots = tmp.write(shared.components(links.unionByName(more), tmp))
    tmp.drop(links, more)
    near = roots.withColumnRenamed("node", "rep")
    placed = member.join(near, "rep", "left").groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = sizes.select("id", "n").join(placed, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, cfg: JaccardConfig = JaccardConfig(), id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id (null last). Rows are told apart by (id, text), so rows that share an id but are no near-duplicates all stay,
    and rows without an id take part; of rows equal in both one stays. Texts without words are linked with nothing and all stay, each (id, text) once."""
    tmp = shared.Scratch(docs.sparkSession, "one-of-each")
    row = F.xxhash64(F.col(id_col), F.col("text"))
    places = tmp.write(near_duplicates(docs.select(row.alias("_row"), "text"), cfg, "_row").select("_row", "component_id").distinct())
    name = docs.select(row.alias("_row"), F.col(id_col).alias("_id"))
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row")))
    keep = name.join(places, "_row").groupBy("component_id").agg(first.alias("k")).select(F.col("k._row").alias("_keep"))
    keep = tmp.write(keep)
    name, rank = shared.unused(docs, "_row"), shared.unused(docs, "_rank")
    stay = docs.withColumn(name, row).join(keep.select(F.col("_keep").alias(name)), name, "left_semi")
    once = stay.withColumn(rank, F.row_number().over(Window.partitionBy(name).orderBy(F.xxhash64(*docs.columns)))).filter(F.col(rank) == 1)
    return once.select(*docs.columns)


def sql(cfg: JaccardConfig) -> str:
    """Sizes and classes in DuckDB's SQL, by counting the shingles that documents share."""
    k = cfg.shingle
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {k} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[p : p + {k - 1}], ' ') END AS s FROM w, unnest(range(1, greatest(len(ws) - {k}, 0) + 2)) u(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {cfg.percent} * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(documents.doc_id, coalesce(m, documents.doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON a = documents.doc_id"""
