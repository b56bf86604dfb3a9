"""Embedding near-dedup by sorted projection passes.

A pass projects the vectors of a label, less their mean, on random directions, writes the signs as one key of 64 bits, and sorts all labels' vectors by it. Each vector is compared
with the ``window`` before it and some more, on codes of 16 bits a component whose error has a bound: pairs above the limit by more than that are links, pairs within it are
verified on the vectors themselves, in double precision. Links of all passes are united into components. A window gives a spanning forest of its links only, so a dense group costs an
edge a row. Sorting moves keys and codes, never vectors.

How many passes a label gets is measured and not supposed. In the first ones each vector is held against the one ``window`` places on: after as many bits as those two share, the vector is
alone with its window, so a pair at the limit meets if it shares one bit more. The mean chance of that over a label's vectors gives the passes after which a pair at the limit has met
with probability ``recall``. Two vectors at the limit share a bit with probability 1 - t / pi, t being their angle seen from the label's mean, so a label whose vectors lie close
together gets more passes (``most_passes`` at most).

Direct links are then counted inside each component, for every pair and not only for those that met: members within half the limit angle of the
component's mean direction are all linked to each other (triangle inequality), so they are counted, not compared; the rest is compared with
the whole component in blocks of ``block`` by ``block``, spread over tasks, and only counts leave a task.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, a null label and a null id link with nothing: n_links 0, own component. Labels are of any
type and compare by their value. Vectors of different length never link. Each row is a vector of its own, so rows that share an id each count their own links, also those among them;
their component is the smallest id that the row reaches. Ids are integers (others are cast to long; what does not parse is an error). Pairs at the limit exactly are linked. Empty
table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm import shared


@dataclass(frozen=True)
class EmbedConfig:
    cosine: float = 0.93
    window: int = 256
    recall: float = 0.9999
    passes_per_job: int = 4
    most_passes: int = 512
    block: int = 512
    seed: int = 5


_BITS, _SCALE = 64, 32767


def label_text(label: Column, kind: T.DataType) -> Column:
    """A label as text, equal for equal labels only."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) or kind.typeName() == "variant":
        return F.when(label.isNotNull(), F.to_json(F.struct(label)))
    if isinstance(kind, T.BinaryType):
        return F.hex(label)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        label = label + F.lit(0.0).cast(kind)  # one zero
    return label.cast("string")


def units(raw: pa.Array, kind) -> np.ndarray:
    """Vectors of one length as rows of norm 1, in double precision."""
    x = np.stack([np.frombuffer(v.as_buffer(), kind) for v in raw]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares stay in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(vectors: DataFrame, cfg: EmbedConfig, id_col: str, vec_col: str, label_col: str, kind) -> DataFrame:
    """Every row with a number: row, id, label, dim, vec (components as bytes; null where the row links with nothing)."""

    def run(batches):
        shared.claim("embed")
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            col = batch.column(2)
            size = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
            flat = col.flatten()  # components of the lists that are not null, end to end
            x = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), kind)
            end = np.cumsum(size)
            upto = lambda m: np.concatenate([[0], np.cumsum(m)])
            bad, some = upto(~np.isfinite(x) | np.asarray(flat.is_null())), upto(x != 0)
            ok = (bad[end] == bad[end - size]) & (some[end] > some[end - size])
            ok &= ~np.asarray(batch.column(0).is_null()) & ~np.asarray(batch.column(1).is_null())
            data, step = x.tobytes(), x.itemsize
            vec = [data[(e - s) * step : e * step] if k else None for e, s, k in zip(end.tolist(), size.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), pa.array(vec, pa.binary())], ["row", "id", "label", "dim", "vec"])
            row += n

    picked = vectors.select(F.col(id_col).cast("long").alias("id"), label_text(F.col(label_col), vectors.schema[label_col].dataType).alias("label"), F.col(vec_col).alias("vec"))
    return picked.mapInArrow(run, "row long, id long, label string, dim int, vec binary")


def _means(unit: DataFrame, cfg: EmbedConfig, kind) -> DataFrame:
    """Per label and length with more vectors than a window has: n, mean (as bytes)."""
    schema = "label string, dim int, n long, mean binary"

    def add(total: dict, label, dim, n, x) -> None:
        had = total.get((label, dim))
        total[label, dim] = (n, x) if had is None else (had[0] + n, had[1] + x)

    def rows(total: dict):
        keys = list(total)
        return [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array([total[k][1].tobytes() for k in keys], pa.binary())]

    def part(batches):
        total: dict = {}
        for batch in batches:
            code = batch.column(0).dictionary_encode()
            pair = np.stack([code.indices.to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int64)])
            for c, dim in np.unique(pair, axis=1).T.tolist():
                at = np.flatnonzero((pair[0] == c) & (pair[1] == dim))
                add(total, code.dictionary[c].as_py(), dim, len(at), units(batch.column(2).take(pa.array(at)), kind).sum(0))
            if len(total) > 4096:
                yield pa.RecordBatch.from_arrays(rows(total), ["label", "dim", "n", "mean"])
                total = {}
        yield pa.RecordBatch.from_arrays(rows(total), ["label", "dim", "n", "mean"])

    def whole(t: pa.Table) -> pa.Table:
        total: dict = {}
        for label, dim, n, x in zip(*(t.column(c).to_pylist() for c in ("label", "dim", "n", "mean")), strict=True):
            add(total, label, dim, n, np.frombuffer(x))
        total = {k: (n, x / n) for k, (n, x) in total.items() if n > cfg.window}
        return pa.table(rows(total), ["label", "dim", "n", "mean"])

    few = unit.groupBy("label", "dim").count().filter(F.col("count") > cfg.window).select("label", "dim")
    return unit.join(few, ["label", "dim"], "left_semi").select("label", "dim", "vec").mapInArrow(part, schema).groupBy("label", "dim").applyInArrow(whole, schema)


def _share(mean_norm2: float, cfg: EmbedConfig) -> float:
    """Probability that a random plane through a label's mean does not part two vectors at the limit."""
    spread = math.sqrt(max(1e-12, 1 - mean_norm2))
    return 1 - 2 * math.asin(min(1.0, math.sqrt((1 - cfg.cosine) / 2) / spread)) / math.pi


def _keyed(unit: DataFrame, plan: DataFrame, cfg: EmbedConfig, first: int, last: int, kind) -> DataFrame:
    """Rows (pass, label, dim, key, row, code) for passes first..last: signs of 64 projections as one number, and the vector in 16 bits a component."""
    joined = unit.join(plan.select("label", "dim", "mean", "need"), ["label", "dim"], "left")
    joined = joined.withColumn("need", F.coalesce("need", F.lit(1))).filter(F.col("need") > first)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = np.uint64(1) << np.arange(_BITS, dtype=np.uint64)[::-1]
        for batch in batches:
            dims, need = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.concatenate([np.random.default_rng([cfg.seed, dim, p]).normal(size=(dim, _BITS)) for p in range(first, last)], axis=1)
                part = batch.take(pa.array(at))
                x = units(part.column(3), kind)
                code = np.round(x * _SCALE).astype(np.int16)
                listed = pa.array([c.tobytes() for c in code], pa.binary())
                names = part.column(1).dictionary_encode()
                mean = part.column(4)
                of = names.indices.to_numpy()
                for c in np.unique(of).tolist():  # one mean a label
                    own = np.flatnonzero(of == c)
                    m = mean[int(own[0])]
                    if m.is_valid:
                        x[own] -= np.frombuffer(m.as_buffer())
                side = (x @ planes[dim]) > 0
                for p in range(first, last):
                    asked = np.flatnonzero(need[at] > p)
                    if len(asked):
                        key = (side[asked, _BITS * (p - first) : _BITS * (p - first + 1)] * weights).sum(1, dtype=np.uint64).view(np.int64)
                        take = pa.array(asked)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), p, np.int32)), part.column(1).take(take), pa.array(np.full(len(asked), dim, np.int32)), pa.array(key), part.column(0).take(take), listed.take(take)], ["pass", "label", "dim", "key", "row", "code"])

    return joined.select("row", "label", "dim", "vec", "mean", "need").mapInArrow(run, "pass int, label string, dim int, key long, row long, code binary")


def forest(hit: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the groups which ``hit`` (symmetric) connects, one fewer than groups joined; ``group`` is updated in place. Each round every group takes one link out of it."""
    out = []
    while True:
        cross = hit & (group[:, None] != group[None])
        rows = np.flatnonzero(cross.any(1))
        if not len(rows):
            return out
        to = cross[rows].argmax(1)
        _, one = np.unique(group[rows], return_index=True)
        for a, b in zip(rows[one].tolist(), to[one].tolist(), strict=True):
            x, y = group[a], group[b]
            if x != y:
                group[group == max(x, y)] = min(x, y)
                out.append((a, b))


class _Window:
    """Compares rows in the order of a pass with those shortly before them."""

    def __init__(self, cfg: EmbedConfig, dim: int):
        self.limit, self.window, self.dim = cfg.cosine, cfg.window, dim
        # rounding of two codes of norm about 1, and of the product in single precision
        self.slack = 2 * math.sqrt(dim) * 0.51 / _SCALE + dim * 2e-7
        self.x, self.row, self.group = np.zeros((0, dim), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def feed(self, row: np.ndarray, x: np.ndarray, out: list[tuple[int, int, bool]]) -> None:
        for lo in range(0, len(row), self.window):
            n = len(self.row)
            rows, both = np.concatenate([self.row, row[lo : lo + self.window]]), np.concatenate([self.x, x[lo : lo + self.window]])
            group = np.concatenate([self.group, np.arange(len(rows) - n) + (int(self.group.max()) + 1 if n else 0)])
            s = both[n:] @ both.T
            for floor, sure in ((self.limit + self.slack, True), (self.limit - self.slack, False)):
                hit = np.zeros((len(rows), len(rows)), bool)
                hit[n:] = s >= floor
                hit[:n, n:] = hit[n:, :n].T
                np.fill_diagonal(hit, False)
                if sure:
                    out += [(int(rows[a]), int(rows[b]), True) for a, b in forest(hit, group)]
                else:  # every doubtful pair between groups is looked at again
                    a, b = np.nonzero(np.triu(hit & (group[:, None] != group[None]), 1))
                    out += [(int(rows[i]), int(rows[j]), False) for i, j in zip(a, b, strict=True)]
            keep = max(0, len(rows) - self.window)
            self.x, self.row, self.group = both[keep:], rows[keep:], group[keep:]


def _decoded(code: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.int16) for v in code]).astype(np.float32) / np.float32(_SCALE)


def _runs(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Borders of the runs of equal (pass, label, dim)."""
    cols = [table.column("pass").to_numpy(), table.column("label").dictionary_encode().indices.to_numpy() if isinstance(table, pa.RecordBatch) else table.column("label").combine_chunks().dictionary_encode().indices.to_numpy(), table.column("dim").to_numpy()]
    change = np.zeros(max(0, len(cols[0]) - 1), bool)
    for c in cols:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(cols[0])]])


_FOUND = "kind byte, a long, b long, pass int, label string, dim int, row long, code binary, meet double"
#: Rows of a pass: links, doubtful pairs, rows at the border of a task (a: place from the first or b: from the last), rows of a task, chances to meet.
LINK, DOUBT, BORDER, SIZE, CHANCE = range(5)


def _passes(keyed: DataFrame, plan: DataFrame, cfg: EmbedConfig, tmp: shared.Scratch, chances: bool) -> DataFrame:
    """Links and doubtful pairs (kind, a, b) between rows that are near in the order of a pass, and the chances to meet.

    Tasks hold ranges of the order of all passes. What lies within a window of a task's ends is written too and compared across the borders by a second, small job, so no
    window ends at the border of a task, and all tasks are alike however skewed labels or keys are.
    """
    order = ["pass", "label", "dim", "key", "row"]
    w = cfg.window

    def emit(kind: int, n: int, **cols) -> pa.RecordBatch:
        types = {"a": pa.int64(), "b": pa.int64(), "pass": pa.int32(), "label": pa.string(), "dim": pa.int32(), "row": pa.int64(), "code": pa.binary(), "meet": pa.float64()}
        made = [cols[c].cast(t) if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in types.items()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *made], ["kind", *types])

    def links(out):
        for kind, sure in ((LINK, True), (DOUBT, False)):
            some = [(a, b) for a, b, s in out if s == sure]
            if some:
                yield emit(kind, len(some), a=[a for a, _ in some], b=[b for _, b in some])

    def run(batches):
        shared.claim("embed")
        part = TaskContext.get().partitionId()
        here, name, total, tail = None, None, 0, None
        keys: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            batch = batch.combine_chunks() if hasattr(batch, "combine_chunks") else batch
            n = batch.num_rows
            cut = _runs(batch)
            x, row = None, batch.column(4).to_numpy()
            out: list[tuple[int, int, bool]] = []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi == lo:
                    continue
                own = (batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py(), batch.column(2)[lo].as_py())
                if own != name:
                    here, name = _Window(cfg, own[2]), own
                x = _decoded(batch.column(5)[lo:hi])
                here.feed(row[lo:hi], x, out)
                if chances:
                    keys.setdefault(own, []).append(batch.column(3)[lo:hi].to_numpy())
            yield from links(out)
            if total < w and n:
                k = min(n, w - total)
                yield emit(BORDER, k, a=np.full(k, part), b=np.arange(total, total + k), **{c: batch.column(i)[:k] for i, c in ((0, "pass"), (1, "label"), (2, "dim"), (4, "row"), (5, "code"))})
            keep = pa.Table.from_batches([batch])
            tail = keep if tail is None else pa.concat_tables([tail, keep])
            tail = tail.slice(max(0, tail.num_rows - w)).combine_chunks()
            total += n
            if chances:
                done = [k for k in keys if k != name]
                for k in done:
                    yield from met(k, keys.pop(k))
                if name in keys and sum(map(len, keys[name])) > 1 << 20:
                    yield from met(name, [np.concatenate(keys[name])])
                    keys[name] = []
        if total:
            first = max(w, total - tail.num_rows)  # rows before that are written already
            last = tail.slice(tail.num_rows - (total - first)) if total > first else tail.slice(tail.num_rows)
            for b in last.to_batches():
                n = b.num_rows
                yield emit(BORDER, n, a=np.full(n, part), b=np.arange(first, first + n), **{c: b.column(c) for c in ("pass", "label", "dim", "row", "code")})
                first += n
            yield emit(SIZE, 1, a=[part], b=[total])
        for k, some in keys.items():
            yield from met(k, some)

    def met(own, some):
        """Histogram of the bits after which a row is alone with its window: (b: bits, meet: rows)."""
        key = np.concatenate(some).view(np.uint64) if some else np.zeros(0, np.uint64)
        if len(key) > w:
            apart = key[w:] ^ key[:-w]
            bits = np.where(apart > 0, 63 - np.floor(np.log2(np.maximum(apart, 1).astype(np.float64))), 64).clip(0, 64).astype(np.int64)
            n = np.bincount(bits, minlength=65)
            at = np.flatnonzero(n)
            yield emit(CHANCE, len(at), label=[own[1]] * len(at), dim=[own[2]] * len(at), b=at, meet=n[at].astype(float))

    found = tmp.write(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _FOUND))
    # one number a task of the sort comes to the driver
    sizes = sorted((r.a, r.b) for r in found.filter(F.col("kind") == SIZE).select("a", "b").collect())
    start, at = {}, 0
    for p, n in sizes:
        start[p], at = at, at + n
    edges = np.array(sorted(start.values())[1:], np.int64)

    def cells(batches):
        for batch in batches:
            place = np.array([start[p] for p in batch.column(0).to_pylist()], np.int64) + batch.column(1).to_numpy()
            lo, hi = np.searchsorted(edges, place - w, "right"), np.searchsorted(edges, place + w, "right")
            of = np.repeat(np.arange(len(place)), hi - lo)
            cell = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)]) if len(of) else of
            part = batch.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(place[of]), *(part.column(i) for i in range(2, 7))], ["cell", "place", "pass", "label", "dim", "row", "code"])

    def across(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        out: list[tuple[int, int, bool]] = []
        cut = _runs(t)
        row, code = t.column("row").to_numpy(), t.column("code").combine_chunks()
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi > lo + 1:
                _Window(cfg, t.column("dim")[lo].as_py()).feed(row[lo:hi], _decoded(code[lo:hi]), out)
        return pa.table({"kind": pa.array([LINK if s else DOUBT for _, _, s in out], pa.int8()), "a": pa.array([a for a, _, _ in out], pa.int64()), "b": pa.array([b for _, b, _ in out], pa.int64())})

    both = found.filter(F.col("kind").isin(LINK, DOUBT, CHANCE)).select("kind", "a", "b", "label", "dim", "meet")
    if len(edges):
        border = found.filter(F.col("kind") == BORDER).select("a", "b", "pass", "label", "dim", "row", "code").mapInArrow(cells, "cell long, place long, pass int, label string, dim int, row long, code binary")
        both = both.unionByName(border.groupBy("cell").applyInArrow(across, "kind byte, a long, b long"), allowMissingColumns=True)
    out = tmp.write(both)
    tmp.drop(found)
    return out


def _needed(plan: DataFrame, told: DataFrame, cfg: EmbedConfig) -> DataFrame:
    """``plan`` with the passes that each label needs, by what the first passes measured."""

    def need(batches):
        for batch in batches:
            out = []
            for mean, bits, rows in zip(batch.column(3), batch.column(4), batch.column(5), strict=True):
                m = np.frombuffer(mean.as_buffer())
                p = _share(float(m @ m), cfg)
                b, n = np.asarray(bits.values, float) if bits.is_valid else np.zeros(0), np.asarray(rows.values, float) if rows.is_valid else np.zeros(0)
                meet = float((n * p ** (b + 1)).sum() / n.sum()) if len(n) and n.sum() else 1.0
                meet = min(max(meet, 1e-9), 1 - 1e-9)
                out.append(min(cfg.most_passes, max(3, math.ceil(math.log(1 - cfg.recall) / math.log(1 - meet)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, pa.int32())], ["label", "dim", "n", "mean", "need"])

    bits = told.filter(F.col("kind") == CHANCE).groupBy("label", "dim", "b").agg(F.sum("meet").alias("rows"))
    bits = bits.groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.struct("b", "rows"))).alias("x"))  # at most 65 a label
    both = plan.join(bits, ["label", "dim"], "left").select("label", "dim", "n", "mean", F.col("x.b").alias("bits"), F.col("x.rows").alias("rows"))
    return both.mapInArrow(need, "label string, dim int, n long, mean binary, need int")


def _verified(pairs: DataFrame, unit: DataFrame, cfg: EmbedConfig, kind) -> DataFrame:
    """Those of the doubtful pairs that reach the limit, on whole vectors."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = units(pa.array([x.as_py(), y.as_py()], pa.binary()), kind)
                ok[i] = float(x @ y) >= cfg.cosine
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    side = lambda c: unit.select(F.col("row").alias(c), F.col("vec").alias(f"v{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _counts(unit: DataFrame, roots: DataFrame, cfg: EmbedConfig, tmp: shared.Scratch, kind) -> DataFrame:
    """(row, n_links) of every row in a component: all pairs of the component are judged, few of them compared."""
    placed = tmp.write(unit.join(roots, unit["row"] == roots["node"]).select("row", "root", "vec"))
    half = math.cos(math.acos(cfg.cosine) / 2) + 1e-12

    def sums(batches):
        # one partial sum a component and batch, so a hot component crosses the network as few rows
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.array([len(v.as_buffer()) for v in batch.column(2)])
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                names, inv = np.unique(batch.column(1).to_numpy()[at], return_inverse=True)
                x = units(batch.column(2).take(pa.array(at)), kind)
                total = np.zeros((len(names), x.shape[1]))
                np.add.at(total, inv, x)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(inv, minlength=len(names))), pa.array([t.tobytes() for t in total], pa.binary())], ["root", "size", "mean"])

    def whole(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer()) for x in t.column("mean")], axis=0)
        return pa.table({"root": t.column("root")[:1], "size": pa.array([int(np.sum(t.column("size").to_numpy()))], pa.int64()), "mean": pa.array([total.tobytes()], pa.binary())})

    # written, so that the plan knows the size of what is joined to a hot component's rows
    mean = tmp.write(placed.select("row", "root", "vec").mapInArrow(sums, "root long, size long, mean binary").groupBy("root").applyInArrow(whole, "root long, size long, mean binary"))

    def inner(batches):
        for batch in batches:
            ok = []
            for v, m in zip(batch.column(2), batch.column(4), strict=True):
                m = np.frombuffer(m.as_buffer())
                n = math.sqrt(float(m @ m))
                x = np.frombuffer(v.as_buffer(), kind).astype(np.float64)
                x = x / np.abs(x).max()
                ok.append(bool(n > 0 and float(x @ m) / n / math.sqrt(float(x @ x)) >= half))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(ok)], ["row", "root", "vec", "size", "inner"])

    judged = tmp.write(placed.join(mean, "root").select("row", "root", "vec", "size", "mean").mapInArrow(inner, "row long, root long, vec binary, size long, inner boolean"))
    tmp.drop(placed, mean)
    tally = tmp.write(judged.groupBy("root").agg(F.count_if("inner").alias("n_in"), F.max("size").alias("size")))
    base = judged.join(tally.select("root", "n_in"), "root").select("row", F.when(F.col("inner"), F.col("n_in") - 1).otherwise(0).alias("n"))
    mixed = tmp.write(tally.filter("n_in < size").select("root"))
    rest = judged.join(mixed, "root", "left_semi")
    # blocks of a component; a task holds two of them. Pairs inside the inner part are known already.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / cfg.block)).cast("int")
    rest = rest.withColumn("k", blocks).withColumn("i", F.pmod(F.xxhash64("row"), F.col("k")).cast("int"))
    rest = rest.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = rest.select("root", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "row", "inner", "vec")

    def compare(table: pa.Table) -> pa.Table:
        i, row, inn = table.column("i").to_numpy(), table.column("row").to_numpy(), table.column("inner").to_numpy()
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        x = units(table.column("vec"), kind)
        left, right = np.flatnonzero(i == p), np.flatnonzero(i == q)
        hit = (x[left] @ x[right].T >= cfg.cosine) & ~(inn[left][:, None] & inn[right][None])
        if p == q:
            np.fill_diagonal(hit, False)
            return pa.table({"row": pa.array(row[left]), "n": pa.array(hit.sum(1).astype(np.int64))})
        return pa.table({"row": pa.array(np.concatenate([row[left], row[right]])), "n": pa.array(np.concatenate([hit.sum(1), hit.sum(0)]).astype(np.int64))})

    more = cells.groupBy("root", "p", "q").applyInArrow(compare, "row long, n long")
    return base.unionByName(more).groupBy("row").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, cfg: EmbedConfig = EmbedConfig(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row of ``vectors``: id, n_links (rows linked directly), component_id (smallest id reachable by links), kept (id = component_id)."""
    spark = vectors.sparkSession
    tmp = shared.Scratch(spark, "embed")
    kind = np.float32 if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else np.float64
    rows = tmp.write(_rows(vectors, cfg, id_col, vec_col, label_col, kind))
    unit = rows.filter("vec is not null").select("row", "label", "dim", "vec")
    plan = tmp.write(_means(unit, cfg, kind))
    first_plan = plan.withColumn("need", F.lit(cfg.passes_per_job))
    told = _passes(_keyed(unit, first_plan, cfg, 0, cfg.passes_per_job, kind), first_plan, cfg, tmp, chances=True)
    plan = tmp.write(_needed(plan, told, cfg))
    found = [told]
    most = plan.agg(F.max("need")).first()[0] or 0
    at = cfg.passes_per_job
    while at < most:
        upto = min(most, at + cfg.passes_per_job)
        found.append(_passes(_keyed(unit.join(plan.filter(F.col("need") > at).select("label", "dim"), ["label", "dim"], "left_semi"), plan, cfg, at, upto, kind), plan, cfg, tmp, chances=False))
        at = upto
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    doubtful = every.filter(F.col("kind") == DOUBT).select("a", "b").distinct()
    links = tmp.write(every.filter(F.col("kind") == LINK).select("a", "b").unionByName(_verified(doubtful, unit, cfg, kind)))
    tmp.drop(*found)
    roots = tmp.write(shared.components(links, tmp))
    counts = tmp.write(_counts(unit, roots, cfg, tmp, kind))
    ids = rows.select("row", "id")
    # components are of rows; each is named by the smallest id in it
    named = roots.join(ids, roots["node"] == ids["row"]).groupBy("root").agg(F.min("id").alias("component"))
    per = roots.join(counts, roots["node"] == counts["row"]).select("node", "root", "n_links").join(named, "root")
    out = ids.join(per, F.col("row") == F.col("node"), "left")
    root = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), root.alias("component_id"), (F.col("id") == root).alias("kept"))


def sql(cfg: EmbedConfig = EmbedConfig()) -> str:
    """Links, classes and counts in DuckDB's SQL, by comparing all vectors of a label."""
    return f"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM r WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {cfg.cosine}),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(vec_id) AS m FROM reach JOIN r ON r.k = b GROUP BY a)
SELECT r.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(low.m, r.vec_id) AS component_id, r.vec_id = coalesce(low.m, r.vec_id) AS kept
FROM r LEFT JOIN n ON n.a = r.k LEFT JOIN low ON low.a = r.k"""
