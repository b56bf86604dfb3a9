"""Multisets of character bigrams: packed profiles of texts, and all pairs of a block of profiles at a Sorensen-Dice threshold.

A profile is the sorted codes of a text's different bigrams with their counts, a tenth to a half of the text. Two multisets share the sum of the smaller counts. A tile of texts is a
matrix of zeros and ones with a column for the first, second, ... occurrence of each bigram, so one matrix product gives that sum for all pairs of two tiles, exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White_Space of Unicode, as the engine's own pattern has it; one more place for all characters beyond.
_SPACES = np.zeros(0x3002, bool)
_SPACES[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
#: Texts in a tile at most, and cells of its matrix unless one text has more.
TILE, CELLS = 256, 1 << 23
#: Pairs handed on at once, about.
EMIT = 50_000


def pack(text: bytes) -> tuple[int, bytes]:
    """How many bigrams a text (UTF-8) has without its white space, and its profile."""
    chars = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = chars[~_SPACES[np.minimum(chars, 0x3001)]].astype(np.int64)
    if len(chars) < 2:
        return 0, b""
    codes, counts = np.unique(chars[:-1] << 21 | chars[1:], return_counts=True)
    both = np.concatenate([np.diff(codes, prepend=0), counts.astype(np.int64)])
    return len(chars) - 1, zlib.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)  # bytes of one weight side by side: most are zeros


def unpack(profile: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(profile), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


class _Side:
    """Texts in the order of their lengths, with the entries (bigram, count) of each."""

    def __init__(self, rows: pa.Table, n: np.ndarray, order: np.ndarray):
        self.n, self.paths = n[order], rows.column("path").take(pa.array(order)).combine_chunks()
        found = [unpack(x.as_buffer()) for x in rows.column("profile").take(pa.array(order))]
        self.ids = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
        self.counts = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])

    def keep(self, ids: np.ndarray, kept: np.ndarray) -> None:
        self.ids, self.counts, self.row = ids[kept], self.counts[kept], self.row[kept]
        self.off = np.searchsorted(self.row, np.arange(len(self.n) + 1))

    def tile(self, lo: int, hi: int, place: np.ndarray, cap: np.ndarray, width: int, kind: type) -> np.ndarray:
        e = slice(self.off[lo], self.off[hi])
        c = np.minimum(self.counts[e], cap[self.ids[e]])
        begin = (self.row[e] - lo) * width + place[self.ids[e]] - (np.cumsum(c) - c)
        out = np.zeros((hi - lo, width), kind)
        out.reshape(-1)[np.repeat(begin, c) + np.arange(int(c.sum()))] = 1
        return out


def pairs_of(rows: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """path_a, path_b, similarity of the pairs at the threshold: of all rows if their side is 2, else of one row of side 0 and one of 1. rows: side, path, n (at least 1), profile."""
    ratio = threshold / (2 - threshold)
    n, side = rows.column("n").to_numpy(), rows.column("side").to_numpy()
    same = side[0] == 2
    if not same and side.min() == side.max():
        return
    order = np.argsort(n, kind="stable")
    if same:  # texts whose neighbours by length are too far have no partner
        near = n[order][:-1] >= ratio * n[order][1:]
        order = order[np.append(near, False) | np.insert(near, 0, False)]
        if not len(order):
            return
    a = _Side(rows, n, order if same else order[side[order] == 0])
    b = a if same else _Side(rows, n, order[side[order] == 1])
    _, ids = np.unique(a.ids if same else np.concatenate([a.ids, b.ids]), return_inverse=True)
    size = int(ids.max()) + 1
    shared = np.bincount(ids)[ids] > 1  # a bigram of one text only is shared with none
    cut = len(a.ids)
    a.keep(ids[:cut], shared[:cut])
    if not same:
        b.keep(ids[cut:], shared[cut:])
    kind = np.float32 if n.max() < 1 << 24 else np.float64  # sums up to there are exact
    lo, step = 0, TILE
    while lo < len(a.n):
        hi = min(lo + step, len(a.n))
        cap = np.zeros(size, np.int64)
        e = slice(a.off[lo], a.off[hi])
        np.maximum.at(cap, a.ids[e], a.counts[e])
        width = max(1, int(cap.sum()))
        if hi - lo > 1 and width * (hi - lo) > CELLS:
            step = (hi - lo) // 2
            continue
        place = np.cumsum(cap) - cap
        left = a.tile(lo, hi, place, cap, width, kind)
        at = lo if same else int(np.searchsorted(b.n, a.n[lo] * ratio * (1 - 1e-9)))
        end = int(np.searchsorted(b.n, a.n[hi - 1] / ratio * (1 + 1e-9), "right")) if ratio > 0 else len(b.n)
        more = max(1, min(TILE, CELLS // width))
        while at < end:
            to = min(at + more, end)
            both = left @ b.tile(at, to, place, cap, width, kind).T
            least = threshold / 2 * 0.9999
            i, j = np.nonzero(both >= (least * a.n[lo:hi]).astype(kind)[:, None] + (least * b.n[at:to]).astype(kind)[None])
            both, i, j = both[i, j].astype(np.float64), i + lo, j + at
            na, nb = a.n[i], b.n[j]
            alike = 2.0 * both / (na + nb)
            good = (alike >= threshold) & (np.minimum(na, nb) >= ratio * np.maximum(na, nb))
            if same:
                good &= i < j
            if good.any():
                x, y = a.paths.take(pa.array(i[good])), b.paths.take(pa.array(j[good]))
                less = pc.less(x, y)
                out = pa.RecordBatch.from_arrays([pc.if_else(less, x, y), pc.if_else(less, y, x), pa.array(alike[good])], ["path_a", "path_b", "similarity"])
                yield out.filter(pc.not_equal(x, y))
            at = to
        lo, step = hi, TILE


def _together(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in found:
        held.append(batch)
        n += batch.num_rows
        if n >= EMIT:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block in turn; they come sorted by their first column, the block."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if held and block[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = block[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(threshold: float):
    """For mapInArrow over rows sorted by block (block, side, path, n, profile)."""

    def run(batches):
        yield from _together(x for rows in _blocks(batches) for x in pairs_of(rows, threshold))

    return run


def profiles(batches):
    """For mapInArrow: the last column, a text in bytes, becomes n and profile."""
    for batch in batches:
        found = [pack(x.as_buffer().to_pybytes()) for x in batch.column(batch.num_columns - 1)]
        own = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([n for n, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], [*own, "n", "profile"])
