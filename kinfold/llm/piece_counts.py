"""Token counts: greedy longest-match word pieces, counted by one automaton step a byte.

The vocabulary is a trie with failure links (Song et al., "Fast WordPiece Tokenization", 2021). Where a byte has no child, the link of a node tells
which pieces leave the front of what was read and where reading goes on; only the *number* of those pieces is kept, so no piece is ever built.
Links are then folded into one transition table (node, byte) -> (node, pieces that leave), so reading a word costs one look-up a byte,
whatever the vocabulary, and numpy takes the k-th byte of every word of a block at once.

A word is a run of ASCII letters, digits and bytes of non-ASCII characters; each ASCII punctuation mark is a word. Texts are lower-cased.
A word that the pieces cannot cover counts as one unknown piece.

Defined cases: a null or empty text has 0 words and 0 pieces; repeated rows and rows with a null id are counted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.llm import shared


def byte_level_pieces(path: str) -> list[bytes]:
    """Pieces of a tokenizers file whose vocabulary is written in the byte-level alphabet; word-end marks are taken off."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    suffix = model.get("end_of_word_suffix") or ""
    out = set()
    for piece in model["vocab"]:
        piece = piece[: -len(suffix)] if suffix and piece.endswith(suffix) and piece != suffix else piece
        if all(c in back for c in piece) and piece:
            out.add(bytes(back[c] for c in piece))
    return sorted(out)


class Automaton:
    """Counts greedy pieces of words. ``prefix``: pieces that start with it match inside a word only, all others at its start only; None: all match anywhere."""

    #: Words of more bytes are read one by one, shorter ones all at once.
    WIDE = 256

    def __init__(self, pieces: list[bytes], prefix: bytes | None = None):
        children: list[dict[int, int]] = [{}]
        final, parent, byte, depth = [False], [0], [0], [0]

        def add(root: int, piece: bytes) -> None:
            v = root
            for b in piece:
                if b not in children[v]:
                    children[v][b] = len(children)
                    children.append({})
                    final.append(False)
                    parent.append(v)
                    byte.append(b)
                    depth.append(depth[v] + 1)
                v = children[v][b]
            final[v] = True

        inner = 0
        if prefix is not None:
            inner = 1
            children.append({})
            final.append(False), parent.append(1), byte.append(0), depth.append(0)
        for piece in pieces:
            if prefix is not None and piece.startswith(prefix) and piece != prefix:
                add(inner, piece[len(prefix) :])
            elif piece:
                add(0, piece)
        n = len(children)
        dead = n
        self.start, self.dead = 0, dead
        self.next = np.full((n + 1, 256), dead, np.int32)
        self.pops = np.zeros((n + 1, 256), np.uint16)
        link, left = np.full(n, -1, np.int64), np.zeros(n, np.int64)  # where reading goes on, pieces that have left by then
        self.at_end = np.full(n + 1, -1, np.int64)
        order = sorted(range(n), key=lambda v: (depth[v], v != inner))
        for v in order:
            if depth[v]:
                if final[v]:
                    link[v], left[v] = inner, 1
                else:
                    u, gone = int(link[parent[v]]), int(left[parent[v]])
                    # follow links until a node can read this byte; its own row is ready, being less deep
                    if u >= 0 and self.next[u, byte[v]] != dead:
                        link[v], left[v] = self.next[u, byte[v]], gone + int(self.pops[u, byte[v]])
            if link[v] >= 0:
                self.next[v] = self.next[link[v]]
                self.pops[v] = self.pops[link[v]] + np.uint16(left[v])
                self.at_end[v] = -1 if self.at_end[link[v]] < 0 else self.at_end[link[v]] + left[v]
            if v == inner:
                self.at_end[v] = 0
            for b, w in children[v].items():
                self.next[v, b], self.pops[v, b] = w, 0
        self.inner = inner

    def count(self, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word, and whether it is covered (else it counts 1)."""
        order = np.argsort(-length, kind="stable")
        order, long = order[length[order] <= self.WIDE], order[length[order] > self.WIDE]
        at_all, at, size = at, at[order], length[order]
        state, got = np.full(len(at), self.start, np.int64), np.zeros(len(at), np.int64)
        longer = len(at) - np.searchsorted(size[::-1], np.arange(1, int(size[0]) + 1 if len(size) else 1))
        flat_next, flat_pops = self.next.ravel(), self.pops.ravel()
        for k, n in enumerate(longer):
            key = state[:n] * 256 + data[at[:n] + k]
            got[:n] += flat_pops[key]
            state[:n] = flat_next[key]
        end = self.at_end[state]
        ok = end >= 0
        total, known = np.empty(len(at_all), np.int64), np.empty(len(at_all), bool)
        total[order] = np.where(ok, got + end, 1)
        known[order] = ok
        # few words are that long; a pass over all of them for each of their bytes would cost more than the bytes
        step, pops = memoryview(flat_next), memoryview(flat_pops)
        for i in long.tolist():
            v, n = self.start, 0
            for b in data[at_all[i] : at_all[i] + length[i]].tobytes():
                key = v * 256 + b
                n += pops[key]
                v = step[key]
            end = int(self.at_end[v])
            total[i], known[i] = (n + end, True) if end >= 0 else (1, False)
        return total, known


_BUILT: dict[tuple, Automaton] = {}
shared.keeps("pieces", _BUILT.clear)


def _automaton(path: str, prefix: bytes | None) -> Automaton:
    """One automaton a worker process, built from the vocabulary file that every machine has."""
    if (path, prefix) not in _BUILT:
        _BUILT[path, prefix] = Automaton(byte_level_pieces(path), prefix)
    return _BUILT[path, prefix]


def count_pieces(docs: DataFrame, vocabulary: str, prefix: bytes | None = None, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_words, n_pieces, n_unknown (words that the pieces do not cover, each also counted once in n_pieces). One narrow pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        shared.claim("pieces")
        auto = _automaton(vocabulary, prefix)
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for lo, hi, data, off in shared.chunks(shared.utf8(batch, "text")):
                at, length, doc = shared.words(data, off, shared.PLAIN)
                total, known = auto.count(data, at, length)
                m = hi - lo
                out[:, lo:hi] = np.bincount(doc, minlength=m), np.bincount(doc, total, m), np.bincount(doc, ~known, m)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], [id_col, "n_words", "n_pieces", "n_unknown"])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, n_words long, n_pieces long, n_unknown long")
