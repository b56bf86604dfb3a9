"""LM scoring by cross-entropy difference (Moore and Lewis, 2010).

Two n-gram models, one of the target documents and one of all documents, share one closed vocabulary, the bytes of the lower-cased UTF-8 text, one order
and one smoothing. The background's counts are scaled to the target's total before smoothing, so that the models are matched in size. The
score of a document is the mean over its bytes of (background loss - target loss), in nats: high where a text reads like the target.

Counting covers every byte of every document and is exact: an n-gram of at most 7 bytes is one long, with its order in the top byte. A task adds up the longest n-grams of its
documents and sends the sums; they are summed by n-gram, and shorter ones follow from them, as each byte ends one n-gram of each order. The counts are a
table that grows with the corpus and is never held whole.

Scoring deals documents in parts of about ``part_bytes``, each written once. A part asks the table for its distinct n-grams (a join by n-gram), and its documents meet the
answers in one group by part, so a task holds the n-grams of one part only.

p_k(b | c) = (n(c b) + m p_{k-1}(b | c')) / (n(c .) + m), c' being c without its first byte, n(c .) the times that c was followed by a byte (so the ends of texts are counted too, and the
probabilities of a context sum to one), and p_0 uniform over 256 bytes. The start of a text is a context like another.

Defined cases: a null or empty text has 0 tokens, losses 0 and score 0. No target document: the target model is uniform. Repeated rows and rows with a null id count and are scored each.
Extra columns are ignored; a null target mark means no.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm import shared

_ORDER_AT = 56


@dataclass(frozen=True)
class LmConfig:
    order: int = 5
    prior: float = 4.0
    part_bytes: int = 16 << 20
    held_grams: int = 4 << 20

    def __post_init__(self):
        if not 1 <= self.order <= 7:
            raise ValueError("order must be 1 to 7")


@dataclass
class LmModel:
    counts: DataFrame  # gram (with its order in the top byte), target, background, and how many of these end a text
    totals: tuple[int, int]
    texts: tuple[int, int]  # texts that are not empty
    cfg: LmConfig


#: Columns of counts: of the target and of all, anywhere and at the end of a text.
_COUNTS = ("target", "background", "target_end", "background_end")
_COUNT_TYPES = ", ".join(f"{c} long" for c in _COUNTS)


def _grams(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """The longest n-gram that ends at each byte, its last byte lowest. Bytes before a document's first are 0."""
    m, pad = len(off) - 1, order - 1
    buf = np.zeros(len(data) + pad * m, np.int64)
    at = np.arange(len(data)) + pad * (np.repeat(np.arange(m), np.diff(off)) + 1)
    buf[at] = data
    out = buf[at]
    for k in range(1, order):
        out |= buf[at - k] << (8 * k)
    return out


def _key(gram, k: int):
    """The key of the k-gram at the end of a longer one."""
    return (gram & ((1 << 8 * k) - 1)) | (k << _ORDER_AT)


def _keys(gram: Column, order: int) -> Column:
    return F.array(*[gram.bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long")).bitwiseOR(F.lit(k << _ORDER_AT).cast("long")) for k in range(1, order + 1)])


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    n = np.concatenate([c for _, c in held])
    return gram, np.stack([np.bincount(at, n[:, i], len(gram)) for i in range(len(_COUNTS))], 1).astype(np.int64)


def fit(docs: DataFrame, target: str, cfg: LmConfig = LmConfig()) -> LmModel:
    """Count ``docs`` (text, and ``target``: true for rows of the target domain)."""

    def count(batches):
        shared.claim("lm")
        held, size = [], 0
        for batch in batches:
            mark = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in shared.chunks(shared.utf8(batch, "text")):
                every = _grams(data, off, cfg.order)
                gram, n = np.unique(every, return_counts=True)
                both = np.zeros((len(gram), len(_COUNTS)), np.int64)
                both[:, 1] = n
                full = np.diff(off) > 0
                last = off[1:][full] - 1
                marked = mark[lo:hi]
                for column, some in ((0, every[np.repeat(marked, np.diff(off))]), (2, every[last[marked[full]]]), (3, every[last])):
                    if len(some):
                        chosen, n = np.unique(some, return_counts=True)
                        both[np.searchsorted(gram, chosen), column] = n
                held.append((gram, both))
                size += len(gram)
                if size > cfg.held_grams:
                    held = [_added(held)]
                    size = len(held[0][0])
                    if size > cfg.held_grams // 2:
                        yield from sent(held)
                        held, size = [], 0
        if held:
            yield from sent([_added(held)])

    def sent(held):
        gram, n = held[0]
        for lo in range(0, len(gram), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(gram[s]), *(pa.array(n[s, i]) for i in range(len(_COUNTS)))], ["gram", *_COUNTS])

    tmp = shared.Scratch(docs.sparkSession, "lm")
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    part = docs.select("text", target).mapInArrow(count, f"gram long, {_COUNT_TYPES}")
    longest = part.groupBy("gram").agg(*sums)
    counts = tmp.write(longest.select(F.explode(_keys(F.col("gram"), cfg.order)).alias("gram"), *_COUNTS).groupBy("gram").agg(*sums))
    one = counts.filter(F.shiftright("gram", _ORDER_AT) == 1).agg(*sums).first()
    return LmModel(counts, (one[0] or 0, one[1] or 0), (one[2] or 0, one[3] or 0), cfg)


def losses(gram: np.ndarray, key: np.ndarray, n: np.ndarray, totals: tuple[int, int], cfg: LmConfig, texts: tuple[int, int] | None = None) -> np.ndarray:
    """Loss of the last byte of each n-gram under both models; ``key`` (sorted) and ``n`` are the counts that it asks for. ``texts``: of a document's first byte, whose context is the start of a text."""
    scale = np.array([1.0, totals[0] / totals[1] if totals[0] else 1.0])

    def look(of: np.ndarray, k: int) -> np.ndarray:
        want = _key(of, k)
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where((key[at] == want)[:, None], n[at], 0)

    p = np.full((len(gram), 2), 1 / 256)
    for k in range(1, cfg.order + 1):
        seen = look(gram, k)[:, :2] * scale
        if k == 1 or texts is not None:
            context = np.broadcast_to((totals if k == 1 else texts) * scale, seen.shape)
        else:
            # the context of a k-gram is the (k-1)-gram that ended one byte earlier, where the text went on
            before = look(gram >> 8, k - 1)
            context = (before[:, :2] - before[:, 2:]) * scale
        p = (seen + cfg.prior * p) / (np.maximum(context, seen) + cfg.prior)
    return -np.log(p)


def _parts(docs: DataFrame, cfg: LmConfig, id_col: str, kind: str) -> DataFrame:
    def run(batches):
        size, here = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            # a row counts some bytes of its own, so a part has not endless empty texts
            n = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            part = here + (size + np.concatenate([[0], n[:-1]])) // cfg.part_bytes if len(n) else n
            size += int(n[-1]) if len(n) else 0
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), batch.column(0), batch.column(1)], ["part", id_col, "text"])

    return docs.select(id_col, "text").mapInArrow(run, f"part long, {id_col} {kind}, text string")


def score(docs: DataFrame, model: LmModel, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens, loss_target, loss_background (means per token), score."""
    cfg, totals, texts = model.cfg, model.totals, model.texts
    kind = docs.schema[id_col].dataType.simpleString()
    # written, for the parts must be the same when they ask and when they are scored
    parts = shared.Scratch(docs.sparkSession, "lm-parts").write(_parts(docs, cfg, id_col, kind))

    def ask(batches):
        shared.claim("lm")
        part, held = None, []

        def asked():
            gram = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            for k in range(cfg.order, 0, -1):
                key = np.unique(_key(gram, k))
                for lo in range(0, len(key), 1 << 16):
                    some = key[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part, np.int64)), pa.array(some)], ["part", "gram"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b > a and of[a] != part:
                    yield from asked()
                    part, held = int(of[a]), []
                for _, _, data, off in shared.chunks(shared.utf8(batch.slice(a, b - a), "text")):
                    held.append(np.unique(_grams(data, off, cfg.order)))
        yield from asked()

    def judge(rows: pa.Table, known: pa.Table) -> pa.Table:
        key, at = np.unique(known.column("gram").to_numpy(), return_index=True)
        counts = np.stack([known.column(c).to_numpy()[at] for c in _COUNTS], 1)
        gram = key[key >> _ORDER_AT == cfg.order] & ((1 << 8 * cfg.order) - 1)
        n, total = np.zeros(rows.num_rows, np.int64), np.zeros((rows.num_rows, 2))
        if len(gram):
            inner, outer = losses(gram, key, counts, totals, cfg), losses(gram, key, counts, totals, cfg, texts)
            for lo, hi, data, off in shared.chunks(pc.utf8_lower(rows.column("text"))):
                n[lo:hi] = np.diff(off)
                full = np.flatnonzero(np.diff(off) > 0)
                if len(full):
                    at = np.searchsorted(gram, _grams(data, off, cfg.order))
                    loss, begin = inner[at], off[:-1][full]
                    loss[begin] = outer[at[begin]]
                    total[lo + full] = np.add.reduceat(loss, begin, axis=0)
        total /= np.maximum(n, 1)[:, None]
        return pa.table([rows.column(id_col), pa.array(n), pa.array(total[:, 0]), pa.array(total[:, 1]), pa.array(total[:, 1] - total[:, 0])], [id_col, "n_tokens", "loss_target", "loss_background", "score"])

    asked = parts.select("part", "text").mapInArrow(ask, "part long, gram long")
    known = asked.join(model.counts.hint("merge"), "gram", "left").na.fill(0, list(_COUNTS)).select("part", "gram", *_COUNTS)
    return parts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(judge, f"{id_col} {kind}, n_tokens long, loss_target double, loss_background double, score double")
