"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy, its thresholds calibrated by language.

A word (lower-cased run of letters and digits) is the sum of four rows of one hashed table: two independent hashes of the word, so that two words are
confused only if both collide, and one for each of two lengths of its first bytes. Filters of several widths slide over the words, each keeps its largest response in the
whole text (max pooling), and a logistic layer reads those. Gradients reach only the words that won a pool, so a step is cheap on texts of any length.

Learning takes every labelled row. The driver holds about ``hold`` of them at once: more are dealt by a hash of their words into chunks, written to the shared folder and read one by one,
each at least once (``epochs`` times if there is one chunk). A fifth of all rows is kept from the gradient and sets, for each language that the text classifier of this folder finds in the text (never a column), the logit above which a text is called toxic;
that logit becomes a score of ``decide``. Languages with few such rows share the common threshold.

Defined cases: null and empty texts get the score of a text without words; null labels and labels of null ids are not learned from; no labelled row, or one class only: every score 0. Ids labelled more than
once count as toxic if any row says so. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import lang_id, shared

#: Words are runs of letters, digits and non-ASCII characters; marks only part them.
_WORDS = np.where(shared.PLAIN == shared.WORD, shared.WORD, shared.SPACE).astype(np.uint8)


@dataclass(frozen=True)
class ToxConfig:
    bits: int = 17
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    hold: int = 5000
    broadcast_ids: int = 2_000_000
    prefixes: tuple[int, ...] = (6, 8)
    epochs: int = 10
    batch: int = 32
    rate: float = 0.15
    decide: float = 0.7
    least_for_language: int = 40
    seed: int = 11


@dataclass
class ToxModel:
    emb: np.ndarray
    conv: list[np.ndarray]  # per width: (width, dim, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    c: float
    slope: float
    limit: dict[str, float]
    common: float
    langs: lang_id.LangModel | None
    cfg: ToxConfig
    usable: bool = True


def word_rows(data: np.ndarray, off: np.ndarray, cfg: ToxConfig) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of every word (two of the word, one of each prefix) and its document."""
    at, length, doc = shared.words(data, off, _WORDS)
    h = shared.word_hashes(data, at, length)
    s = np.uint64(64 - cfg.bits)
    own = [shared.word_hashes(data, at, np.minimum(length, n)) * m >> s for n, m in zip(cfg.prefixes, shared.seeds(len(cfg.prefixes), 9), strict=True)]
    return np.stack([h >> s, (h * np.uint64(0x9E3779B97F4A7C15)) >> s, *own], 1).astype(np.int32), doc


def _padded(rows: np.ndarray, doc: np.ndarray, m: int, cfg: ToxConfig) -> tuple[np.ndarray, np.ndarray]:
    """Rows with empty words around each document (so no window spans two and each has one), and the first position of each document."""
    gap = max(cfg.widths)
    n = np.bincount(doc, minlength=m)
    first = np.concatenate([[0], np.cumsum(n + gap)[:-1]])
    out = np.full((len(rows) + gap * m, rows.shape[1]), 1 << cfg.bits, np.int32)
    out[np.arange(len(rows)) + gap * doc] = rows
    return out, first


def _pool(x: np.ndarray, first: np.ndarray, conv, bias):
    """Largest response of each filter in each document; x ends with room for the widest filter."""
    best = []
    for w, b in zip(conv, bias, strict=True):
        n = len(x) - len(w) + 1
        a = x[:n] @ w[0]
        for j in range(1, len(w)):
            a += x[j : n + j] @ w[j]
        a += b
        best.append((np.maximum.reduceat(a, first, axis=0), a))
    return best


def logits(model: ToxModel, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows, doc = word_rows(data, off, model.cfg)
    rows, first = _padded(rows, doc, len(off) - 1, model.cfg)
    x = model.emb[rows[:, 0]]
    for i in range(1, rows.shape[1]):
        x += model.emb[rows[:, i]]
    return np.maximum(np.hstack([m for m, _ in _pool(x, first, model.conv, model.bias)]), 0) @ model.out + model.c


def train(load: Callable[[int, bool], tuple], chunks: int, counts: dict[tuple[int, bool], int], langs, cfg: ToxConfig) -> ToxModel:
    """load(chunk, checked): table rows of each word of a document, label, language and part (0: kept from the gradient) of the chunk's documents, or of its checked ones only.
    counts: all documents by (label, checked)."""
    rng = np.random.default_rng(cfg.seed)
    k = len(cfg.widths) * cfg.filters
    emb = rng.normal(0, 0.2, ((1 << cfg.bits) + 1, cfg.dim)).astype(np.float32)
    emb[-1] = 0
    conv = [rng.normal(0, 0.4 / w, (w, cfg.dim, cfg.filters)).astype(np.float32) for w in cfg.widths]
    bias = [np.zeros(cfg.filters, np.float32) for _ in cfg.widths]
    out = rng.normal(0, 0.3, k).astype(np.float32)
    model = ToxModel(emb, conv, bias, out, 0.0, 1.0, {}, 0.0, langs, cfg)
    if len({y for y, _ in counts}) < 2:
        model.usable = False
        return model
    g2 = {id(a): np.full(a.shape, 1e-4, np.float32) for a in [emb, out, *conv, *bias]}
    gc = 1e-4

    def step(a, g):
        s = g2[id(a)]
        s += g * g
        a -= cfg.rate * g / np.sqrt(s)

    classes = {c: {y for y, checked in counts if checked == c} for c in (False, True)}
    all_learn = len(classes[False]) < 2
    learned = {y: sum(n for (label, checked), n in counts.items() if label == y and (all_learn or not checked)) for y in (0, 1)}
    share = learned[1] / (learned[0] + learned[1])

    def chunk(i, checked=False):
        texts, y, lang, part = load(i, checked)
        order = np.lexsort((np.array([int(t.astype(np.int64).sum()) for t in texts]), np.array([len(t) for t in texts]), y))
        return texts, y, lang, part, order

    def run(texts, rows):
        doc = np.repeat(np.arange(len(rows)), [len(texts[r]) for r in rows])
        flat = np.concatenate([texts[r] for r in rows]) if len(doc) else np.zeros((0, 2 + len(cfg.prefixes)), np.int32)
        return _padded(flat, doc, len(rows), cfg)

    one = chunk(0) if chunks == 1 else None
    for i in range(cfg.epochs if chunks == 1 else chunks * -(-cfg.epochs // chunks)):
        texts, y, _, part, order = one or chunk(i % chunks)
        perm = rng.permutation(order if all_learn else order[part[order] != 0])
        for lo in range(0, len(perm), cfg.batch):
            rows = perm[lo : lo + cfg.batch]
            idx, first = run(texts, rows)
            x = emb[idx].sum(1)
            pools = _pool(x, first, conv, bias)
            top = np.hstack([m for m, _ in pools])
            act = np.maximum(top, 0)
            z = act @ out + model.c
            target = y[rows]
            g = (1 / (1 + np.exp(-z)) - target) * np.where(target == 1, 0.5 / share, 0.5 / (1 - share)) / len(rows)
            g = g.astype(np.float32)
            d_act = g[:, None] * out[None] * (top > 0)
            step(out, act.T @ g)
            gc += float(g.sum()) ** 2
            model.c -= cfg.rate * float(g.sum()) / np.sqrt(gc)
            d_emb_at, d_emb = [], []
            docs_of = np.repeat(np.arange(len(rows)), np.diff(np.append(first, len(idx))))
            for k, (w, (m, a)) in enumerate(zip(conv, pools, strict=True)):
                d = d_act[:, k * cfg.filters : (k + 1) * cfg.filters]
                gw, gb = np.zeros_like(w), d.sum(0)
                hit = a == m[docs_of[: len(a)]]
                for f in range(cfg.filters):
                    p = np.flatnonzero(hit[:, f])
                    p = p[np.unique(docs_of[p], return_index=True)[1]]  # the first that reached it
                    df = d[docs_of[p], f]
                    live = df != 0
                    p, df = p[live], df[live]
                    for j in range(len(w)):
                        gw[j, :, f] += df @ x[p + j]
                        d_emb_at.append(p + j)
                        d_emb.append(df[:, None] * w[j, :, f][None])
                step(w, gw)
                step(bias[k], gb)
            at = idx[np.concatenate(d_emb_at)].ravel()
            val = np.repeat(np.concatenate(d_emb), idx.shape[1], axis=0)
            uniq, inv = np.unique(at, return_inverse=True)
            total = np.zeros((len(uniq), cfg.dim), np.float32)
            np.add.at(total, inv, val)
            s = g2[id(emb)]
            s[uniq] += total * total
            emb[uniq] -= cfg.rate * total / np.sqrt(s[uniq])
            emb[-1] = 0
    own_check = len(classes[True]) == 2
    zs, ys, of = [], [], []
    for i in range(chunks):
        texts, y, lang, part, order = one or chunk(i, own_check)
        check = order[part[order] == 0] if own_check else order if all_learn else order[part[order] != 0]
        for lo in range(0, len(check), 64):
            idx, first = run(texts, check[lo : lo + 64])
            zs.append(np.maximum(np.hstack([m for m, _ in _pool(emb[idx].sum(1), first, conv, bias)]), 0) @ out + model.c)
        ys.append(y[check])
        of += [lang[r] for r in check]
    z, y, of = np.concatenate(zs).astype(float), np.concatenate(ys), np.array(of)
    model.common = _threshold(z, y)
    model.slope = float(np.clip(2.0 / max(1e-3, np.std(z)), 0.2, 4.0))
    for name in sorted(set(of)):
        own = of == name
        if own.sum() >= cfg.least_for_language and y[own].sum() >= 8:
            model.limit[name] = _threshold(z[own], y[own])
    return model


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best F0.5 (a clean text called toxic weighs more than a miss): the middle of the gap below it."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    best = int(np.argmax(1.25 * hits / (np.arange(1, len(z) + 1) + 0.25 * max(1, y.sum()))))
    zs = z[order]
    return float((zs[best] + (zs[best + 1] if best + 1 < len(zs) else zs[best] - 1)) / 2)


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxConfig = ToxConfig(), id_col: str = "doc_id", label_col: str = "toxic", langs: lang_id.LangModel | None = None) -> ToxModel:
    """Learn from the rows of ``labels`` (restrict it to those that may be learned from) and their texts."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y"))
    n = {r[0]: r[1] for r in one.groupBy("_y").count().collect()}
    total = sum(n.values())
    chunks = max(1, -(-total // cfg.hold))
    held = docs.sparkSession.sparkContext.broadcast(langs)

    def features(batches):
        model = held.value
        for batch in batches:
            lang, part, rows, deal = [], [], [], []
            y = batch.column(1)
            for lo, hi, data, off in shared.chunks(shared.utf8(batch, "text")):
                got, doc = word_rows(data, off, cfg)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                p = lang_id.predict_bytes(model, data, off) if model and model.langs else np.zeros((hi - lo, 1))
                for i in range(hi - lo):
                    own = got[cut[i] : cut[i + 1]]
                    rows.append(own.tobytes())
                    deal.append(int(shared.mix(np.array([own.astype(np.int64).sum() * 31 + len(own)], np.uint64))[0] % np.uint64(chunks)))
                    lang.append(model.langs[int(p[i].argmax())] if model and model.langs and p[i].any() else lang_id.UND)
                    part.append(int(shared.mix(np.array([own.astype(np.int64).sum() + len(own)], np.uint64))[0] % np.uint64(5)))
            yield pa.RecordBatch.from_arrays([y, pa.array(lang, pa.string()), pa.array(part, pa.int32()), pa.array(rows, pa.binary()), pa.array(deal, pa.int32())], ["y", "lang", "part", "rows", "chunk"])

    # ids alone are broadcast while they are few enough for the driver; beyond that the texts move
    ids = F.broadcast(one) if total <= cfg.broadcast_ids else one.hint("merge")
    got = docs.select(id_col, "text").join(ids, id_col).select("text", "_y").mapInArrow(features, "y int, lang string, part int, rows binary, chunk int")
    scratch = shared.Scratch(docs.sparkSession, "toxicity")
    if chunks > 1:
        at = scratch.path()
        got.repartition("chunk").write.partitionBy("chunk").option("compression", "zstd").parquet(at)
        stored = docs.sparkSession.read.schema(got.schema).parquet(at)
        counts = {(r[0], r[1]): r[2] for r in stored.groupBy("y", F.col("part") == 0).count().collect()}
        whole = None
    else:
        whole = got.toArrow()
        counts = {}
        for y, part in zip(whole.column("y").to_pylist(), whole.column("part").to_pylist(), strict=True):
            counts[y, part == 0] = counts.get((y, part == 0), 0) + 1

    def load(i, checked):
        t = whole if whole is not None else stored.filter((F.col("chunk") == i) & ((F.col("part") == 0) if checked else F.lit(True))).toArrow()
        texts = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2 + len(cfg.prefixes)) for x in t.column("rows")]
        return texts, t.column("y").to_numpy(), t.column("lang").to_pylist(), t.column("part").to_numpy()

    model = train(load, chunks, counts, langs, cfg)
    if whole is None:
        scratch.paths.append((stored, at))
        scratch.drop(stored)
    del got, whole
    shared.release()  # the driver keeps the model only
    return model


def score(docs: DataFrame, model: ToxModel, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, score, predicted. One narrow pass over whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        shared.claim("toxicity")
        model = held.value
        shift = np.log(model.cfg.decide / (1 - model.cfg.decide))
        for batch in batches:
            s = np.zeros(batch.num_rows)
            if model.usable:
                for lo, hi, data, off in shared.chunks(shared.utf8(batch, "text"), 1 << 20):
                    limit = np.full(hi - lo, model.common)
                    if model.langs is not None and len(model.langs.langs) > 1:
                        p = lang_id.predict_bytes(model.langs, data, off)
                        per = np.array([model.limit.get(x, model.common) for x in model.langs.langs])
                        limit = np.where(p.any(1), per[p.argmax(1)], model.common)
                    s[lo:hi] = 1 / (1 + np.exp(-np.clip(model.slope * (logits(model, data, off) - limit) + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= model.cfg.decide).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, score double, predicted int")
