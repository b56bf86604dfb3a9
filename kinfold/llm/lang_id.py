"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

A text is lower-cased; every character that is neither an ASCII letter nor outside ASCII becomes a space. Its subwords are the 2-, 3-
and 4-byte n-grams of the rest with word edges as spaces, hashed into ``2 ** bits`` rows of an embedding table; the text is the average of those
rows, and a linear softmax over it gives the languages. Embedding and softmax multiply into one table of logits a bucket, so that scoring a text is
a sum over its bytes: whole texts of any length at a fixed cost per byte.

Learning takes about ``per_lang`` labelled rows of each language, chosen by a hash of the id, and short windows of them; of more than ``most_langs`` languages the most frequent.
These two parameters are the only bounds here; they shape what is learned from, and every text is scored whole.
A fifth of those rows sets the temperature and the score below which a text is rejected: at most ``false_reject`` of good rows fall under it.

Defined cases: null text or no letter: ``und``, score 0, rejected. No labelled row at all: ``und`` for every text. One language: it, with score 1.
Equal logits: the first language by name. Repeated rows and null ids are scored like others (null ids are never learned from). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import shared

UND = "und"


@dataclass(frozen=True)
class LangConfig:
    bits: int = 15
    dim: int = 16
    per_lang: int = 800
    most_langs: int = 1000
    epochs: int = 12
    rate: float = 4.0
    batch: int = 64
    false_reject: float = 0.002
    highest_reject: float = 0.5
    windows: tuple[int, ...] = (24, 80, 240)
    seed: int = 7


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # buckets x languages, float32
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int


_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, off: np.ndarray, bits: int):
    """For each n: bucket of each subword and the document it starts in, documents ascending."""
    m, size = len(off) - 1, np.diff(off)
    buf = np.full(len(data) + 2 * m, 32, np.uint8)
    doc = np.repeat(np.arange(m, dtype=np.int64), size)
    buf[np.arange(len(data)) + 2 * doc + 1] = _KEEP[data]
    owner = np.repeat(np.arange(m, dtype=np.int32), size + 2)
    space = buf == 32
    gap = np.append(space[1:] & space[:-1], True)
    wide = buf.astype(np.uint32)
    bad, h = gap, wide
    for n in (2, 3, 4):
        h = h[:-1] | (wide[n - 1 :] << np.uint32(8 * (n - 1)))
        bad = gap[: len(h)] if n == 2 else bad[: len(h)] | gap[n - 2 : n - 2 + len(h)]
        ok = np.flatnonzero(~bad)
        key = (h[ok] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
        yield key >> np.uint32(32 - bits), owner[ok]


def _features(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and the share of its subwords in each."""
    total = np.zeros(1 << bits, np.int64)
    for key, _ in _grams(data, np.array([0, len(data)]), bits):
        total += np.bincount(key, minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, total[at] / max(1, total.sum())


def _windows(data: np.ndarray, sizes: tuple[int, ...], seed: int) -> list[np.ndarray]:
    out = []
    for i, n in enumerate(sizes):
        if len(data) > 2 * n:
            lo = (seed * 2654435761 + i * 40503) % (len(data) - n)
            out.append(data[lo : lo + n])
    return out


def sample_rows(docs: DataFrame, cfg: LangConfig, id_col: str, lang_col: str, learn) -> DataFrame:
    """About ``per_lang`` rows of each language among those that may be learned from, by a hash of the id: one count a language, then one filter."""
    ok = docs.filter(learn & F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in ok.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(cfg.most_langs).collect()}
    if not counts:
        return ok.select(lang_col, "text").limit(0)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, cfg.per_lang / n) * (1 << 20))))])
    ok = ok.filter((F.pmod(F.xxhash64(F.col(id_col), F.lit(cfg.seed)), F.lit(1 << 20))) < F.element_at(share, F.col(lang_col)))
    return ok.select(lang_col, "text")


def fit(docs: DataFrame, cfg: LangConfig = LangConfig(), id_col: str = "doc_id", lang_col: str = "lang", learn=None) -> LangModel:
    """Learn from ``docs``' text and language where ``learn`` holds. The driver gets hashed counts of the sample only."""
    bits, sizes, seed = cfg.bits, cfg.windows, cfg.seed

    def features(batches):
        for batch in batches:
            rows = {"lang": [], "part": [], "at": [], "share": []}
            text = shared.utf8(batch, "text")
            langs = batch.column(0).to_pylist()
            for lo, _, data, off in shared.chunks(text, 0):
                part = int(shared.mix(np.array([len(data) * 7919 + int(data[:256].astype(np.int64).sum())], np.uint64))[0] % np.uint64(5))
                for k, piece in enumerate([data, *_windows(data, sizes, seed + len(data))]):
                    at, share = _features(piece, bits)
                    if len(at):
                        rows["lang"].append(langs[lo])
                        rows["part"].append(part * 2 + (k > 0))
                        rows["at"].append(at.astype(np.int32))
                        rows["share"].append(share.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(rows["lang"], pa.string()), pa.array(rows["part"], pa.int32()), pa.array(rows["at"], pa.list_(pa.int32())), pa.array(rows["share"], pa.list_(pa.float32()))], ["lang", "part", "at", "share"])

    got = sample_rows(docs, cfg, id_col, lang_col, F.lit(True) if learn is None else learn).mapInArrow(features, "lang string, part int, at array<int>, share array<float>").toArrow()
    model = train(got, cfg)
    del got
    shared.release()  # the driver keeps the model only
    return model


def train(got: pa.Table, cfg: LangConfig) -> LangModel:
    langs = sorted(set(got.column("lang").to_pylist()))
    buckets, k = 1 << cfg.bits, len(langs)
    if k < 2:
        return LangModel(langs, np.zeros((buckets, max(k, 1)), np.float32), np.zeros(max(k, 1)), 1.0, 0.0, cfg.bits)
    y = np.array([langs.index(x) for x in got.column("lang").to_pylist()])
    part = got.column("part").to_numpy()
    at = [np.asarray(x.values) for x in got.column("at")]
    share = [np.asarray(x.values) for x in got.column("share")]
    order = np.lexsort((np.array([int(a.sum()) for a in at]), np.array([len(a) for a in at]), y, part))  # arrival order must not matter
    rng = np.random.default_rng(cfg.seed)
    emb = rng.normal(0, 0.1, (buckets, cfg.dim)).astype(np.float32)
    out = np.zeros((k, cfg.dim), np.float32)
    bias = np.zeros(k, np.float32)
    learn = order[part[order] // 2 != 0]
    weight = (len(learn) / (k * np.maximum(1, np.bincount(y[learn], minlength=k)))).astype(np.float32)

    steps = max(1, cfg.epochs * (len(learn) // cfg.batch + 1))
    step = 0
    for _ in range(cfg.epochs):
        perm = rng.permutation(learn)
        for lo in range(0, len(perm), cfg.batch):
            rows = perm[lo : lo + cfg.batch]
            rate = cfg.rate * (1 - step / steps)
            step += 1
            # the buckets of the batch end to end; no row is spread over all of them
            where, value = np.concatenate([at[r] for r in rows]), np.concatenate([share[r] for r in rows])
            size = np.array([len(at[r]) for r in rows])
            z = np.add.reduceat((emb @ out.T)[where] * value[:, None], np.cumsum(size) - size, axis=0) + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows], None] / len(rows)
            # both layers' gradients follow from the errors summed by bucket, so nothing of the embedding's width is made for a subword
            error = np.repeat(p, size, axis=0) * value[:, None]
            summed = np.stack([np.bincount(where, error[:, c], buckets) for c in range(k)], 1).astype(np.float32)
            step_emb, step_out = summed @ out, summed.T @ emb
            out -= rate * step_out
            bias -= 0.1 * rate * p.sum(0)
            emb -= rate * 50 * step_emb
    table = emb @ out.T
    check = order[part[order] // 2 == 0]
    check = check if len(check) >= 5 else learn
    z = np.array([share[r] @ table[at[r]] for r in check]) + bias
    right = y[check]

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), right]))

    temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    s = np.exp(z / temperature - (z / temperature).max(1, keepdims=True))
    s /= s.sum(1, keepdims=True)
    good = s.max(1)[(s.argmax(1) == right) & (part[check] % 2 == 0)]
    reject = float(min(cfg.highest_reject, np.quantile(good, cfg.false_reject) * 0.999)) if len(good) else 0.0
    return LangModel(langs, table.astype(np.float32), bias.astype(np.float64), temperature, reject, cfg.bits)


def predict_bytes(model: LangModel, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Softmax rows for the lower-cased texts in ``data``; 0 in every column where a text has no subword."""
    m, k = len(off) - 1, len(model.langs)
    z, n = np.zeros((m, max(k, 1))), np.zeros(m, np.int64)
    for key, doc in _grams(data, off, model.bits):
        if not len(key):
            continue
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        z[doc[first]] += np.add.reduceat(model.table[key], first, axis=0, dtype=np.float64)
        n += np.bincount(doc, minlength=m)
    z = (z / np.maximum(n, 1)[:, None] + model.bias) / model.temperature
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    return z * (n > 0)[:, None]


def _judge(texts: pa.Array, model: LangModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the language (one past the last: und), score and rejection of each text."""
    import pyarrow.compute as pc

    n, und = len(texts), len(model.langs)
    pred, best = np.full(n, und), np.zeros(n)
    for lo, hi, data, off in shared.chunks(pc.utf8_lower(texts)):
        size = np.diff(off)
        # reduceat gives an empty text its neighbour's first byte, hence the last factor
        letter = np.add.reduceat(np.append((data >= 97) & (data <= 122), False), off[:-1], dtype=np.int64) * (size > 0) > 0
        for i in np.flatnonzero(~letter & (size > 0)):
            letter[i] = any(c.isalpha() for c in texts[lo + int(i)].as_py())
        if not model.langs:
            continue
        p = predict_bytes(model, data, off)
        none = letter & (p.sum(1) == 0)  # a letter outside the kept bytes makes no subword: the bias decides
        prior = np.exp(model.bias / model.temperature)
        p[none] = prior / prior.sum()
        pred[lo:hi] = np.where(letter, p.argmax(1), und)
        best[lo:hi] = np.where(letter, p.max(1).clip(0, 1), 0.0)
    return pred, best, (pred == und) | (best < model.reject_below)


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: id, lang_pred, score and rejected (``und``, or a score under the calibrated limit). No shuffle; one pass over the texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        shared.claim("lang")
        names = np.array([*held.value.langs, UND], object)
        for batch in batches:
            pred, best, reject = _judge(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[pred], pa.string()), pa.array(best), pa.array(reject)], [id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, "text").mapInArrow(score, f"{id_col} {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LangModel) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, all columns kept. One narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches):
        shared.claim("lang")
        for batch in batches:
            mask = ~_judge(batch.column(place), held.value)[2]
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(keep, docs.schema)
