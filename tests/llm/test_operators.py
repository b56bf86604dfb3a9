"""Operators against brute force on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import gc
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.llm import decontaminate, embed_dedup, jaccard_join, lang_id, lm_score, mixing, piece_counts, preference, queries, shared, token_store, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, n int, id int, root string"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, texts, lang="en"):
    """Documents with extra columns whose names operators use inside."""
    return table(spark, [(i, t, lang, f"s{(i or 0) % 3}", len(t or ""), "x", 1, 2, "y") for i, t in texts], DOCS)


# ---------------------------------------------------------------- 1


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op1_language_id(spark, sf)
    assert got.count() == docs.count()
    j = got.join(docs, "doc_id").filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score").toPandas()
    assert j.ok.mean() > 0.95 and j.score.between(0, 1).all()


def test_language_id_edges(spark, sf):
    model = lang_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r.doc_id: r for r in lang_id.identify(docs_of(spark, [(1, None), (2, ""), (3, "12 345 !!"), (4, "日本"), (5, "a"), (6, "the and of " * 50_000), (None, "the and")]), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[4].lang_pred in model.langs and got[5].lang_pred in model.langs and got[6].lang_pred in model.langs and None in got
    empty = docs_of(spark, [(1, "a")]).limit(0)
    none = lang_id.fit(empty)
    assert lang_id.identify(empty, none).count() == 0
    assert lang_id.identify(docs_of(spark, [(1, "some words")]), none).first().lang_pred == "und"
    one = lang_id.fit(docs_of(spark, [(i, "same tongue here") for i in range(5)], "xx"))
    r = lang_id.identify(docs_of(spark, [(1, "anything")]), one).first()
    assert (r.lang_pred, r.score) == ("xx", 1.0)
    kept = lang_id.accepted(docs_of(spark, [(1, "the and of that"), (2, "123")]), model)
    assert kept.columns == docs_of(spark, [(1, "")]).columns and [r.doc_id for r in kept.collect()] == [1]


def test_language_id_learns_from_its_fold_only(spark, tmp_path):
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    words = {"xx": "lorem ipsum dolor sit amet".split(), "yy": "kato hundo birdo arbo domo".split()}
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lang = "xx" if i % 2 else "yy"
        rows.append((i, " ".join(rng.choices(words[lang], k=20)), "zz" if out(i) else lang, "s", 1))
    rows += [(500, "lorem lorem kato kato", None, "s", 1), (501, None, "xx", "s", 1), (None, "arbo domo", "qq", "s", 1)]
    table(spark, rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"xx", "yy", "und"}
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            assert r.lang_pred == ("xx" if r.doc_id % 2 else "yy") and r.held_out == out(r.doc_id)


# ---------------------------------------------------------------- 2


def brute_links(rows, limit=0.93):
    """Links of each row, and the smallest id that it reaches."""
    ok = {}
    for k, (i, v, lab) in enumerate(rows):
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float)
        ok[k] = x / np.linalg.norm(x)
    deg, up = Counter(), list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= limit:
                deg[a] += 1
                deg[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return deg, {k: low.get(find(k)) for k in range(len(rows))}


@pytest.mark.parametrize("cfg", [embed_dedup.EmbedConfig(), embed_dedup.EmbedConfig(window=16, block=8)])
def test_embedding_dedup(spark, cfg):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for size, noise in ((1, 0), (40, 0.04), (30, 0.12), (60, 0.2), (3, 0.0), (50, 3.0)):
        base = rng.normal(size=16)
        for _ in range(size):
            rows.append((n, [float(x) for x in np.float32(base + noise * rng.normal(size=16))], n % 2))
            n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, rows[5][1], None), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [1.0, 2.0], 0), (n + 6, [], 0)]
    df = table(spark, [(*r, 0, "z") for r in rows], "vec_id long, embedding array<float>, label int, row int, vec string")
    deg, root = brute_links(rows)
    got = embed_dedup.near_duplicates(df.repartition(3), cfg).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == root[r.vec_id] and r.n_links == deg[r.vec_id] and r.kept == (r.vec_id == r.component_id)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def told_apart(df, cfg=embed_dedup.EmbedConfig()):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, cfg).collect()), key=str)


def test_embedding_rows_and_labels(spark):
    kind = "vec_id long, embedding array<double>, label "
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.02], 1), (5, [0.0, 1.0], 2), (5, [0.0, 1.0], 2), (None, [1.0, 0.0], 1), (7, [0.93, math.sqrt(1 - 0.93**2)], 3), (8, [1e200, 0.0], 3), (9, [5e-300, 0.0], 4)]
    want = sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (5, 1, 5, True), (5, 1, 5, True), (None, 0, None, None), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True)], key=str)
    assert told_apart(table(spark, rows, kind + "int")) == want
    assert told_apart(table(spark, [(i, v, f"a{x}") for i, v, x in rows], kind + "string")) == want
    assert told_apart(table(spark, [(i, v, x / 10 + 1) for i, v, x in rows], kind + "double")) == want
    assert told_apart(table(spark, [(i, v, [x, None]) for i, v, x in rows], kind + "array<int>")) == want
    assert told_apart(table(spark, [(1, [1.0], -0.0), (2, [1.0], 0.0), (3, [1.0], 1.2), (4, [1.0], 1.7)], kind + "double")) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    long = [(i, np.random.default_rng(i // 2).normal(size=4000).tolist(), 1) for i in range(6)]
    assert [r[1:3] for r in told_apart(table(spark, long, kind + "int"))] == [(1, 0), (1, 0), (1, 2), (1, 2), (1, 4), (1, 4)]


def test_embedding_label_that_lies_close_together(spark):
    """Vectors with a common mean (cosine 0.8 with each other) and planted pairs just over the limit: sign planes through the origin would hardly part them."""
    rng = np.random.default_rng(2)
    n, d = 6000, 32
    mean = np.zeros(d)
    mean[0] = math.sqrt(0.8)
    x = rng.normal(size=(n, d - 1))
    x = np.hstack([np.full((n, 1), mean[0]), math.sqrt(0.2) * x / np.linalg.norm(x, axis=1, keepdims=True)])
    for a in range(0, 200, 2):  # the partner at cosine 0.935
        r, s = x[a, 1:] / math.sqrt(0.2), rng.normal(size=d - 1)
        s -= (s @ r) * r
        s /= np.linalg.norm(s)
        c = (0.935 - 0.8) / 0.2
        x[a + 1, 1:] = math.sqrt(0.2) * (c * r + math.sqrt(1 - c * c) * s)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    hit = x @ x.T >= 0.93
    np.fill_diagonal(hit, False)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, embed_dedup.EmbedConfig(passes_per_job=16)).collect()}
    assert [got[i] for i in range(n)] == hit.sum(1).tolist() and hit[0, 1]


def test_forest():
    rng = np.random.default_rng(0)
    for n in (1, 2, 9, 40):
        hit = rng.random((n, n)) < 1.5 / n
        hit |= hit.T
        np.fill_diagonal(hit, False)
        group = np.arange(n)
        edges = embed_dedup.forest(hit, group)
        reach = np.linalg.matrix_power((hit | np.eye(n, dtype=bool)).astype(float), n) > 0
        assert (reach == (group[:, None] == group[None])).all() and len(edges) == n - len(set(group.tolist())) and all(hit[a, b] for a, b in edges)


# ---------------------------------------------------------------- 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=600))
def test_elias_fano(values):
    v = sorted(values)
    code = token_store.EliasFano(token_store.ef_encode(np.array(v, np.uint64)))
    assert code.all().tolist() == v and [code.select(i) for i in range(0, len(v), 7)] == v[::7]


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(0).integers(1, 400, 10_000))
    assert len(token_store.ef_encode(v)) * 8 / len(v) < 2 + math.log2(v[-1] / len(v)) + 1.5


def test_token_round_trip(spark, tmp_path):
    tok = token_store.Encoder.of(queries.vocabulary())
    odd = ["", None, "It's 3.5 km!", "ÉTÉ naïve ﬁ", "日本語 текст", "a\x1cb\x85c", "x" * 5000, "Σας ΟΔΟΣ", "<|endoftext|> end", "é combining", "İstanbul", "''s 'S ’ll", "tab\tnew\nline"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(3, "again"), (None, "no id"), (-7, "first")]
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs_of(spark, rows), path, queries.vocabulary(), shard_tokens=64)
    got = sorted(token_store.read_store(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = tok.tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    shard = token_store.Shard(bytes(spark.read.parquet(path).orderBy("part", "seq").first().payload))
    assert shard.document(0).tolist() == got[0].ids
    token_store.write_store(docs_of(spark, rows).limit(0), path + "0", queries.vocabulary())
    assert token_store.read_store(spark, path + "0").count() == 0


_LATIN = st.text(st.characters(max_codepoint=0x24F), max_size=30)
_ANY = st.text(st.characters(exclude_categories=["Cs"]), max_size=30)
_NEAR = st.text("aAbB eE'sStTəƏƐɛƁĀāßẞİı’ \u0301<|>ǅǄŉſK3½²,.\x85\xa0\x1c ", max_size=30)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(_LATIN, _ANY, _NEAR), max_size=6))
def test_encoder_is_the_library(texts):
    enc = token_store.Encoder.of(queries.vocabulary())
    for t in [*texts, "Əli", "Ɛna", "Ɓala", "Ɔkɔ Ɖ Ɣ"]:
        assert enc(t).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_encoder_keeps_frequent_words(monkeypatch):
    """A full memory forgets the rare words only, and words given to the model in several calls have their own ids."""
    monkeypatch.setattr(token_store, "MEMO", 200)
    monkeypatch.setattr(token_store, "PIECES", 7, raising=False)
    enc = token_store.Encoder(queries.vocabulary())
    learn, learned = enc._learn, Counter()
    monkeypatch.setattr(enc, "_learn", lambda missing: (learned.update(missing), learn(missing)))
    rng = random.Random(5)
    often = ["the", "naïve", "it's", "3.5", "...", "été,"]
    for _ in range(40):
        texts = [" " + " ".join(often + ["".join(rng.choices("abcdefgé'7.", k=rng.randint(1, 9))) for _ in range(20)]) + end for end in ("", "\n", " it's")] + ["", "  "]
        for t, ids in zip(texts, enc.many(texts), strict=True):
            assert ids.tolist() == enc.tok.encode(t, add_special_tokens=False).ids
        assert len(enc.memo) < 500
    assert {w: learned[w] for w in often} == dict.fromkeys(often, 1)


def test_encoder_is_small():
    """Remembered words take tens of bytes each, as two workers share an executor's memory with its JVM."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(40_000)]
    enc = token_store.Encoder(queries.vocabulary())
    enc("a")
    gc.collect()
    tracemalloc.start()
    try:
        for lo in range(0, len(words), 4_000):
            enc(" ".join(words[lo : lo + 4_000]))
        gc.collect()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(enc.memo) >= len(set(words)) and held / len(words) < 100


def test_encoder_with_equal_hashes_and_long_words(monkeypatch):
    """Words are told apart by their bytes, not their hashes; long ones are not remembered for good."""
    texts = ["it's été the 3.5 end", "the end é the", " " + "long" * 40 + " the " + "é" * 33 + " ", "", " ", "x" * 64 + " " + "x" * 65]
    for hashes in (shared.word_hashes, lambda data, at, length: np.zeros(len(at), np.uint64), lambda data, at, length: length.astype(np.uint64)):
        monkeypatch.setattr(shared, "word_hashes", hashes)
        enc = token_store.Encoder(queries.vocabulary())
        for _ in range(3):
            assert [x.tolist() for x in enc.many(texts)] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.undo()
    monkeypatch.setattr(token_store, "MEMO_BYTES", 5_000, raising=False)
    enc = token_store.Encoder(queries.vocabulary())
    for i in range(50):
        t = f"{'long' * 1000}{i} short the"
        assert enc(t).tolist() == enc.tok.encode(t, add_special_tokens=False).ids
    assert enc.data.nbytes + enc.pool.nbytes < 40_000


def test_batches_to_workers_are_small(spark):
    """The setting is back afterwards, after an error too, and a smaller one of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for own, want in ((before, 7), ("3", 3), ("0", 7)):
        spark.conf.set(key, own)
        try:
            with pytest.raises(ZeroDivisionError), shared.arrow_rows(spark, 7):
                rows = spark.range(20, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
                assert max(r.n for r in rows) == want and sum(r.n for r in rows) == 20
                1 / 0
            assert spark.conf.get(key) == own
        finally:
            spark.conf.set(key, before)


# ---------------------------------------------------------------- 4


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), "en", rng.choice(["big"] * 12 + ["mid"] * 3 + ["small", None]), 0, "r", 1, 2, "z") for i in range(600)]
    rows += [(5, None, "en", "big", 0, "r", 1, 2, "z"), (6, "a b", "en", "big", 0, "r", 1, 2, "z"), (6, "a b", "en", "big", 0, "r", 1, 2, "z"), (None, "q", "en", "none", 0, "r", 1, 2, "z"), (900, "", "en", "void", 0, "r", 1, 2, "z")]
    docs = table(spark, rows, DOCS)
    for cfg in (mixing.MixConfig(bucket_rows=16), mixing.MixConfig(entropy=0.99, max_repeat=4.0, block_tokens=100), mixing.MixConfig(entropy=0.2)):
        got = mixing.mix(docs, cfg).toPandas()
        con = duckdb.connect()
        documents = docs.toArrow()  # noqa: F841
        want = con.execute(mixing.sql(cfg)).df()
        key = lambda d: sorted(tuple(map(str, r)) for r in d[sorted(d.columns)].fillna(-1).astype({"weight": float, "doc_id": int}).itertuples(index=False))
        assert key(got) == key(want)
        assert set(got.doc_id.dropna()) == {r[0] for r in rows if r[0] is not None}  # nothing is lost
        per = got.groupby("source").tokens.sum()
        n = Counter()
        for r in rows:
            n[r[3] or ""] += len((r[1] or "").split())
        assert all(per[s] <= n[s] * cfg.max_repeat + 31 and per[s] >= n[s] for s in n)
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() >= len(rows)


# ---------------------------------------------------------------- 5


def test_preference(spark):
    t = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good <|end|>"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, "user", "why"), (1, "rejected", 3, "assistant", "b2"), (2, "chosen", 0, None, None), (3, "rejected", 5, "assistant", "only"), (4, "chosen", 0, "user", "same"), (4, "rejected", 9, "user", "same"), (None, "chosen", 0, "user", "x"), (5, "chosen", None, "user", "tie"), (5, "chosen", None, "user", "tie")]
    df = table(spark, [(*r, 1, "z") for r in t], "pair_id long, side string, turn long, role string, text string, seq int, at string")
    for span in (1, 2, 256):
        seg = preference.format_pairs(df, span)
        got = {r.pair_id: r for r in preference.render(seg).collect()}
        assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].chosen == "<|assistant|>\ngood < |end|><|end|>\n"
        spans = [got[1].rejected[a:b] for a, b in got[1].rejected_spans]
        assert spans == ["bad<|end|>", "b2<|end|>"]
        assert got[2].chosen == "<|user|>\n<|end|>\n" and got[3].rejected.startswith("<|assistant|>\nonly") and got[3].prompt == ""
        assert got[4].prompt == "<|user|>\nsame<|end|>\n" and got[4].chosen == got[4].rejected == ""
        assert got[5].chosen.count("tie") == 2 and None not in got
    assert preference.format_pairs(df.limit(0)).count() == 0


def test_preference_agrees_with_sql(spark):
    """Null turns, roles and texts, ties, a conversation without numbered answers, marks in texts, very long turns."""
    rng = random.Random(8)
    rows = [(10, None, "assistant", "no number"), (10, None, "user", "none"), (11, 1, "assistant", "yes"), (11, None, None, None), (20, 1, "user", "q"), (20, 2, "assistant", None), (21, 1, "user", "q"), (21, 2, "assistant", "<|end|>"), (21, 2, "assistant", "<|a"), (30, 1, "assistant", "w" * 300_000), (31, 1, "assistant", "é" * 10), (None, 1, "user", "x"), (40, 5, "user", "alone")]
    for c in range(100, 130):
        for k in range(rng.randint(1, 700 if c < 103 else 8)):
            rows.append((c, rng.choice([k, k, k, None, 0]), rng.choice(["user", "assistant", None, "system"]), rng.choice(["a", "b", None, "long text <| here", "ü"])))
    df = table(spark, [(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, part string")
    got = preference.format_pairs(preference.neighbour_pairs(df.repartition(3)), span=16).toPandas()
    con = duckdb.connect()
    conversations = df.toArrow()  # noqa: F841
    want = con.execute(preference.SQL).df()
    key = lambda d: sorted(map(repr, d[sorted(want.columns)].itertuples(index=False, name=None)))
    assert len(got) == len(want) and key(got) == key(want)


# ---------------------------------------------------------------- 6


def greedy(word: bytes, first: set, inner: set):
    at, n = 0, 0
    while at < len(word):
        pool = first if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), max_size=12), st.lists(st.text("abc", min_size=1, max_size=4), max_size=12), st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=20))
def test_automaton(first, inner, words):
    f, i = {x.encode() for x in first}, {x.encode() for x in inner}
    data = " ".join(words).encode()
    arr = np.frombuffer(data, np.uint8)
    at, length, _ = shared.words(arr, np.array([0, len(arr)]), shared.PLAIN)
    auto = piece_counts.Automaton(sorted(f) + [b"##" + x for x in sorted(i)], b"##")
    total, known = auto.count(arr, at, length)
    want = [greedy(w.encode(), f, i) for w in words]
    assert known.tolist() == [w is not None for w in want] and total.tolist() == [w or 1 for w in want]
    total, known = piece_counts.Automaton(sorted(f)).count(arr, at, length)
    want = [greedy(w.encode(), f, f) for w in words]
    assert known.tolist() == [w is not None for w in want]


def test_piece_counts(spark):
    pieces = set(piece_counts.byte_level_pieces(queries.vocabulary()))
    texts = ["Hello, brave new WORLD!", None, "", "naïve " * 3000, "x" * 3000, "日本 3.5", "the" * 400_000, "ab" * 128 + " " + "ab" * 129]
    got = {r.doc_id: r for r in piece_counts.count_pieces(docs_of(spark, list(enumerate(texts))), queries.vocabulary()).collect()}
    for i, t in enumerate(texts):
        words = re.findall(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]", (t or "").lower().encode())
        if i != 6:
            assert (got[i].n_words, got[i].n_pieces) == (len(words), sum(greedy(w, pieces, pieces) for w in words))
    auto = piece_counts._automaton(queries.vocabulary(), None)
    short = np.frombuffer(b"the" * 80, np.uint8)  # the same word, short enough for the other way
    assert got[6].n_pieces == auto.count(short, np.array([0]), np.array([240]))[0][0] * 5000
    assert piece_counts.count_pieces(docs_of(spark, [(None, "a b"), (None, "a b")]), queries.vocabulary()).count() == 2
    assert piece_counts.count_pieces(docs_of(spark, [(1, "a")]).limit(0), queries.vocabulary()).count() == 0


# ---------------------------------------------------------------- 7


def test_decontamination(spark):
    item = "A train leaves the old station at 5 pm and drives 120 km to the north before it turns back after 5 hours of rest"
    other = "When the sun was low over the quiet harbour the boats came home and everyone gathered near the water to sing"
    items = table(spark, [(1, item, "a"), (2, other, "b"), (3, "too short", "c"), (4, None, "d"), (5, "seven plain words make one short item", "e")], "item_id int, text string, row_id string")
    pad = "lorem ipsum dolor sit amet " * 40
    texts = {
        1: pad + item + " " + pad,
        2: pad + item.replace("5", "8").replace("120", "300") + pad,  # consistent
        3: pad + item.replace("at 5", "at 8").replace("120", "300") + pad,  # 5 stands for 8 here and 5 there
        4: pad,
        5: None,
        6: "",
        7: " ".join(other.split()[:8]) + " " + pad,  # under the run
        8: " ".join(other.split()[2:18]) + " " + pad,
        9: "yes seven plain words make one short item indeed",
        10: "Too SHORT!",
        12: "not too short",
        11: " ".join("5 6 7 8".split() * 50),
    }
    docs = docs_of(spark, [*texts.items(), (1, texts[1]), (None, texts[2])])
    for cfg in (decontaminate.DecontamConfig(), decontaminate.DecontamConfig(broadcast_windows=0)):
        got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.find_leaks(docs, items, cfg).collect()}
        assert got == {(1, 1): True, (2, 1): False, (None, 1): False, (8, 2): True, (9, 5): True, (10, 3): True}
    left = decontaminate.clean_documents(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7, 11, 12] and left.columns == docs.columns
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_decontamination_compares_slots_of_matched_windows(spark):
    long = "every morning the baker puts 5 loaves into the oven and waits until the crust is brown before the shop opens its doors then 5 people wait outside in the cold and talk about the rain that fell all night"
    two = "a farmer sells 3 apples and 5 pears to the first person who walks into the little market today"
    units = "the tired runner needs 3 hours 5 minutes to reach the far end of the muddy winter trail"
    items = table(spark, [(1, long), (2, two), (3, units)], "item_id int, text string")
    pad = "lorem ipsum dolor sit amet " * 10
    quote = " ".join(long.split()[:20])
    texts = {
        1: pad + quote + " and so we lost 7 " + pad,  # 5 -> 7 only outside the run
        2: pad + two.replace("3", "4").replace("5", "4") + " " + pad,
        3: pad + units.replace("minutes", "hours") + " " + pad,
        4: pad + two.replace("3", "x") + " " + pad,
        5: pad + long.replace("5 people", "8 people") + " " + pad,  # both windows match, 5 -> 5 and 5 -> 8
    }
    # the item's second 5 stands over the 7
    assert texts[1].split().index("7") - len(pad.split()) == long.split().index("5", 6)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs_of(spark, list(texts.items())), items).collect()}
    assert {k: r.verbatim for k, r in got.items()} == {(1, 1): True, (2, 2): False, (3, 3): False, (4, 2): True}
    assert got[1, 1].aligned == 20


def test_decontamination_of_names_at_sentence_starts(spark):
    item = "Alice has 3 apples. Bob gives Alice 5 apples. How many apples does Alice have?"
    quoted = '"Maria" walked to the old mill near the river and sold 12 eggs to the miller before noon'
    items = table(spark, [(1, item), (2, quoted)], "item_id int, text string")
    texts = {
        1: "Carol has 4 apples. David gives Carol 7 apples. How many apples does Carol have?",
        2: item.lower(),
        3: "Carol has 4 apples. David gives Erin 7 apples. How many apples does Carol have?",  # Alice is two people
        4: item,
        5: "Then (Petra) walked to the old mill near the river and sold 15 eggs to the miller before noon",
        6: "Some Other Words Stand Here In Capital Letters And Tell Of Nothing At All",
        7: "Later: " + quoted.replace("12", "9").replace("Maria", "Olga"),
    }
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.find_leaks(docs_of(spark, list(texts.items())), items).collect()}
    assert got == {(1, 1): False, (2, 1): True, (4, 1): True, (5, 2): False, (7, 2): False}


def test_decontamination_agrees_with_sql(spark):
    """Against DuckDB's lists of words: random texts of few words with names, numbers and units, items of all lengths, repeats, and pages of nothing but slots."""
    rng = random.Random(12)
    pool = "the a old mill river sold eggs Anna Ben Carla Dora Émile 3 5 12 7.5 km hours Minutes and to noon she It when".split()
    say = lambda n: " ".join(w + rng.choice(["", "", ",", ". ", "!"]) for w in rng.choices(pool, k=n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 12, 13, 14, 20, 33, 60] * 2)] + [(90, "5 6 7 8 9 1 2 3 4 5 6 7 8 9"), (91, None), (92, ""), (0, "Is it 5?")]
    swap = {"Anna": "Vera", "Ben": "Otto", "3": "4", "5": "9", "12": "40"}
    docs = []
    for i in range(160):
        text = rng.choice(items[:28])[1]
        kind = i % 5
        if kind == 1:
            text = text.lower()
        elif kind == 2:
            text = re.sub(r"\w+", lambda m: swap.get(m[0], m[0]), text)
        elif kind == 3:
            w = text.split()
            text = " ".join(w[rng.randint(0, 3) : len(w) - rng.randint(0, 3)])
        docs.append((i, text if kind == 4 else f"{say(rng.randint(0, 30))} {text} {say(rng.randint(0, 30))}"))
    docs += [(200, items[13][1]), (200, items[13][1]), (None, "x " + items[13][1]), (201, None), (202, ""), (203, "5 6 7 8 " * 400), (204, "it is 5"), (205, "IS it 5"), (206, "Anna Ben " * 300)]
    d, b = docs_of(spark, docs).select("doc_id", "text", "lang", "n"), table(spark, items, "item_id int, text string")
    con = duckdb.connect()
    documents, benchmark = d.toArrow(), b.toArrow()  # noqa: F841
    want = con.execute(decontaminate.sql()).df()
    for cfg in (decontaminate.DecontamConfig(), decontaminate.DecontamConfig(broadcast_windows=0)):
        got = decontaminate.find_leaks(d, b, cfg).drop("row_id").toPandas()
        key = lambda x: sorted(map(repr, x[sorted(want.columns)].astype(str).replace({"nan": "None", "<NA>": "None"}).itertuples(index=False, name=None)))
        assert len(got) > 60 and [x.replace(".0'", "'") for x in key(got)] == [x.replace(".0'", "'") for x in key(want)]


def test_decontamination_of_a_page_of_numbers(spark):
    """The work is linear in a text, whatever repeats in it."""
    items = table(spark, [(1, " ".join(str(i) for i in range(40))), (2, "x 5 " * 20), (3, "one plain question that nobody would ever ask of a page of numbers like this one")], "item_id int, text string")
    docs = docs_of(spark, [(1, " ".join(str(i % 97) for i in range(20_000))), (2, "x 7 " * 3000), (3, "y 7 " * 3000)])
    start = time.time()
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(2, 2, False)} and time.time() - start < 120


# ---------------------------------------------------------------- 8


def test_toxicity(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 3 == 0
        if bad:
            for x in rng.sample(["vilebug", "rottenly", "nastyish"], 2):
                w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), 0))
    docs = docs_of(spark, [*rows, (1000, None), (1001, "")])
    lab = table(spark, labels, "doc_id long, toxic int, text int")
    train = lab.filter("doc_id < 600").select("doc_id", "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, train)).collect()}
    assert len(got) == 902 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    right = [got[i].predicted == y for i, y, _ in labels if i >= 600]
    assert sum(right) / len(right) > 0.95
    one = toxicity.fit(docs, train.filter("toxic = 0"))
    assert all(r.score == 0 for r in toxicity.score(docs, one).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), train.limit(0))).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Nothing is left out beyond 5,000 rows: all come to the training, each in one chunk, and the model finds what it learned."""
    rng = random.Random(5)
    rows = [(i, f"w{i} " + " ".join(rng.choices("alpha beta gamma delta omega".split(), k=6)) + " vilebug" * (i % 2)) for i in range(7000)]
    docs = docs_of(spark, rows)
    seen = []
    real = toxicity.train

    def train(load, chunks, counts, langs, cfg):
        seen.append((chunks, sum(counts.values()), sum(len(load(i, False)[0]) for i in range(chunks)), sum(len(load(i, True)[0]) for i in range(chunks)), sum(n for (_, checked), n in counts.items() if checked)))
        return real(load, chunks, counts, langs, cfg)

    monkeypatch.setattr(toxicity, "train", train)
    model = toxicity.fit(docs, table(spark, [(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    ((chunks, counted, loaded, checked, kept),) = seen
    assert chunks == 2 and counted == loaded == 7000 and 1000 < checked == kept < 1800
    assert sum(r.predicted == r.doc_id % 2 for r in toxicity.score(docs, model).collect()) > 6900


def test_toxicity_learns_from_its_fold_only(spark, tmp_path):
    """Labels of held-out rows may say anything: no score changes. Null labels, ids and texts, repeated and very long rows."""
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("alpha beta gamma delta omega".split(), k=12) + ["vilebug"] * (i % 3 == 0)), "en", "s", 1) for i in range(300)]
    rows += [(300, None, "en", "s", 1), (301, "", None, None, 1), (302, "vilebug " + "alpha beta " * 60_000, "en", "s", 1), (5, rows[5][1], "en", "s", 1), (None, "alpha vilebug", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    seen = []
    for flip in (False, True):
        at = f"{tmp_path}/{flip}"
        table(spark, rows, schema).coalesce(1).write.parquet(f"{at}/documents.parquet")
        labels = [(i, 1, int(i % 3 == 0) ^ int(flip and out(i))) for i in range(300)] + [(None, 1, 1), (4, 0, None)]
        table(spark, labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
        got = queries.op8_toxicity(spark, at).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        assert all(r.held_out == out(r.doc_id) for r in got if r.doc_id is not None)
        seen.append(sorted((str(r.doc_id), round(r.score, 9)) for r in got))
        assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 300) >= 297
    assert seen[0] == seen[1]


# ---------------------------------------------------------------- 9


def test_lm_scoring(spark):
    texts = [(1, "the cat sat on the mat", True), (2, "the dog sat", True), (3, "zzz qqq", False), (4, None, True), (5, "", False), (6, "the cat", None), (7, "Ünïcode the", False)]
    cfg = lm_score.LmConfig(order=3)
    df = table(spark, [(*t, 1) for t in texts], "doc_id long, text string, good boolean, k int")
    model = lm_score.fit(df, "good", cfg)
    got = {r.doc_id: r for r in lm_score.score(df, model).collect()}
    raw = {i: (t or "").lower().encode() for i, t, _ in texts}
    losses = {}
    for name, chosen in (("t", [i for i, _, g in texts if g]), ("b", list(raw))):
        n = [Counter() for _ in range(4)]
        for i in chosen:
            s = bytes(2) + raw[i]
            for k in range(1, 4):
                for e in range(2, len(s)):
                    n[k][s[e - k + 1 : e + 1]] += 1
        follow = [Counter() for _ in range(4)]  # how often a context was followed by a byte
        for k in range(1, 4):
            for gram, times in n[k].items():
                follow[k][gram[:-1]] += times
        scale = sum(len(raw[i]) for i, _, g in texts if g) / sum(len(raw[i]) for i in chosen)
        total = sum(len(raw[i]) for i in chosen) * scale
        for i, s0 in raw.items():
            s, loss = bytes(2) + s0, 0.0
            for e in range(2, len(s)):
                p = 1 / 256
                for k in range(1, 4):
                    c = n[k][s[e - k + 1 : e + 1]] * scale
                    ctx = total if k == 1 else follow[k][s[e - k + 1 : e]] * scale
                    p = (c + cfg.prior * p) / (ctx + cfg.prior)
                loss -= math.log(p)
            losses[name, i] = loss / max(1, len(s0))
    for i in raw:
        assert got[i].n_tokens == len(raw[i])
        assert abs(got[i].loss_target - losses["t", i]) < 2e-3 and abs(got[i].score - (losses["b", i] - losses["t", i])) < 4e-3
    assert got[1].score > got[3].score and got[4].score == 0
    assert lm_score.score(df.limit(0), lm_score.fit(df.limit(0), "good", cfg)).count() == 0


def test_lm_scoring_odd_rows(spark):
    """Null ids, repeated rows, a very long text beside many empty ones, and probabilities that sum to one."""
    long = "the cat sat on the mat " * 40_000
    rows = [(None, "the cat", True), (None, None, True), (1, "the cat", False), (1, "the cat", False), (2, long, True), *[(10 + i, "", False) for i in range(50)], (3, "zzz", None)]
    df = table(spark, rows, "doc_id long, text string, good boolean").repartition(3)
    cfg = lm_score.LmConfig(order=3, part_bytes=4000)
    model = lm_score.fit(df, "good", cfg)
    got = lm_score.score(df, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    same = {(r.n_tokens, round(r.score, 12)) for r in got if r.n_tokens == 7}
    assert len(same) == 1 and all(r.score == 0 for r in got if r.n_tokens == 0) and next(r for r in got if r.doc_id == 2).n_tokens == len(long)
    counts = {r.gram: (r.target, r.background, r.target_end, r.background_end) for r in model.counts.collect()}
    key = np.array(sorted(counts))
    n = np.array([counts[k] for k in key.tolist()])
    for context in (b"th", b" c", b"zz", b"at", b"\0t", b"\0\0"):  # also such as end and begin texts
        grams = np.array([context[0] << 16 | context[1] << 8 | b for b in range(256)], np.int64)
        p = np.exp(-lm_score.losses(grams, key, n, model.totals, cfg, model.texts if context == b"\0\0" else None))
        assert np.allclose(p.sum(0), 1)


def test_lm_scoring_counts_every_ngram_apart(spark):
    """More distinct 5-grams than 2^20: each has its own count, whatever the size of the corpus."""
    rng = np.random.default_rng(4)
    rows = [(i, "".join(map(chr, rng.integers(33, 127, 100_000))), i % 2 == 0) for i in range(12)] + [(50, "\0\0\0\0\0ab", True)]
    df = table(spark, rows, "doc_id long, text string, good boolean").repartition(3)
    model = lm_score.fit(df, "good")
    want = Counter()
    for _, t, _ in rows:
        s = bytes(4) + t.lower().encode()
        want.update(s[i : i + 5] for i in range(len(s) - 4))
    longest = model.counts.filter(F.shiftright("gram", 56) == 5)
    assert len(want) > 1 << 20 and longest.count() == len(want) and longest.agg(F.max("background")).first()[0] == max(want.values())
    assert longest.filter("background > 1").count() == sum(n > 1 for n in want.values())
    some = df.filter("doc_id in (1, 2, 50)")
    one = lm_score.score(some, model).collect()
    many = lm_score.score(some, lm_score.LmModel(model.counts, model.totals, model.texts, lm_score.LmConfig(part_bytes=150_000))).collect()
    key = lambda rs: {r.doc_id: (r.n_tokens, round(r.loss_target, 9), round(r.score, 9)) for r in rs}
    assert key(one) == key(many) and len(one) == 3


# ---------------------------------------------------------------- 10


def shingle_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k,percent,chunk", [(4, 85, 512), (5, 80, 3), (2, 60, 4)])
def test_jaccard_join(spark, k, percent, chunk):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    boiler = " ".join(rng.choices(vocab, k=30))
    texts = []
    for size in (3, 5, 8, 13, 20, 40, 90, 200, 600):
        for _ in range(3):
            base = rng.choices(vocab, k=size)
            for _ in range(rng.randint(1, 7)):
                w = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                texts.append(" ".join(w))
    texts += [boiler + " " + " ".join(rng.choices(vocab, k=rng.randint(1, 40))) for _ in range(60)]
    base = rng.choices(vocab, k=120)
    for _ in range(40):  # a loose group: most pairs do not link
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += ["", None, "  ", "one", "ONE", "One two", "Été", "été", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = docs_of(spark, [*rows, (7, texts[7]), (None, texts[3])]).repartition(3)
    got = jaccard_join.near_duplicates(docs, jaccard_join.JaccardConfig(shingle=k, percent=percent, chunk=chunk)).collect()
    assert len(got) == len(rows) + 2
    sets = {i: shingle_set(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == len(sets[3])
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    tmp = shared.Scratch(spark, "test")
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(501, 520)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)] + [(3, 3), (None, 4)]
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long"), tmp).collect()}
    assert got == {a: find(a) for a in up}


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(20)]
    got = jaccard_join.shared_counts(sets[:9], sets[9:], columns=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[9:]] for a in sets[:9]]


def test_same_words(spark):
    text = "A, b\tc\x0bd\xa0e"
    raw = np.frombuffer(text.encode(), np.uint8)
    at, n, doc = shared.words(raw, np.array([0, len(raw)]), shared.UNSPACED)
    assert [bytes(raw[a : a + k]).decode() for a, k in zip(at, n, strict=True)] == ["A,", "b", "c", "d\xa0e"] and not doc.any()
