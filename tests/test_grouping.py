import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import similarity
from kinfold.operators import grouping


def files(spark, sigs):
    return spark.createDataFrame([(p, "image", s) for p, s in sigs.items()], "path string, category string, signature string")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group_path, []).append(r.path)
    return sorted(sorted(v) for v in out.values())


def test_exact(spark):
    f = files(spark, {"a": "h1", "b": "h1", "c": "h2", "d": "h2", "e": "h3", "f": None})
    got = grouping.exact_groups(f).collect()
    assert sorted((r.first_path, r.n_files, r.similarity) for r in got) == [("a", 2, 1.0), ("c", 2, 1.0)]
    assert groups(grouping.exact_members(f)) == [["a", "b"], ["c", "d"]]
    assert grouping.exact_groups(f.limit(0)).count() == 0


def fuzzy(spark, sigs, sims, threshold, length):
    table = spark.createDataFrame([(min(a, b), max(a, b), s) for (a, b), s in sims.items()] or [("", "", 0.0)], "x string, y string, s double")
    pairs = grouping.candidate_pairs(files(spark, sigs), length=length)
    known = pairs.join(table, (F.col("path_a") == F.col("x")) & (F.col("path_b") == F.col("y")), "left")
    s = F.when(F.col("signature_a") == F.col("signature_b"), 1.0).otherwise(F.coalesce("s", F.lit(0.0)))
    return groups(grouping.strict_groups(grouping.similar_pairs(known, s, threshold)))


def test_fuzzy_cases(spark):
    assert fuzzy(spark, {"a": "p1"}, {}, 0.9, 1) == []
    assert fuzzy(spark, {"a": "sx", "b": "sx"}, {}, 0.9, 2) == [["a", "b"]]
    four = {"a": "pa", "b": "pb", "c": "pc", "d": "pd"}
    assert fuzzy(spark, four, {("a", "b"): 0.95, ("c", "d"): 0.95}, 0.9, 1) == [["a", "b"], ["c", "d"]]
    assert fuzzy(spark, four, {("a", "b"): 0.95, ("b", "c"): 0.95, ("a", "c"): 0.5}, 0.9, 1) == [["a", "b"]]
    assert fuzzy(spark, {"a": "pa", "b": "pb"}, {("a", "b"): 0.5}, 0.9, 1) == []
    assert fuzzy(spark, {"a": "xa", "b": "yb"}, {("a", "b"): 1.0}, 0.9, 1) == []  # prefixes differ


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 8), st.data())
def test_strict_properties(n, data):
    names = [f"f{i}" for i in range(n)]
    sims = {p: data.draw(st.sampled_from([0.0, 0.9, 0.95, 1.0])) for p in itertools.combinations(names, 2)}
    similar = [(a, b, s) for (a, b), s in sims.items() if s >= 0.9]
    got = grouping.merge_strictly(similar)
    seen = [x for g, _ in got for x in g]
    assert len(seen) == len(set(seen))
    ok = {frozenset(p[:2]) for p in similar}
    for g, least in got:
        assert len(g) >= 2 and all(frozenset(p) in ok for p in itertools.combinations(g, 2))
        assert least == min(sims[min(p), max(p)] for p in itertools.combinations(g, 2))
    clusters = [g for g, _ in got] + [[x] for x in names if x not in seen]
    for x, y in itertools.combinations(clusters, 2):
        assert not all(frozenset((a, b)) in ok for a in x for b in y)


def test_dice(spark):
    f = spark.createDataFrame([("a", "document", "night shift"), ("b", "document", "night shifts"), ("c", "document", "night shift"), ("d", "document", "x")], "path string, category string, t string")
    got = {(r.path_a, r.path_b): r.similarity for r in grouping.dice_pairs(f, "t", 0.8).collect()}
    assert set(got) == {("a", "b")} and abs(got["a", "b"] - 2 * 9 / 19) < 1e-12


def dice(x, y):
    a, b = ("".join(t.split()) for t in (x, y))
    p, q = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return 2.0 * (p & q).total() / max(1, p.total() + q.total())


@pytest.mark.parametrize("more", [{}, {"rows": 7, "bigrams": 400}])
def test_dice_against_brute_force(spark, more):
    """Whole blocks and many parts of bands give the same: copies, other scripts, white space, texts of one character, counts over 255, lengths at the limit."""
    rng = random.Random(6)
    base = ["the opening " + "".join(rng.choices("abcdefg \u3000\u00e9\u4e2d\U0001f600", k=k)) for k in (20, 60, 200) for _ in range(4)]
    texts = ["the opening " + "ab" * k for k in (1, 9, 10, 11, 12, 300, 320, 360)] + ["x", "x y", "the open", "the opening", "the opening", "the  opening", "other " * 4]
    for _ in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(11, len(t))] = rng.choice("abz")
        texts.append("".join(t))
    texts += rng.sample(texts, 20)
    rows = [(f"p{i:03d}", "document", t) for i, t in enumerate(texts)]
    got = grouping.dice_pairs(spark.createDataFrame([*rows, ("n", "document", None), ("o", "other", texts[0])], "path string, category string, t string"), "t", 0.9, **more).collect()
    first = {}
    for p, _, t in rows:
        first.setdefault(t, p)
    want = {(min(p, q), max(p, q)): s for (x, p), (y, q) in itertools.combinations(first.items(), 2) if x[:8] == y[:8] and (s := dice(x, y)) >= 0.9}
    assert len(got) == len(want) > 100 and {(r.path_a, r.path_b): r.similarity for r in got} == want


def test_dice_sends_no_bigrams_of_pairs(spark):
    """What crosses the network follows the texts, not their pairs."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    rows = [(f"p{i}", "document", "same start " + " ".join(rng.choices(words, k=150))) for i in range(250)]
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: store.executorList(True).apply(0).totalShuffleWrite()
    before = moved()
    assert grouping.dice_pairs(spark.createDataFrame(rows, "path string, category string, t string"), "t", 0.5).count() > 1000
    assert moved() - before < 2 * sum(len(t) for _, _, t in rows)


def test_signature_parsing(spark):
    import base64

    h = "|".join(base64.b64encode(bytes([i] * 18)).decode() for i in (0, 1, 255))
    df = spark.createDataFrame([(h,), ("",), ("a|b",), ("x|y|z!",), (None,)], "s string")
    assert [r[0] for r in df.select(similarity.parse_image_signature(F.col("s")).isNotNull()).collect()] == [True, False, False, False, False]
    from kinfold.plans.detectors import image_hash_similarity

    near = h[:-4] + base64.b64encode(bytes([255, 255, 254])).decode()
    two = spark.createDataFrame([(h, h), (h, near), (h, "bad")], "a string, b string")
    got = [r[0] for r in two.select(image_hash_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and abs(got[1] - (1 - 1 / 144)) < 1e-9 and got[2] == 0.0


def test_video_signature(spark):
    js = '{"hash":[0,1],"src_path":"/tmp/t.mp4","duration":0}'
    other = '{"hash":[7,1],"src_path":"/tmp/u.mp4","duration":0}'
    from kinfold.plans.scan import video_hash_similarity

    df = spark.createDataFrame([(js, js), (js, other), (js, "not json")], "a string, b string")
    assert [r[0] for r in df.select(video_hash_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1 - 3 / 64, 0.0]
