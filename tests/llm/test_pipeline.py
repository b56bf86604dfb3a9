"""Each stage on its predecessor's rows, held against brute force."""

import corpus_pipeline
from test_operators import shingle_set

from kinfold.llm import queries, token_store


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{name}")
        out = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "token_output":
            assert out.columns == columns
        kept.append((docs.toPandas(), out.toPandas()))
        docs = out
    (before, after) = kept[0]
    assert set(after.doc_id) <= set(before.doc_id) and len(after) >= 0.97 * len(before)
    before, after = kept[1]
    sets = {r.doc_id: shingle_set(r.text, 5) for r in before.itertuples()}
    left = sorted(after.doc_id)
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for i, a in enumerate(left) for b in left[i + 1 :])
    for gone in set(before.doc_id) - set(left):
        assert any(x != gone and 100 * len(sets[gone] & sets[x]) >= 80 * len(sets[gone] | sets[x]) for x in sets)
    before, after = kept[2]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = set(before.doc_id) - set(after.doc_id)
    holding = {r.doc_id for r in before.itertuples() if any(b in r.text for b in bench)}
    assert holding <= gone and len(gone - holding) <= 0.02 * len(before) + 2
    before, after = kept[3]
    assert set(after.doc_id) == set(before.doc_id)
    mixed, out = kept[4]
    enc = token_store.Encoder.of(queries.vocabulary())
    want = sorted((r.doc_id, len(enc.tok.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in mixed.itertuples())
    assert sorted(zip(out.doc_id, out.n_tokens, strict=True)) == want
    ordered = out.sort_values("start")
    assert ordered.doc_id.is_monotonic_increasing and (ordered.start.diff().dropna().to_numpy() == ordered.n_tokens.to_numpy()[:-1]).all()


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, clashing columns, an empty table."""
    import random

    rng = random.Random(3)
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, row_id string, rank int, component_id long, epoch string, _row string"
    langs = {"xx": "lorem ipsum dolor sit amet elit sed do".split(), "yy": "kato hundo birdo arbo domo luno sola maro".split()}
    odd = ("i", 1, "r", 2, 3, "e", "x")
    say = lambda lang, n: " ".join(rng.choices(langs[lang], k=n))
    rows = [(i, say("xx" if i % 2 else "yy", 40), "xx" if i % 2 else "yy", f"s{i % 3}", 1) for i in range(60)]
    long = say("xx", 60_000)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows += [(100, rows[1][1], "xx", "s1", 1), (7, rows[1][1], None, None, None), (8, "quite another text of lorem ipsum " + say("xx", 30), "xx", "s2", 1), (8, "quite another text of kato hundo " + say("yy", 30), "yy", "s2", 1)]
    rows += [(101, None, "xx", "s1", 1), (102, "", None, None, 1), (103, "123 !!", "xx", "s1", 1), (None, say("yy", 40), "yy", None, 1), (None, rows[3][1], "xx", "s1", 1), (104, long, "xx", "s0", 1), (105, long + " end", "xx", "s0", 1), (106, say("xx", 20) + " " + bench, "xx", "s0", 1)]
    rows += [rows[5], rows[5]]
    docs = spark.createDataFrame([(*r, *odd[1:2], "r", 2, 3, "e", "x") for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0
        if name != "token_output":
            assert none.columns == docs.columns
        out = stage(spark, docs, sf)
        if name == "token_output":
            ids = [r.doc_id for r in out.orderBy("start").collect()]
            assert ids == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
            continue
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        left = [(r.doc_id, r.text) for r in out.collect()]
        every = [r[:2] for r in rows]
        if name == "language_id":
            assert set(every) - set(left) == {(101, None), (102, ""), (103, "123 !!")}
        elif name == "near_duplicates":
            gone = set(every) - set(left)
            assert gone == {(100, rows[1][1]), (7, rows[1][1]), (None, rows[3][1]), (105, long + " end")} and left.count(rows[5][:2]) == 1
            assert sum(i == 8 for i, _ in left) == 3  # three texts under one id, none like another
        elif name == "decontaminate":
            assert {i for i, _ in set(every) - set(left)} == {106} and len(left) == len(every) - 1
        else:
            assert set(left) == set(every)
