import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import formats, text
from kinfold.plans import detectors
from kinfold.plans.scan import ScanConfig, scan, scan_summary
from kinfold.sources import extract, files, images
from kinfold.sources.models import Settings, prototypes_ok
from kinfold.sources.store import SessionStore
from kinfold.streaming import incremental


def png(w, h, value=0):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes([value, value, value]) * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed, noise=0, w=64, h=64):
    """A PNG of smooth random shapes; ``noise`` changes some pixels a little."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rng = np.random.default_rng(seed)
    small = rng.integers(0, 256, (8, 8, 3))
    x = np.kron(small, np.ones((h // 8, w // 8, 1))).astype(int)
    if noise:
        x = (x + np.random.default_rng(seed + 1000).integers(-noise, noise + 1, x.shape)).clip(0, 255)
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in x)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 0)) + chunk(b"IEND", b"")


def make(root, tree):
    for name, content in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)


def test_scan_rules(spark, tmp_path):
    make(tmp_path, {"test.txt": b"hello world", "test.png": bytes(2048), "B.PNG": bytes(2048), "tiny.png": bytes(16), "node_modules/x.png": bytes(2048), "sub/c.jpg": bytes(4096), ".hid/d.png": bytes(2048), "noext": b"x" * 2000})
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(files.read_files(spark, [str(tmp_path)], True, ["image"], 1024)) == ["B.PNG", "c.jpg", "test.png"]
    assert names(files.read_files(spark, [str(tmp_path), str(tmp_path / "sub")], True, ["image"], 1024)) == ["B.PNG", "c.jpg", "test.png"]
    walked = files.walk(spark, [str(tmp_path)])
    assert names(walked) == ["B.PNG", "c.jpg", "d.png", "noext", "test.png", "test.txt", "tiny.png"]
    status = {r.name: r.status for r in files.classify_status(walked, ["image"], 1024).collect()}
    assert status["tiny.png"] == "skipped_other" and status["test.txt"] == "unselected" and status["noext"] == "no_extension" and status["d.png"] == "found"
    assert names(files.walk(spark, [str(tmp_path)], recursive=False)) == ["B.PNG", "noext", "test.png", "test.txt", "tiny.png"]


def zipped(name, body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, body)
    return out.getvalue()


def test_packed_documents():
    w = '<w:document xmlns:w="u"><w:p><w:r><w:t>Hello</w:t><w:t> you</w:t></w:r></w:p><w:p><w:t>Bye</w:t></w:p></w:document>'
    assert extract.docx_text(zipped("word/document.xml", w)) == "Hello you\nBye\n"
    assert extract.docx_text(b"\xd0\xcf\x11\xe0binary") is None
    assert extract.docx_text(zipped("word/document.xml", '<w:document xmlns:w="u"><w:p> </w:p></w:document>')) is None
    o = '<o:doc xmlns:o="u"><o:h>Head</o:h><o:p>One <o:span>two</o:span> three</o:p></o:doc>'
    assert extract.odt_text(zipped("content.xml", o)) == "One two three\n"
    deep = '<w:d xmlns:w="u">' + "<w:x>" * 3000 + "<w:t>far down</w:t>" + "</w:x>" * 3000 + "</w:d>"
    assert extract.docx_text(zipped("word/document.xml", deep)) == "far down"
    assert extract.docx_text(zipped("word/document.xml", w[: w.index("</w:t>")])) == "Hello"  # XML that breaks off keeps what came before


def test_image_facts():
    assert extract.dimensions(png(3, 5)) == (3, 5)
    assert extract.dimensions(b"nope") is None
    sides = struct.pack("<H", 2) + struct.pack("<HHIHH", 0x0100, 3, 1, 640, 0) + struct.pack("<HHII", 0x0101, 4, 1, 480)
    assert extract.dimensions(b"II*\x00" + struct.pack("<I", 8) + sides) == (640, 480)
    tiff = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHI4s", 0x010F, 2, 3, b"ab\0\0") + b"\0\0\0\0"
    assert extract.has_camera_data(tiff) and not extract.has_camera_data(png(1, 1))
    scan_tag = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0131, 2, 9, 26) + b"\0\0\0\0" + b"MyScanner"
    assert extract.has_camera_data(scan_tag)
    rgb = np.zeros((60, 60, 3), np.uint8)
    assert images.structure(rgb) == (0.0, 0.0)
    assert images.structure(np.full((1, 1, 3), 255, np.uint8))[1] == 0.0
    rgb[:, 30:] = 255
    a, b = images.hashes(rgb), images.hashes(np.roll(rgb, 1, axis=1))
    assert all(len(x) == 18 for x in a) and a[0] == images.hashes(rgb)[0]
    assert images.preprocess(rgb).shape == (1, 3, 224, 224) and b is not None


def test_mime(spark):
    df = spark.createDataFrame([(bytearray(png(1, 1)), "txt"), (bytearray(b"plain"), "TXT"), (bytearray(b"??"), None)], "c binary, e string")
    assert [r[0] for r in df.select(extract.mime_type(F.col("c"), F.col("e"))).collect()] == ["image/png", "text/plain", None]


def test_text_rules(spark):
    rows = [("  a b \n c d e f  ",), ("short",), (None,), ("# c\n  x = 1\n\n// d\n/* e\ny\n",), ("#a\n//b",)]
    df = spark.createDataFrame(rows, "t string").select(text.normal_text(F.col("t")).alias("n"), text.normal_code(F.col("t")).alias("c"))
    got = df.collect()
    assert got[0].n == "a b c d e f" and got[1].n is None and got[2].n is None
    assert got[3].c == "x = 1 y" and got[4].c is None and got[2].c is None
    bad = spark.createDataFrame([(bytearray(b"ab\xffcd"),)], "c binary").select(text.decoded(F.col("c"))).first()[0]
    assert bad == "ab�cd"


def test_format_lines(spark):
    df = spark.createDataFrame([(1, 2_500_000)], "i long, n long")
    line = df.select(formats.session_line(F.lit(2), F.lit("pending"), F.lit("2024-01-01 00:00:00"), F.lit("Code review")), formats.group_line(F.col("i"), F.lit("image"), F.lit(0.97)), formats.megabytes(F.col("n")), formats.binary_size(F.lit(1280)), formats.duration(F.lit(3723.9), " ")).first()
    assert line[0].startswith("2      pending      2024") and line[0].endswith("Code review")
    assert list(line)[1:] == ["Group 1 [image] - 97.0% similar", "2.38 MB", "1.2 KB", "1h 02m 03s"]


def test_store_and_scan(spark, tmp_path):
    body = b"some text that is long enough " * 50
    make(tmp_path / "in", {"a.txt": body, "b.txt": body.replace(b" ", b"  "), "c.txt": body + b"!", "d.zip": b"P" * 2000, "e.zip": b"P" * 2000, "i.png": png(40, 40, 200), "j.png": png(40, 40, 200) + b"\0" * 3000, "k.png": png(40, 40, 201) + b"\0" * 3000})
    store = SessionStore(spark, f"file://{tmp_path}/store")
    sid = scan(spark, [str(tmp_path / "in")], store, ScanConfig(name="first"))
    assert store.session(sid).status == "completed" and store.session(sid).completed_at
    got = {}
    for r in store.session_entries(sid).collect():
        got.setdefault(r.group_id, []).append(r.file_path.rsplit("/", 1)[-1])
    assert ["a.txt", "b.txt"] in [sorted(v) for v in got.values()] and ["d.zip", "e.zip"] in [sorted(v) for v in got.values()]
    assert store.read("signature_cache").groupBy("category").count().rdd.collectAsMap() == {"document": 3, "archive": 2, "image": 2}
    n = store.read("duplicate_groups").count()
    scan(spark, [str(tmp_path / "in")], store, ScanConfig(), session=sid)  # a merge appends
    assert store.read("duplicate_groups").count() == 2 * n and store.read("signature_cache").count() == 7
    split = incremental.split_by_cache(incremental.keyed(files.listed(spark, [str(tmp_path / "in")], True, ["document"]).filter("status = 'found'")), store.read("signature_cache"))
    assert incremental.hit_counts(split).first().asDict() == {"cached": 3, "computed": 0}
    store.vacuum()
    other = store.create_session("second", ["code"], 0.9)
    assert [r.id for r in store.sessions().collect()][0] == other
    store.delete_session(sid)
    assert store.read("file_entries").count() == 0 and store.read("scan_sessions").count() == 1
    assert store.clear_sessions() == 1


def grouped(store, session):
    got = {}
    for r in store.session_entries(session).collect():
        got.setdefault(r.group_id, set()).add(r.file_path.rsplit("/", 1)[-1])
    return sorted(map(sorted, got.values()))


def test_scan_of_images(spark, tmp_path, monkeypatch):
    """Equal, near and odd-named pictures; a second scan opens nothing, a third only what changed."""
    make(tmp_path / "in", {"a.png": picture(1), "b c+d%.png": picture(1), ".hidden.png": picture(1), "near.png": picture(1, 1), "far.png": picture(2), "node_modules/x.png": picture(1), "tiny.png": png(2, 2), "broken.png": b"x" * 5000})
    store = SessionStore(spark, f"file://{tmp_path}/store")
    cfg = ScanConfig(categories=("image",), threshold=0.9)
    first = scan_summary(spark, [str(tmp_path / "in")], store, cfg)
    assert grouped(store, first.session) == [sorted(["a.png", "b c+d%.png", ".hidden.png", "near.png"])]
    assert (first.found, first.skipped, first.groups, first.files, first.cached) == (6, 1, 1, 4, 0)
    assert all(r.file_path.startswith("/") for r in store.read("signature_cache").collect())
    (tmp_path / "in" / "broken.png").unlink()
    opened = []
    monkeypatch.setattr(images, "image_facts", lambda *a: opened.append(a))
    second = scan_summary(spark, [f"file://{tmp_path}/in"], store, cfg)
    assert (second.cached, second.computed, opened) == (5, 0, []) and grouped(store, second.session) == grouped(store, first.session)
    monkeypatch.undo()
    make(tmp_path / "in", {"far.png": picture(1) + b"\0"})
    third = scan_summary(spark, [str(tmp_path / "in")], store, cfg)
    assert (third.cached, third.computed) == (4, 1) and "far.png" in grouped(store, third.session)[0]
    assert detectors.compare_files(spark, str(tmp_path / "in/a.png"), str(tmp_path / "in/near.png")) > 0.9
    assert detectors.compare_files(spark, str(tmp_path / "in/a.png"), str(tmp_path / "in/none.png")) == 0.0


def test_dice_scan_and_own_detector(spark, tmp_path):
    body = b"The quick brown fox jumps over the lazy dog and runs away. " * 30
    make(tmp_path / "in", {"a.txt": body, "b.txt": body + b"One more.", "c.txt": body, "d.txt": b"The quick " + b"zq xv wk " * 200, "e.log2": b"1234" * 400})
    store = SessionStore(spark, f"file://{tmp_path}/store")
    root = [str(tmp_path / "in")]
    exact = scan(spark, root, store, ScanConfig(categories=("document",)))
    dice = scan(spark, root, store, ScanConfig(categories=("document",), similarity="dice", threshold=0.9))
    assert grouped(store, exact) == [["a.txt", "c.txt"]] and grouped(store, dice) == [["a.txt", "b.txt", "c.txt"]]
    by_size = detectors.Detector("document", lambda files, _: files.select("path", F.lit("all alike").alias("signature")))
    own = scan(spark, root, SessionStore(spark, f"file://{tmp_path}/other"), ScanConfig(categories=("document",), detectors={"document": by_size}))
    assert own == 1 and detectors.compare_files(spark, f"{root[0]}/a.txt", f"{root[0]}/c.txt") == 1.0 and detectors.compare_files(spark, f"{root[0]}/a.txt", f"{root[0]}/d.txt") == 0.0
    with pytest.raises(ValueError):
        ScanConfig(similarity="other")


def test_classification(spark, tmp_path, capsys):
    from kinfold import cli
    from kinfold.plans.classification import classified

    make(tmp_path / "in", {"icon.png": picture(3), "wide.png": picture(4, w=1920, h=1080), "odd.png": picture(5, w=600, h=520), "page.png": png(500, 480, 240), "note.txt": b"x"})
    store = SessionStore(spark, f"file://{tmp_path}/store")
    found = files.walk(spark, [str(tmp_path / "in")])
    name = lambda df: {r.path.rsplit("/", 1)[-1]: (r.sub_category, r.tier) for r in df.collect()}
    got = name(classified(spark, found, [str(tmp_path / "in")], store))
    assert got["icon.png"] == ("logo_icon", 0) and got["wide.png"] == ("screenshot_desktop", 0) and got["page.png"] == ("scanned_document", 1) and got["odd.png"][0] in ("other", "diagram") and len(got) == 4
    assert store.read("classification_cache").count() == 4
    other = SessionStore(spark, f"file://{tmp_path}/more")
    protos = spark.createDataFrame([(0, "meme", [1.0, 0.0]), (1, "comic", [0.0, 1.0])], "idx int, label string, embedding array<double>")
    calls = f"{tmp_path}/calls"

    def remote(path, content):
        with open(calls, "a") as f:
            f.write(path + "\n")
        return "artwork"

    got = name(classified(spark, found, [str(tmp_path / "in")], other, encoder=lambda x: np.array([0.9, 0.1]) if x.std() > 0.3 else np.array([-1.0, -1.0]), prototypes=protos, remote=remote))
    assert got["odd.png"] == ("meme", 2) and got["icon.png"][1] == 0 and got["page.png"][1] == 3
    assert [x.rsplit("/", 1)[-1] for x in open(calls).read().split()] == ["page.png"]
    name(classified(spark, found, [str(tmp_path / "in")], other, remote=remote))  # all known now
    assert len(open(calls).read().split()) == 1
    assert cli.main(["--store", f"file://{tmp_path}/store", "sort", str(tmp_path / "in"), "--destination", f"{tmp_path}/out", "--classify", "--execute"]) == 0
    assert (tmp_path / "out/images/logo_icon/icon.png").exists() and (tmp_path / "out/documents/note.txt").exists()


def test_command_line(spark, tmp_path, capsys):
    import json

    from kinfold import cli

    body = b"some text that is long enough " * 50
    make(tmp_path / "in", {"a.txt": body, "b.txt": body, "c.zip": b"P" * 2000, "d.zip": b"P" * 2000})
    at = ["--store", f"file://{tmp_path}/store"]
    cli.main([*at, "scan", str(tmp_path / "in"), "--types", "document,archive"])
    assert "2 groups of duplicates with 4 files" in capsys.readouterr().out
    cli.main([*at, "list", "1", "--type", "archive"])
    out = capsys.readouterr().out
    assert "c.zip" in out and "a.txt" not in out
    cli.main([*at, "export", "1", f"file://{tmp_path}/json", "--format", "json"])
    whole = "\n".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*")))
    doc = json.loads(whole)
    assert doc["session_id"] == 1 and len(doc["groups"]) == 2 and len(doc["groups"][0]["files"]) == 2
    cli.main([*at, "delete", "1", "--keep", "oldest", "--execute"])
    assert len(list((tmp_path / "in").iterdir())) == 2


def test_store_writers_never_share_a_folder(spark, tmp_path):
    store, other = SessionStore(spark, f"file://{tmp_path}/store"), SessionStore(spark, f"file://{tmp_path}/store")
    assert store._claim("scan_sessions") == 1 and other._claim("scan_sessions") == 2
    store.create_session("a", ["code"], 0.9)
    other.create_session("b", ["code"], 0.9)
    assert store.read("scan_sessions").count() == 2 and len(store._parts("scan_sessions")) == 2
    store.vacuum()
    assert store.read("scan_sessions").count() == 2 and len(store._parts("scan_sessions")) == 1


def test_stream(spark, tmp_path):
    make(tmp_path / "in", {"a.txt": b"a text of more than ten bytes", "b.bin": b"zz"})
    store = SessionStore(spark, f"file://{tmp_path}/store")
    incremental.watch(spark, [str(tmp_path / "in")], store, f"{tmp_path}/cp").awaitTermination()
    assert store.read("signature_cache").count() == 1


def test_stream_of_many_roots(spark, tmp_path):
    make(tmp_path / "one", {"a.txt": b"a text of more than ten bytes"})
    make(tmp_path / "two", {"b.txt": b"another text of more than ten bytes"})
    make(tmp_path / "two" / "deep", {"c.txt": b"a third text of more than ten bytes"})
    store = SessionStore(spark, f"file://{tmp_path}/store")
    roots = [str(tmp_path / p) for p in ("one", "two", "two/deep")]  # the last lies below the second
    incremental.watch(spark, roots, store, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.file_path.rsplit("/", 1)[-1] for r in store.read("signature_cache").collect()) == ["a.txt", "b.txt", "c.txt"]
    make(tmp_path / "one", {"d.txt": b"a fourth text of more than ten bytes"})
    incremental.watch(spark, roots, store, f"{tmp_path}/cp").awaitTermination()
    assert store.read("signature_cache").count() == 4


def test_sorter(spark):
    from kinfold.operators import sorter

    df = spark.createDataFrame([("/a/x.png",), ("/b/x.png",), ("/c/x_1.png",), ("/a/n",), ("/a/y.weird",)], "path string")
    plan = sorter.destinations(df, "/out")
    assert sorter.stats(plan).first().asDict() == {"total": 5, "moved": 4, "failed": 0, "skipped": 1}
    got = {r.path: r.dest_path for r in sorter.resolve(plan).collect()}
    assert got == {"/a/x.png": "/out/images/x.png", "/b/x.png": "/out/images/x_2.png", "/c/x_1.png": "/out/images/x_1.png", "/a/y.weird": "/out/others/y.weird"}
    taken = spark.createDataFrame([("/out/images/x.png",)], "dest_path string")
    got = {r.path: r.dest_path for r in sorter.resolve(plan, taken).collect()}
    assert sorted(v for k, v in got.items() if k.endswith("x.png")) == ["/out/images/x_2.png", "/out/images/x_3.png"]
    many = spark.createDataFrame([(f"/d{i:03d}/x.png",) for i in range(12)] + [("/q/x_2.png",), ("/q/x_01.png",), ("/q/x_3_1.png",)], "path string")
    taken = spark.createDataFrame([("/out/images/x_5.png",), ("/out/images/x_4.png",), ("/out/images/x_9.png",), ("/elsewhere/x_1.png",)], "dest_path string")
    got = {r.path: r.dest_path for r in sorter.resolve(sorter.destinations(many, "/out"), taken).collect()}
    assert [got[f"/d{i:03d}/x.png"].rsplit("/", 1)[1] for i in range(12)] == ["x.png", *(f"x_{k}.png" for k in (1, 3, 6, 7, 8, 10, 11, 12, 13, 14, 15))] and len(set(got.values())) == 15


def test_classifier_cases(spark):
    from kinfold.operators import classify

    cases = [(1920, 1080, False, 400000, "screenshot_desktop"), (1080, 1920, False, 400000, "screenshot_desktop"), (1080, 2400, False, 500000, "screenshot_mobile"), (4000, 3000, True, 4000000, "photo_general"), (1920, 1080, True, 2000000, "photo_general"), (100, 100, True, 5000, "logo_icon"), (128, 128, False, 614400, None), (1000, 1000, False, 500000, None), (None, 5, True, 1, None), (0, 10, False, 1, None)]
    df = spark.createDataFrame(cases, "w int, h int, e boolean, s long, want string").withColumn("r", classify.tier0(F.col("w"), F.col("h"), F.col("e"), F.col("s")))
    assert all(r.want == (r.r.category if r.r else None) for r in df.collect())
    t1 = spark.createDataFrame([(0.5, 0.4, "diagram"), (0.9, 0.1, "scanned_document"), (0.88, 0.4, "diagram"), (0.15, 0.5, None)], "l float, e float, want string").withColumn("r", classify.tier1(F.col("l"), F.col("e")))
    assert all(r.want == (r.r.category if r.r else None) for r in t1.collect())
    strict = classify.Gates(0.99, 0.99, 0.99, 0.99)
    one = spark.createDataFrame([(1920, 1080, False, 400000, 0.5, 0.1)], "w int, h int, e boolean, s long, l float, d float")
    t0, t1c = classify.tier0(F.col("w"), F.col("h"), F.col("e"), F.col("s")), classify.tier1(F.col("l"), F.col("d"))
    r = one.select(classify.escalate(t0, t1c, gates=strict).alias("r")).first().r
    assert r.category == "screenshot_desktop" and r.confidence < 0.75 and r.tier == 0
    t2 = F.struct(F.lit("meme").alias("category"), F.lit(0.3).cast("float").alias("confidence"))
    r = one.select(classify.escalate(t0, t1c, t2, F.lit("comic"), strict).alias("r")).first().r
    assert (r.category, r.tier) == ("comic", 3)


def test_config(tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"thread_count":4,"cache_size_mb":500}')
    assert Settings.load(f).confidence_threshold == 0.62 and Settings.load(tmp_path / "none") == Settings()
    f.write_text("{broken")
    assert Settings.load(f) == Settings()
    p = tmp_path / "p.bin"
    p.write_bytes(b"\0" * 24 * 256 * 4)
    assert prototypes_ok(p, 256) and not prototypes_ok(p, 512)
