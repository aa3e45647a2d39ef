import io
import json
import struct
import zipfile
import zlib

import pytest

from glyphmill.sources import readers, writers


def png(width=3, height=2, shade=7):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes([shade]) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_archives_in_natural_order_and_with_faults(spark, tmp_path):
    (tmp_path / "a.cbz").write_bytes(archive([("page10.png", png(shade=1)), ("page2.png", png(4, 5)), ("__MACOSX/x.png", b""), ("notes.txt", b"x")]))
    (tmp_path / "b.cbz").write_bytes(archive([("flat.bmp", b"\0" * 2_000_000)]) if False else b"no zip at all")
    (tmp_path / "c.rar").write_bytes(b"Rar!....")
    (tmp_path / "noext").write_bytes(archive([("1.png", png())]))
    rows = readers.archive_pages(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    assert [(r.member, r.page_id, r.width, r.height) for r in by["a.cbz"]] == [("page2.png", "p0001", 4, 5), ("page10.png", "p0002", 3, 2)]
    assert by["b.cbz"][0].fault and by["c.rar"][0].fault == "no reader for rar" and len(by["noext"]) == 1


def test_limits_of_an_archive():
    with zipfile.ZipFile(io.BytesIO(), "w") as _:
        pass
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.png", b"\0" * 3_000_000)
    with pytest.raises(ValueError, match="too tightly"):
        readers.zip_pages(packed.getvalue())
    assert readers.image_size(b"") is None and readers.image_size(png(9, 4)) == (9, 4)


def test_folders_banks_cases_documents(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    for n in ("10.png", "9.png", "Thumbs.db", "._1.png"):
        (d / n).write_bytes(png())
    assert [(r.name, r.page_id) for r in readers.folder_pages(spark, str(d)).orderBy("page_index").collect()] == [("9.png", "p0001"), ("10.png", "p0002")]
    with pytest.raises(Exception, match="over the limit"):
        readers.folder_pages(spark, str(d), most_total=10).collect()
    (tmp_path / "bank.tsv").write_text("# comment\nIron Gate\tدروازه\tplace\nshort\n\tx\t\n", encoding="utf-8")
    assert [tuple(r) for r in readers.term_bank(spark, str(tmp_path / "bank.tsv")).collect()] == [("Iron Gate", "دروازه", "place")]
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": "a-1", "accept": ["x"], "units": 2}]}))
    assert [(r.id, r.units) for r in readers.cases(spark, str(tmp_path / "cases.json")).collect()] == [("a-1", 2)]
    doc = {"version": 1, "meta": {"sfx_policy": "keep"}, "pages": [{"id": "p0001", "regions": [{"id": "p0001r001", "kind": "sfx"}, {"id": "p0001r002"}]}, {"id": "p0002", "regions": []}]}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc))
    loaded = readers.documents(spark, str(path))
    flat = readers.document_regions(loaded).collect()
    assert [(r.page_id, r.id, r.region_pos) for r in flat] == [("p0001", "p0001r001", 0), ("p0001", "p0001r002", 1)]
    generation = loaded.first().generation
    moved = writers.save_document(loaded.drop("path", "generation"), path, generation)
    assert json.loads(path.read_text())["pages"][0]["id"] == "p0001" and moved != generation
    with pytest.raises(writers.Moved):
        writers.save_document(loaded.drop("path", "generation"), path, generation)
    path.write_text('{"version": 2}')
    with pytest.raises(Exception, match="unknown version"):
        readers.documents(spark, str(path)).collect()


def test_packages_round_trip(spark, tmp_path):
    rows = [("s1", f"p000{i}", f"x{i}.PNG", png(shade=i)) for i in (2, 1, 3)] + [("s2", "p0001", "y.png", png())]
    df = spark.createDataFrame(rows, "series string, page_id string, member string, content binary")
    manifest = writers.write_packages(df, ["series"], str(tmp_path / "out"))
    manifest.write.parquet(str(tmp_path / "manifest"))
    manifest = spark.read.parquet(str(tmp_path / "manifest"))
    found = writers.read_packages(spark, str(tmp_path / "out"))
    assert {r.verdict for r in writers.verify_packages(manifest, found).collect()} == {"ok"} and manifest.count() == 4
    broken = manifest.selectExpr("package", "name", "nr", "if(name = 'p0002.png', 'x', sha256) as sha256").where("name <> 'p0003.png'")
    assert sorted(r.verdict for r in writers.verify_packages(broken, found).collect()) == ["ok", "ok", "unknown", "wrong bytes"]
    assert writers.write_folder(df.where("series = 's1'"), str(tmp_path / "loose")).count() == 3
    (tmp_path / "loose" / "mine.txt").write_text("x")
    assert writers.strangers(str(tmp_path / "loose"), {f"p000{i}.png" for i in (1, 2, 3)}) == ["mine.txt"]


def test_sheets_and_review_documents(spark):
    from glyphmill.operators.replies import parse_reply

    rows = [("s", "p0001", "p0001r002", 2, "speech", "horizontal", 2, "Hi\n@@ no header", None), ("s", "p0001", "p0001r001", 1, "sfx", "vertical", 1, "Bang", "بنگ")]
    df = spark.createDataFrame(rows, "series string, page_id string, id string, region_key bigint, kind string, orientation string, reading_order int, source_text string, target_text string")
    sheet = writers.worksheets(df, ["series", "page_id"]).first().sheet
    parsed = {(r["region_id"], r["field"]): r["values"] for r in parse_reply(sheet)}
    assert parsed[("p0001r001", "fa")] == ["بنگ"] and parsed[("p0001r002", "src")] == ["Hi\n@@ no header"]
    with zipfile.ZipFile(io.BytesIO(writers.review_document([("p1", "r1", "a < b", "سلام")]))) as z:
        assert "a &lt; b" in z.read("word/document.xml").decode()
    with pytest.raises(ValueError):
        writers.review_document([("p", "r", "x" * 3_000_000, "")])
    assert "<Title>" not in writers.comic_info({"title": ""}, 2)


def test_strict_json(spark):
    deep = "[" * 200 + "]" * 200
    df = spark.createDataFrame([('{"a": 1}',), ("{a",), (deep,), (None,)], "text string")
    assert [r.fault for r in readers.json_records(df, "text", "a int").collect()] == [None, "no JSON", "too deep", "empty"]
