import io
import json
import zipfile

import pytest

from tidemark.sources import readers
from tidemark.streaming.ledger import ledger_stream, run_once, status_counts

LONG = "word " * 40


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a_book.md").write_text(f"# One\n{LONG}\n## Two\n{LONG}\n### Short\nfew words")
    (tmp_path / "b.html").write_text(f"<html><head><title>T</title></head><body><nav>menu</nav><article><h1>H</h1><p># {LONG}</p><h2>K</h2><p>{LONG}</p></article><footer>x</footer></body></html>")
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="x" href="x.xhtml" media-type="application/xhtml+xml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="x"/></spine></package>')
        z.writestr("o/t.ncx", '<ncx><navMap><navPoint><navLabel><text>Named</text></navLabel><content src="x.xhtml#a"/></navPoint></navMap></ncx>')
        z.writestr("o/x.xhtml", f"<html><body><p>{LONG}</p></body></html>")
    (tmp_path / "d.url").write_text("# note\n\nhttps://example.test/a\nA title\n")
    titles = {r.title for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert titles == {"One", "Two", "H", "K", "Named"}
    (tmp_path / "broken.epub").write_bytes(b"PK no archive")
    assert [r.error for r in readers.read_books_with_errors(spark, str(tmp_path)).where("error IS NOT NULL").collect()] and readers.read_books(spark, str(tmp_path)).count() == 1
    told = {r.path.rsplit("/", 1)[-1]: (r.title, r.author, r.language, r.slug) for r in readers.read_metadata(spark, str(tmp_path)).collect()}
    assert told == {"a_book.md": ("One", "Unknown Author", "en", "one"), "b.html": ("T", "Unknown Author", "en", "t"), "c.epub": ("Unknown Title", "Unknown Author", "en", "unknown_title"), "broken.epub": ("Broken", "Unknown Author", "en", "broken")}
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(tmp_path / "none"))
    link = readers.read_links(spark, str(tmp_path)).first()
    assert (link.url, link.title, len(link.cache_key)) == ("https://example.test/a", "A title", 24)
    (tmp_path / "e.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    assert [r.a for r in readers.read_json_lines(spark, str(tmp_path / "e.jsonl"), "a int").collect()] == [1, 2]
    assert [r.line for r in readers.bad_json_lines(spark, str(tmp_path / "e.jsonl"), "a int").collect()] == ["bad"]
    (tmp_path / f"{link.cache_key}.page").write_text(f"<html><body><p>{LONG}</p></body></html>")
    assert [(r.title, r.section) for r in readers.read_cached_pages(spark, str(tmp_path)).collect()] == [("A title", 0)]
    assert {".epub", ".url"} <= set(readers.suffixes())


def test_newer_archive():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><metadata><title>Big Book</title><creator>Ann Au</creator><language>de</language></metadata><manifest><item id="x" href="text/a%20b.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="c" href="i/c.jpg" properties="cover-image" media-type="image/jpeg"/></manifest><spine><itemref idref="x"/><itemref idref="gone"/></spine></package>')
        z.writestr("o/nav.xhtml", '<html><body><nav><ol><li><a href="text/a%20b.xhtml#s">First <b>part</b></a></li></ol></nav></body></html>')
        z.writestr("o/text/a b.xhtml", f"<html><body><p>{LONG}</p></body></html>")
        z.writestr("o/i/c.jpg", b"image")
    archive = readers.Archive(b.getvalue())
    assert [t for t, _ in archive.sections()] == ["First part"] and archive.metadata() == ("Big Book", "Ann Au", "de", b"image")


def test_ledger_stream(spark, tmp_path):
    src = tmp_path / "ledger"
    src.mkdir()
    line = lambda run, status, day: json.dumps({"run_id": run, "source_path": "/a//b", "status": status, "total_seconds": 1.0, "logged_at": f"2025-01-{day:02d}T10:00:00"})
    (src / "1.json").write_text("\n".join([line("r1", "OK", 1), line("r1", "ok ", 1), line("r2", "failed", 1)]))
    go = lambda: run_once(ledger_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    (src / "2.json").write_text(line("r3", "ok", 2))
    go()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 4 and {r.source_path for r in rows} == {"/a/b"}
    q = status_counts(ledger_stream(spark, str(src))).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
