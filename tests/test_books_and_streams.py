import struct

import pytest
from pyspark.sql import functions as F

from leafmill.operators import library
from leafmill.sources import books
from leafmill.streaming import progress

CHAPTERS = [{"title": "One <&>", "paragraphs": ["First.", "a\tb", "c\td", "Last «x»."]}, {"title": "Two", "paragraphs": ["Only."]}]


@pytest.mark.parametrize("kind", ["epub", "fb2"])
def test_round_trip(spark, tmp_path, kind):
    rows = spark.createDataFrame([("b", "Title", "Author", CHAPTERS)], "path string, title string, author string, chapters array<struct<title: string, paragraphs: array<string>>>")
    content = books.exported(rows, kind).first().content
    (tmp_path / f"book.{kind}").write_bytes(bytes(content))
    got = books.books(spark, str(tmp_path)).first()
    assert (got.status, got.title, got.author) == ("SUCCESS", "Title", "Author")
    same = [(c.title, [p.replace("\t", " ") if kind == "fb2" else p for p in c.paragraphs]) for c in got.chapters]
    assert same == [(c["title"], [p.replace("\t", " ") if kind == "fb2" else p for p in c["paragraphs"]]) for c in CHAPTERS]


def test_plain_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Глава 1\nПривет, мир.\n\nЕщё.".encode("windows-1251"))
    (tmp_path / "b.md").write_text("---\ntitle: T\nauthor: A\n---\n# One\nSome *bold* [link](x).\n## Two\n> quoted")
    (tmp_path / "c.html").write_text("<!DOCTYPE html><html><body><nav>menu</nav><article><p>Text.</p></article></body></html>")
    (tmp_path / "d.bin").write_bytes(b"?")
    (tmp_path / "e.epub").write_bytes(b"PK\x03\x04broken")
    got = {r.path.rpartition("/")[2]: r for r in books.books(spark, str(tmp_path)).collect()}
    assert got["a.txt"].chapters[0].title == "Глава 1" and got["a.txt"].warnings == ["charset guessed"]
    assert [(c.title, c.paragraphs) for c in got["b.md"].chapters] == [("One", ["Some bold link."]), ("Two", ["quoted"])]
    assert got["c.html"].chapters[0].paragraphs == ["Text."]
    assert got["d.bin"].status == "UNKNOWN_FORMAT" and got["e.epub"].status.startswith("BROKEN")


def test_bytes():
    assert books.legacy_charset("привет".encode()) == "utf-8"
    assert books.legacy_charset("привет мир".encode("windows-1251")) == "windows-1251"
    assert books.legacy_charset("привет мир".encode("koi8-r")) == "koi8-r"
    assert books.zip_path("OEBPS/a/x.opf", "../b%20c.html#p") == "OEBPS/b c.html"
    assert books.zip_path("x.opf", "../../etc") is None and books.zip_path("x", "http://a") is None
    assert books.picture_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 20, 30)) == (20, 30)
    assert books.picture_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    assert books.picture_size(b"\xff\xd8\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 9) == (9, 7)
    assert books.picture_size(b"none") is None


def _stream(spark, rows, schema, path, apply, mode):
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    running = apply(source).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    return spark.sql("select * from out").collect()


def test_stream_is_batch(spark, tmp_path):
    rows = [(k % 2, k, float(k % 5 + 1) / 20) for k in range(9)]
    got = _stream(spark, rows, "voice long, seq long, level double", tmp_path / "a", progress.loudness, "append")
    want = []
    for voice in (0, 1):
        mine = [r for r in rows if r[0] == voice]
        want += [(voice, r[1], g) for r, g in zip(mine, progress.gains([r[2] for r in mine], None)[0], strict=True)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    log = [(k % 3, k, k * 10) for k in range(9)]
    schema = "book long, at long, place long"
    done = _stream(spark, log, schema, tmp_path / "b", lambda s: progress.latest_positions(s, "book", ["at"], ["at", "place"]), "complete")
    batch = library.latest(spark.createDataFrame(log, schema), "book", ["at"], ["at", "place"]).collect()
    assert sorted(map(tuple, done)) == sorted(map(tuple, batch))
    once = _stream(spark, [(1, "u"), (1, "u"), (2, "u"), (1, "v")], "book long, url string", tmp_path / "c", lambda s: progress.appended_once(s, ["book", "url"]), "append")
    assert sorted(map(tuple, once)) == [(1, "u"), (1, "v"), (2, "u")]


def test_position_is_its_inverse(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("p"), (F.col("id") % 11).alias("o"))
    got = rows.select(library.to_progress(F.col("p"), F.col("o"), F.lit(20), F.lit(7)).alias("x"), "p", "o").collect()
    for r in got:
        place = r.x * 7 + 1e-4
        assert (int(place), round((place - int(place)) * 20)) == (r.p, r.o)
