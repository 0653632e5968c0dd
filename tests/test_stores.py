import json
import struct

import numpy as np
from pyspark.sql import functions as F

from leafmill.sources import stores


def test_library(spark, tmp_path):
    rows = [("a", "A", 5, 0), ("b", "B", 9, 0), ("c", "C", 1, 0)]
    schema = "book_id string, title string, added_at long, last_opened_at long"
    books = spark.createDataFrame(rows, schema).withColumn("chapters", F.array(F.struct(F.lit("t").alias("title"), F.array(F.lit("p")).alias("paragraphs"))))
    stores.save(books, str(tmp_path / "lib"))
    stores.save(books.where("book_id = 'a'").withColumn("title", F.lit("A2")), str(tmp_path / "lib"))
    (tmp_path / "lib" / "broken.json").write_text("{no json")
    positions = spark.createDataFrame([("c", 7, 0.5, 20), ("c", 0, 0.1, 10)], "book_id string, chapter int, progress float, opened_at long")
    got = [(r.book_id, r.title, r.current_chapter) for r in stores.library(spark, str(tmp_path / "lib"), positions).collect()]
    assert got == [("c", "C", 0), ("b", "B", 0), ("a", "A2", 0)]


def test_json(spark):
    marks = json.dumps([{"id": "1", "kind": "BOOKMARK", "chapter": 2, "paragraph": 0, "start": 0}, {"id": "2", "kind": "HIGHLIGHT", "chapter": 1, "paragraph": 3, "start": 4}, {"id": "3", "kind": "?"}])
    assert [r.id for r in stores.annotations(spark.createDataFrame([("b", marks)], "book_id string, json string")).collect()] == ["2", "1"]
    feed = [{"draft": False, "prerelease": False, "assets": [{"name": f"app-{v}.apk", "size": 1, "digest": d, "browser_download_url": u} for v, d, u in ((7, None, "https://x/7"), (12, "sha256:" + "0" * 64, "https://x/12"), (40, "bad", "https://x/40"), (50, None, "http://x/50"))]}, {"draft": True, "assets": [{"name": "app-99.apk", "browser_download_url": "https://x"}]}]
    assert stores.newest_release(spark.createDataFrame([(json.dumps(feed),)], "json string"), "^app-(\\d+)\\.apk$").first().version == 12
    assert spark.createDataFrame([('{"a":"f","b":"x"}',)], "j string").select(stores.choices(F.col("j"))).first()[0] == {"a": "f"}


def test_wiki_and_wav():
    assert stores.wiki_paragraphs("{{a|{{b}}}}'''Bold''' [[x|word]] here<ref>n</ref>\n== Head ==\n* 12\n[[File]] text") == ["Bold word here", "File text"]
    body = np.array([0, 16384, -32768, 0], "<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 2, 8000, 32000, 4, 16, b"data", len(body))
    rate, samples = stores.wav(head + body)
    assert rate == 8000 and np.allclose(samples, [0.25, -0.5]) and stores.wav(b"no") is None


def test_manifest(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("file\turl\tlabel\na.html\thttps://a.example/1\tCHAPTER\n\nb.html\thttps://a.example/2\tPAYWALL\n")
    rows = stores.manifest(spark, f"{tmp_path}/m.tsv").collect()
    assert [tuple(r) for r in rows] == [("a.html", "https://a.example/1", "CHAPTER"), ("b.html", "https://a.example/2", "PAYWALL")]
