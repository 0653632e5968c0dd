import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from leafmill.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def held_out(spark):
    """(found, wrong, all toxic) of held-out rows."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(rows) == docs.count()
    hits = [0, 0, 0]
    for doc_id, toxic in zip(*(c.to_pylist() for c in pq.read_table(f"{SF}/labels.parquet", columns=["doc_id", "toxic"]).columns), strict=True):
        r = rows[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.held_out:
            hits[2] += toxic
            hits[1 - toxic] += r.predicted
    return hits


def test_held_out_accuracy(held_out):
    found, wrong, _ = held_out
    assert found and wrong < 0.2 * found


@pytest.mark.xfail(reason="toxic texts in three of this table's four languages differ by beginnings of words that ordinary text has too, which whole windows' lengths do not tell")
def test_held_out_recall(held_out):
    found, _, all_toxic = held_out
    assert found > 0.5 * all_toxic


def test_odd_rows(make_docs, spark):
    docs = make_docs([(None, None), (1, ""), (2, "word " * 50_000), (2, "a b")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == 4 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.score(make_docs([]), none).count() == 0
    learnt = [(k, f"{'venom' if k % 2 else 'calm'}{k % 7} x{k} y{k * 3} " * 5) for k in range(300)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(300)] + [(0, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(make_docs(learnt + [(None, None), (900, "w " * 30_000)]).withColumn("score", F.lit(1)), labels).collect()
    assert len(rows) == 302
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert all(r.predicted == r.doc_id % 2 for r in known)


def test_words_never_seen(make_docs, spark):
    """Toxic texts share strings inside of words, no two of which are alike: a list of words or beginnings can't tell them."""
    rng = np.random.default_rng(8)
    common = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "su", "ta") for b in ("ra", "ti", "vo", "lu", "gen", "pol") for c in ("", "s", "ne", "do", "rim", "ex")]

    def text(toxic):
        words = list(rng.choice(common, 60))
        for _ in range(8):
            inner = "wicked scorn".split()[rng.integers(2)] if toxic else "".join(rng.choice(list("abcdefghijklmnop"), 6))
            words.insert(rng.integers(len(words)), "".join([*rng.choice(list("abcdefghijklmnop"), 5), inner, *rng.choice(list("abcdefghijklmnop"), 5)]))
        return " ".join(words)

    docs = [(k, text(k % 3 == 0)) for k in range(900)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(900)], "doc_id long, quality int, toxic int")
    rows = [r for r in toxicity.score(make_docs(docs), labels).collect() if r.held_out]
    right = [r.predicted == (r.doc_id % 3 == 0) for r in rows]
    assert len(right) > 200 and np.mean(right) > 0.9


def test_dictionaries_are_trained_and_windows_compared():
    rng = np.random.default_rng(9)
    ordinary = [" ".join(rng.choice([f"word{i}" for i in range(300)], 40)) for _ in range(200)]
    toxic = [t.replace("word7 ", "venomous ").replace("word5", "poison") + " venomous poison" for t in ordinary[:100]]
    found = [toxicity.windows(t.encode()) for t in [*toxic, *ordinary]]
    y = np.array([1] * 100 + [0] * 200)
    own, thresholds, curve = toxicity.fit(found, y, np.ones(300))
    tables, base, of_toxic, of_ordinary = own
    for part in (of_toxic, of_ordinary):
        assert zstandard.ZstdCompressionDict(tables + part + base, dict_type=zstandard.DICT_TYPE_FULLDICT).dict_id() != 0
    assert b"venomous" in of_toxic and b"venomous" not in of_ordinary + base
    a = zstandard.ZstdCompressionDict(tables + of_toxic + base)
    assert all(len(w.split()) <= toxicity.WINDOW for f in found for w in f) and b" ".join(w.strip() for w in found[0]).decode() == toxic[0]
    # a distance is a difference of two compressed lengths, and both frames give the window back
    distance = toxicity.Distance(*own)
    window = b" word1 venomous poison word2 "
    packed = distance.toxic(window)
    assert zstandard.ZstdDecompressor(dict_data=a).decompress(packed, max_output_size=100) == window
    assert distance.of([window])[0] == len(distance.ordinary(window)) - len(packed) >= thresholds[0]
    assert distance.of([b""])[0] == 0 and len(toxicity.features(distance.of([b""]), thresholds)) == len(curve[0])


def test_sample_takes_one_row_an_id_and_spreads_windows(make_docs, spark):
    rows = [(k % 50, f"text {k % 70} " * 3) for k in range(400)] + [(60, " ".join(f"w{i}" for i in range(30_000)))]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(61)] + [(3, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    found, y, weight = toxicity.sample(make_docs(rows).withColumn("th", F.lit("x")).withColumn("toxic", F.lit(5)), labels)
    ids = {k for k in [*range(50), 60] if zlib.crc32(str(k).encode()) % 3 != 1}
    assert len(found) == len(y) == len(weight) <= len(ids) and (weight == 1).all()
    long = max(found, key=len)
    assert len(long) == toxicity.SPREAD and b"w0 " in long[0] and any(b"w29" in w for w in long)
