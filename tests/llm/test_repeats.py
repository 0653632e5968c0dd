import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import repeats, suffix_dedup, word_dedup


def slow_bytes(texts, length=200):
    texts = [(t or "").encode() for t in texts]
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def slow_words(rows, length=50):
    first = {}
    for k, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(k, first.get(key, k))
    out = []
    for k, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < k:
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def tangled(sample):
    """Texts with exact copies, near copies, shared passages, periods and overlaps."""
    rnd = random.Random(5)
    texts = sample[:40]
    base = [t for t in sample[10:] if len(t) > 1500][:6]
    for t in base:
        for _ in range(4):
            cutting = t.split(" ")
            for _ in range(rnd.randint(0, 6)):
                cutting[rnd.randrange(len(cutting))] = rnd.choice(["x", "yy", "zzz é"])
            texts.append(" ".join(cutting))
        a, b = rnd.randrange(500), rnd.randrange(600, 1500)
        texts.append("start " + t[a:b] + " middle " + t[a + 50 : b] + base[0][:333])
    texts += ["ab" * 400, "abc" * 100, "abc" * 67, "a" * 199, "a" * 200, "a" * 201, "w " * 49, "w " * 50, "w " * 51, "u v " * 60, base[1], base[1], base[2][:250], base[2][7:257]]
    texts += [" ".join(f"n{i}" for i in range(k, k + 60)) for k in range(0, 40, 7)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("wide", [repeats.WIDE, 1])
def test_bytes(make_docs, tangled, monkeypatch, wide):
    monkeypatch.setattr(repeats.verdicts, "__defaults__", (wide,))
    rows = suffix_dedup.digests(suffix_dedup.dedup(make_docs(tangled))).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(tangled)
    assert [got[k] for k in range(len(tangled))] == slow_bytes(tangled)


@pytest.mark.parametrize("wide", [repeats.WIDE, 1])
def test_words(make_docs, tangled, monkeypatch, wide):
    monkeypatch.setattr(repeats.verdicts, "__defaults__", (wide,))
    rows = word_dedup.digests(word_dedup.dedup(make_docs(tangled))).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert [got[k] for k in range(len(tangled))] == slow_words(list(enumerate(tangled)))


def test_repeated_and_null_ids(make_docs, sample):
    long = next(t for t in sample[10:] if len(t) > 2000)
    rows = [(None, long), (None, long), (3, long), (3, long[:900]), (3, long[:900]), (5, "z " + long[100:]), (6, "")]
    out = sorted((r.doc_id if r.doc_id is not None else repeats.NO_ID, *tuple(r)[1:]) for r in suffix_dedup.digests(suffix_dedup.dedup(make_docs(rows))).collect())
    assert out == sorted((k if k is not None else repeats.NO_ID, *x) for (k, _), x in zip(rows, slow_bytes([t for _, t in rows]), strict=True))
    out = sorted((r.doc_id if r.doc_id is not None else repeats.NO_ID, *tuple(r)[1:]) for r in word_dedup.digests(word_dedup.dedup(make_docs(rows))).collect())
    fixed = [(k if k is not None else repeats.NO_ID, t) for k, t in rows]
    assert out == sorted((k, *x) for (k, _), x in zip(fixed, slow_words(fixed), strict=True))


def test_empty_table(make_docs):
    assert suffix_dedup.dedup(make_docs([])).count() == 0
    assert word_dedup.dedup(make_docs([])).count() == 0


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 1000)
    flat = np.random.default_rng(0).integers(0, 9, 5000).astype(np.uint64)
    seen = [(t, s, len(p)) for p, o, t, s in repeats.chunks(flat, np.array([0, 100, 4700, 4710, 5000]), 200)]
    assert [x[:2] for x in seen] == [(0, 0), (1, 0), (1, 1000), (1, 2000), (1, 3000), (1, 4000), (2, 0)]


def test_words_are_compared_at_their_places(make_docs):
    """Two words with one hash make equal symbols; the digests of the words themselves tell the places apart."""
    import pyarrow as pa

    def weak(column):
        texts = [t.replace(b"minus", b"plus") for t in column.cast(pa.binary()).to_pylist()]
        return repeats.word_symbols(pa.array(texts, pa.binary()))

    text = " ".join(f"w{i}" for i in range(60)) + " plus " + " ".join(f"v{i}" for i in range(60))
    docs = make_docs([(1, text), (2, text.replace("plus", "minus")), (3, text)])
    out = {r.doc_id: r.n_removed for r in word_dedup.dedup(docs, repeats.Kind(weak, length=50, k=16, ordered=True)).collect()}
    assert out == {1: 0, 2: 0, 3: 121}


def test_paths_decide(make_docs, sample):
    """Copies of one text are one path, or one for each place where paths are broken, and each has several places."""
    text = " ".join(f"w{i}" for i in range(2000))
    docs = make_docs([(k, text) for k in range(5)] + [(9, "other " * 10)])
    texts = repeats.keyed(docs)
    seen = []

    def sources(again, alone):
        seen.append(word_dedup.paths(again, alone))
        return again.join(alone.select("kmer", "content"), ["kmer", "content"]).withColumn("first_id", F.col("id"))

    again, _, digests = repeats.verdicts(repeats.phrases(texts, word_dedup.WORDS), texts, word_dedup.WORDS, also=sources)
    merged = seen[0].collect()
    assert len(merged) % 5 == 0 and len(merged) < again.count() / 3
    assert {(r.kmer, r.content) for r in merged} <= {(r.kmer, r.content) for r in digests.collect()}
    assert sorted({(r.s, r.n) for r in merged}) == sorted((r.s, r.n) for r in merged if r.id == 0)


def test_many_equal_rows_are_one_phrase(make_docs):
    """A text in many rows without an id, and two variants of it: few phrases come to one place."""
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(None, base)] * 300 + [(1, base.replace("word60", "x")), (2, base.replace("word61", "y"))]
    docs = make_docs(rows)
    for kind in (suffix_dedup.BYTES, word_dedup.WORDS):
        texts = repeats.keyed(docs)
        found = repeats.phrases(texts, kind)
        again, _, _ = repeats.verdicts(found, texts, kind)
        classes = again.groupBy("kmer", "content").agg(F.min(F.struct("id", "th", "s", "n")).alias("first")).select("kmer", "content", F.col("first.id").alias("first_id"), "first.*", F.lit(2).cast("long").alias("m"))
        spans = repeats.spans_of(classes, texts, kind)
        assert spans.groupBy("kmer").count().agg({"count": "max"}).first()[0] <= 6


def test_very_long_text(make_docs):
    text = " ".join(f"n{i % 90_001}" for i in range(200_000))
    assert len(text) > 1_000_000
    docs = make_docs([(1, text), (2, "short"), (3, text[500_000:700_000])]).withColumnsRenamed({"lang": "kmer", "source": "content"})
    out = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(suffix_dedup.dedup(docs)).collect()}
    assert [out[k] for k in (1, 2, 3)] == slow_bytes([text, "short", text[500_000:700_000]])
    out = {r.doc_id: tuple(r)[1:] for r in word_dedup.digests(word_dedup.dedup(docs)).collect()}
    assert [out[k] for k in (1, 2, 3)] == slow_words([(1, text), (2, "short"), (3, text[500_000:700_000])])
