import hashlib

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import edit_embedding as ee


def test_odd_rows(make_docs):
    rows = ee.edited(make_docs([(None, "b"), (None, "ab"), (7, "cccc"), (7, "cccc"), (9, None)])).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in rows]
    want = [(None, "ab", "ab"), (None, "b", "b"), (7, "cccc", "cccc"), (7, "cccc", "cc"), (9, "", "")]
    assert sorted(got, key=str) == sorted([(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e in want], key=str)
    assert ee.edited(make_docs([])).count() == 0
    alone = ee.edited(make_docs(["solo"])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"soso").hexdigest() and alone.near_next == 1


def test_candidates(spark, sample):
    long = [t for t in sample[10:] if len(t) > 800][:12]
    near = [t[:100] + "zz" + t[101:] for t in long]
    prints = ee.fingerprints([ee.letters(t) for t in [*long, *near, *long]])
    pairs, classes = ee.candidates(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string").withColumn("a", F.lit(1)), near=0.5)
    linked = {frozenset((r.a, r.b)) for r in pairs.collect()}
    assert classes.count() == len(prints)
    for a in {x for p in linked for x in p}:
        assert a in prints
    brute = {frozenset((x, y)) for x in set(prints) for y in set(prints) if x < y and ee.likeness(x, y) >= 0.8}
    assert brute <= linked


def whole_walk(part):
    """One character at a time, until the pointer has left the part."""
    at, seen = 0, []
    while at < len(part):
        c = int(part[at])
        seen.append(c)
        at += 1 if len(part) - at >= ee.STEPS - len(seen) + 1 else int(ee._COINS[len(seen) - 1][c])
    return seen


def whole_fingerprint(text):
    points = ee.letters(text)
    walks = [whole_walk(points[i : i + ee.PART]) for i in range(0, len(points), ee.PART)]
    out = []
    for r in ee._RECORDS:
        g = int(max(x for x in r if x < (len(walks) - 1) * ee.STEPS + len(walks[-1])))
        walk, digit = walks[g // ee.STEPS], 0
        j = min(g % ee.STEPS, len(walk) - 1)
        for t in range(ee.REACH):
            digit = ((digit ^ int(ee._LETTERS[walk[max(j - t, 0)]])) * int(ee._MIX)) % (1 << 64)
        out.append("0123456789abcdef"[digit >> 60])
    return "".join(out)


def test_whole_texts_are_walked():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh "), n)) for n in (1, 2, 10, 100, 1000, ee.PART, ee.PART + 1, 9000)] + ["x" * 9000]
    assert ee.fingerprints([ee.letters(t) for t in texts]) == [whole_fingerprint(t) for t in texts]
    # an edit in the last tenth, and of the last character of a full part, is put out
    for n, at in ((1000, 950), (1000, 999), (ee.PART, ee.PART - 1), (ee.PART, ee.PART - 300)):
        text = "".join(rng.choice(list("abcdefgh "), n))
        a, b = (ee._walk([ee.letters(t)])[:, 0].tolist() for t in (text, text[:at] + "z" + text[at + 1 :]))
        assert a != b
    # texts that differ in their last eighth alone have different fingerprints
    for n in (1000, ee.PART):
        text = "".join(rng.choice(list("abcdefgh "), n))
        a, b = ee.fingerprints([ee.letters(t) for t in (text, text[: n - n // 10] + "z" * (n // 10))])
        assert a != b and ee.likeness(a, b) < 1


def test_slowest_walk_still_ends(monkeypatch):
    monkeypatch.setattr(ee, "_COINS", np.zeros_like(ee._COINS))
    part = np.arange(ee.PART) % 255 + 1
    walk = ee._walk([part.astype(np.uint8)])[:, 0]
    assert len(walk) == ee.STEPS and walk[-1] == part[-1]


def test_query(make_docs, sample):
    texts = [*sample, "x" * 9000, "long words " * 3000]
    rows = {r.doc_id: r for r in ee.edited(make_docs(texts)).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        t, n = t or "", texts[(k + 1) % len(texts)] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = rows[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == ee.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == ee.likeness(r.fingerprint, rows[(k + 1) % len(texts)].fingerprint)
        if t and (k % 6 == 0 or len(t) > 4096):
            assert r.fingerprint == whole_fingerprint(t) and r.edited_fingerprint == whole_fingerprint(e)
        if len(t) > 300 and t != n and len(n) > 300:
            assert r.near_edited > 0.25
    plain = [r.near_next for r in rows.values() if r.n_chars > 300 and r.doc_id > 9]
    assert np.median(plain) < 0.1


def test_chains_stay_linked(spark):
    """a is like b and b like c, which is not like a; and b and c share only bands that a, the least, is in too."""
    bands = np.random.default_rng(17).permutation(ee.SLOTS).reshape(ee.BANDS, ee.WIDTH)
    a = np.full(ee.SLOTS, "0")
    b = a.copy()
    b[bands[:4]] = "1"
    c = b.copy()
    c[bands[:4, 0]], c[bands[4:8, 1:]] = "2", "3"
    prints = ["".join(x) for x in (a, b, c)]
    assert ee.likeness(prints[0], prints[1]) >= ee.NEAR <= ee.likeness(prints[1], prints[2]) and ee.likeness(prints[0], prints[2]) < ee.NEAR
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    assert {(r.a, r.b) for r in ee.candidates(rows)[0].collect()} == {(prints[0], prints[1]), (prints[1], prints[2])}
    # as with blocks of one or two
    assert {(r.a, r.b) for r in ee.candidates(rows, block=1)[0].collect()} == {(prints[0], prints[1]), (prints[1], prints[2])}


def test_ranges_have_tasks_of_their_own(make_docs, spark):
    docs = make_docs([(k, f"text {k}") for k in range(400)])
    ranged = ee.in_order(docs)
    tasks = ranged.where("place = 0").select("bucket", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.bucket for r in tasks}) == len({r.task for r in tasks}) == len(tasks) > 1


def test_candidates_find_small_edits(spark):
    """Pairs at a true edit distance of up to 1 % of the characters, by the query's own numbers."""
    rng = np.random.default_rng(6)
    letters = list("etaoin shrdlu")
    texts = ["".join(rng.choice(letters, 1200)) for _ in range(40)]

    def edited(t, n):
        for _ in range(n):
            at, what = rng.integers(len(t)), rng.integers(3)
            t = t[:at] + ("" if what == 0 else "z") + t[at + (what != 1) :]
        return t

    pairs = [(t, edited(t, n)) for t, n in zip(texts, [3, 12] * 20, strict=True)]
    prints = ee.fingerprints([ee.letters(t) for p in pairs for t in p])
    found = {frozenset((r.a, r.b)) for r in ee.candidates(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string"))[0].collect()}
    hits = [frozenset(prints[2 * k : 2 * k + 2]) in found for k in range(40)]
    assert np.mean(hits[::2]) >= 0.7 and len(found) == sum(hits)


def test_memory_of_a_task_is_bounded():
    """A task holds some 50 MB of texts, walks and slots at most, for short rows as for long ones, whatever the size of Arrow's batches."""
    import tracemalloc

    import pyarrow as pa

    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
    for n, chars in ((4500, 200), (1200, 4000)):
        rows = [(0, 0, k, f"{k} " + "some words " * (chars // 11)) for k in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "place", "doc_id", "text"])
        del rows
        tracemalloc.start()
        done = sum(out.num_rows for out in ee._edit(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert done == n - 1 and peak < 64 << 20


def test_marks_are_counted_by_blocks(spark):
    values = list(range(-2, 60)) + [10**9]
    for marks in ([], [5], [0, 1, 2], sorted({k * k % 53 for k in range(40)})):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        got = [tuple(r) for r in df.select("v", ee._marks_up_to(F.col("v"), marks)).collect()]
        assert got == [(v, sum(m <= v for m in marks)) for v in values]


def test_as_many_ranges_as_partitions(spark):
    """Ranges are alike at any number of partitions; one of a few hundred would hold several times the rows of the others."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    docs = spark.range(60_000).selectExpr("id * id as doc_id", "'t' as text").repartition(4)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "600")
        ranged = ee.in_order(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = [r["count"] for r in ranged.where("place = 0").groupBy("bucket").count().collect()]
    assert len(sizes) > 570 and max(sizes) <= 2.5 * 60_000 / 600
