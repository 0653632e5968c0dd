import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import lm_scoring, ngrams

TEXTS = ["abracadabra", "abra cadabra", "the cat sat on the mat", "", "aaaa", "é漢\x00x", "the cat", "zebra"]


def seq(t):
    return t.encode() + b"\0"


def contexts(t, order):
    s = b"\0" * (order - 1) + seq(t)
    return [(s[i - order + 1 : i], s[i]) for i in range(order - 1, len(s))]


def slow_ppm(texts, order):
    seen = defaultdict(Counter)
    for t in texts:
        for c, x in contexts(t, order):
            for k in range(order):
                seen[c[k:]][x] += 1

    def p(c, x, out=frozenset()):
        if c not in seen:
            return p(c[1:], x, out)
        left = {y: n for y, n in seen[c].items() if y not in out}
        t, d = sum(left.values()), len(seen[c])
        if x in left:
            return left[x] / (t + d)
        escape = d / (t + d)
        return escape * (p(c[1:], x, frozenset(seen[c])) if c else 1 / (256 - len(seen[c])))

    return p


def slow_kn(texts, order):
    raw = defaultdict(Counter)
    for t in texts:
        for c, x in contexts(t, order):
            raw[order][c + bytes([x])] += 1
    for o in range(order - 1, 0, -1):
        for g in raw[o + 1]:
            raw[o][g[1:]] += 1

    def discounts(o):
        r = Counter(raw[o].values())
        y = r[1] / max(1, r[1] + 2 * r[2])
        return [0] + [min(k, max(0.0, k - (k + 1) * y * r[k + 1] / r[k])) if r[k] else 0.5 * k for k in (1, 2, 3)]

    ds = {o: discounts(o) for o in range(1, order + 1)}
    by = {o: defaultdict(dict) for o in ds}
    for o in ds:
        for g, n in raw[o].items():
            by[o][g[:-1]][g[-1]] = n

    def p(c, x):
        o = len(c) + 1
        lower = p(c[1:], x) if c else 1 / 256
        found = by[o].get(c)
        if not found:
            return lower
        t, d = sum(found.values()), ds[o]
        gamma = sum(d[min(n, 3)] for n in found.values()) / t
        n = found.get(x, 0)
        return (n - d[min(n, 3)]) / t + gamma * lower

    return p


@pytest.mark.parametrize("kind,slow", [(ngrams.ppm, slow_ppm), (ngrams.kneser_ney, slow_kn)])
def test_models(spark, kind, slow):
    order, train = 4, TEXTS[:6]
    texts = spark.createDataFrame([(t,) for t in train], "text string").withColumn("tag", F.lit(0))
    table = kind(ngrams.counts(texts, order), order, 10_000)
    p = slow(train, order)
    for t in TEXTS:
        flat = np.frombuffer(t.encode(), np.uint8)
        got = table.score(flat, np.array([0, len(flat)]), np.array([0]))[0]
        assert got == pytest.approx(sum(math.log10(p(c, x)) for c, x in contexts(t, order)), abs=1e-4)
    for c, _ in contexts("the cab", order):
        assert sum(p(c, x) for x in range(256)) == pytest.approx(1)


def test_pruned_model_adds_up(spark):
    texts = spark.createDataFrame([("the cat sat on the mat " * 20 + "zq",), ("a hat",)], "text string").withColumn("tag", F.lit(0))
    for kind in (ngrams.ppm, ngrams.kneser_ney):
        table = kind(ngrams.counts(texts, 4), 4, 12)
        assert len(table.keys) < 60
        for start in ("the ca", "zq", "", "q"):
            flat = np.frombuffer(b"".join(start.encode() + bytes([x]) for x in range(256)), np.uint8)
            size = len(start) + 1
            each = table.each(flat, np.arange(257) * size, np.zeros(256, int)).reshape(256, size + 1)
            assert (10 ** each[:, -2]).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("kind", [ngrams.ppm, ngrams.kneser_ney])
def test_larger_corpus_keeps_more_contexts(spark, kind):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    corpus = [" ".join(rng.choice(words, 8)) for _ in range(200)]

    def model(texts, limit):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("tag", F.lit(0))
        keys = kind(ngrams.counts(rows, 4), 4, limit).keys
        return [int((keys >> np.uint64(61) == o).sum()) for o in range(1, 5)]

    def grams(texts):
        return [len({c[4 - o :] + bytes([x]) for t in texts for c, x in contexts(t, 4)}) for o in range(1, 5)]

    small, large = model(corpus[:20], 100_000), model(corpus, 100_000)
    assert all(a >= b for a, b in zip(small, grams(corpus[:20]), strict=True))
    assert all(a >= b for a, b in zip(large, grams(corpus), strict=True)) and large[3] > small[3]
    # a limit that the longest order alone exceeds leaves the others whole
    some, every = model(corpus, grams(corpus)[2]), grams(corpus)
    assert some[3] < every[3] and all(a >= b for a, b in zip(some[:3], every[:3], strict=True))


def test_lm_query(make_docs, sample):
    rows = {r.doc_id: r for r in lm_scoring.score(make_docs(sample), order=4).collect()}
    train = [t or "" for k, t in enumerate(sample) if zlib.crc32(str(k).encode()) % 5 != 1]

    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None]

    c = Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in train]
    p = slow_ppm(lower, 4)
    for k, t in enumerate(sample):
        r, ts = rows[k], tokens(t or "")
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(c[x] > 0 for x in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts))
        if k < 30:
            low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
            assert r.score == pytest.approx(sum(math.log10(p(a, x)) for a, x in contexts(low, 4)), rel=1e-4)


def test_empty_and_untrained(make_docs):
    assert lm_scoring.score(make_docs([])).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = lm_scoring.score(make_docs([(held, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.score == pytest.approx(4 * -math.log10(256))


def test_no_cap_on_contexts(make_docs):
    """720,000 contexts of five letters, nearly all seen once: each symbol of a training text was seen after its context."""
    rng = np.random.default_rng(9)
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 != 1][:60]
    rows = lm_scoring.score(make_docs([(k, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 12_000))) for k in ids])).collect()
    assert len(rows) == 60 and all(r.score > 12_001 * -0.35 for r in rows)
