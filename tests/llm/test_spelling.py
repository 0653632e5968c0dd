"""Spelling variants against a plain comparison of all words."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from leafmill.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def slow(n):
    form, count = {}, {}
    for w in n:
        some = [v for v in n if near(w, v)]
        count[w], best = len(some), min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def text_of(n, rng):
    words = [w for w, k in n.items() for _ in range(k)]
    rng.shuffle(words)
    return words


@pytest.mark.parametrize("limit", [spelling.GROUP, 3])
@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyzéüÿ×", "ab"])
def test_as_plain_comparison(spark, make_docs, alphabet, limit):
    """limit 3 cuts groups down to single positions; two letters make runs, where one edit has several places."""
    rng = random.Random(len(alphabet) + limit)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    n = Counter({w: rng.choice([5, 6, 30, 200]) for w in base})
    for w in base:
        for _ in range(4):
            i, c = rng.randrange(len(w) + 1), rng.choice(alphabet)
            n[rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])] += rng.choice([1, 5, 25])
    words = text_of(n, rng)
    docs = [(k, " ".join(words[k::50]).title()) for k in range(50)] + [(None, None), (0, ""), (1, " 12 ,"), (None, "nullid word " * 6), (9, "a" * 3000 + " "), *((9, "a" * 2999 + "b ") for _ in range(6)), *((10, "a" * 3000) for _ in range(5))]
    got = sorted((tuple(r) for r in spelling.variants(make_docs(docs), limit=limit).collect()))
    assert got == slow(slow_words(docs))


def test_typos_are_made(make_docs):
    docs = [(k, f"word{chr(97 + k % 26)}longer uncommon " * 5) for k in range(400)]
    got = {r["word"]: r["n"] for r in spelling.words(make_docs(docs)).collect()}
    assert got == slow_words(docs)
    assert len(got) > 27


def test_chains_lead_to_the_last_form(spark, make_docs):
    words = {"abcdef": 10, "abcdeg": 80, "abcdhg": 640, "abcihg": 5120}
    docs = [(k, " ".join([w] * 5)) for w, n in words.items() for k in range(n // 5)]
    n = slow_words(docs)
    got = sorted(tuple(r) for r in spelling.variants(make_docs(docs)).collect())
    assert got == slow(n)
    assert {r[2] for r in got if r[0] in ("abcdef", "abcdeg")} == {"abcihg"}


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 64, 100):
        values = rng.permutation(size)
        tree = spelling.Wavelet(values)
        q = rng.integers(0, size + 1, (200, 4))
        low, high, first, last = q[:, :2].min(1), q[:, :2].max(1), q[:, 2:].min(1), q[:, 2:].max(1)
        query, value = tree.report(low, high, first, last)
        for k in range(200):
            part = values[low[k] : high[k]]
            assert sorted(value[query == k]) == sorted(part[(part >= first[k]) & (part < last[k])])


def test_groups_stay_small(spark):
    """Words that all share a half: groups are cut until they fit, and no pair is lost."""
    n = {f"prefixprefix{a}{b}{c}": 5 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    frame = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    sizes = [r["count"] for r in spelling.dealt(frame, 64).groupBy("key").count().collect()]
    assert max(sizes) <= 64
    got = Counter(r["word"] for r in spelling.neighbours(frame, 64).collect())
    assert len(got) == 512 and set(got.values()) == {21}
    small = Counter(r["word"] for r in spelling.neighbours(frame, 4096, cells=64).collect())
    assert small == got


def test_empty(make_docs):
    assert spelling.variants(make_docs([])).count() == 0
