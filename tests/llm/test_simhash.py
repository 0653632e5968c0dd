import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from leafmill.llm import simhash
from leafmill.llm.common import cut


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    label = list(range(len(fps)))
    again = True
    while again:
        again = False
        for i in range(len(fps)):
            for j in range(i):
                if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
                    again = True
    return label


def test_whole_table(make_docs, sample):
    rnd = random.Random(0)
    texts = sample[:60] + sample[10:14]
    for k in range(40):
        words = sample[20].split()
        words[rnd.randrange(len(words))] = "x" * (k % 5)
        texts.append(" ".join(words))
    rows = {r.doc_id: r for r in simhash.near_duplicates(make_docs(texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [rows[k].fingerprint for k in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [rows[k].component_id for k in range(len(texts))] == slow_components(fps)


@pytest.mark.parametrize("block", [3, 2048])
def test_links_connect_all(spark, block):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(5)}
    for _ in range(120):
        x = rnd.choice(sorted(fps))
        for _ in range(rnd.randint(1, 4)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block)).collect()
    root = {x: x for x in signed} | {r.node: r.root for r in found}
    want = slow_components(fps)
    groups, mine = {}, {}
    for k, x in enumerate(signed):
        groups.setdefault(want[k], set()).add(k)
        mine.setdefault(root[x], set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def slow_likeness(texts, least):
    """The least place that each text is linked to by Jaccard likeness of five-word shingles."""
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("block", [4, 2048])
def test_near_copies(make_docs, sample, block):
    """Copies with a few words changed are linked, whatever the size of their group; others are not."""
    rnd = random.Random(1)
    texts = sample[:60]
    for k in range(120):
        words = (texts[10 + k % 5] + " " + texts[20 + k % 5]).split()
        for _ in range(max(1, len(words) // 100)):
            words[rnd.randrange(len(words))] = f"x{k}"
        texts.append(" ".join(words))
    rows = {r.doc_id: r.root for r in simhash.near_copies(make_docs(texts).withColumn("fp", F.lit(1)).withColumn("node", F.lit("n")), block=block).collect()}
    assert len(rows) == len(texts)
    for least, finer in ((0.85, True), (0.6, False)):
        label = slow_likeness(texts, least)
        pairs = {(label[k], rows[k]) for k in range(len(texts))}
        assert len(pairs) == len({p[0 if finer else 1] for p in pairs})


def test_fingerprint_distance_follows_likeness():
    """Recall at 0.8 and a little above, and what is linked far below."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(3000)])
    found = {True: [], False: []}
    for k in range(400):
        a = rng.choice(words, 300)
        b = np.where(rng.random(300) < (0.02 if k % 2 else 0.08), rng.choice(words, 300), a)
        x, y = (simhash.shingles(" ".join(t).encode()) for t in (a, b))
        like = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        (f, ks), (g, kt) = simhash.wide_fingerprint(x), simhash.wide_fingerprint(y)
        linked = (ks == kt).any() and (int.from_bytes(f, "big") ^ int.from_bytes(g, "big")).bit_count() <= simhash.LIKE
        if like >= 0.8 or like < 0.55:
            found[like >= 0.8].append(linked)
    assert np.mean(found[True]) >= 0.95 and np.mean(found[False]) <= 0.02


def test_planes_against_plain_distances():
    rng = np.random.default_rng(4)
    for words, radius in ((1, 1), (1, 2), (1, 3), (1, 7), (4, 46), (4, 60)):
        fps = rng.integers(0, 1 << 63, (300, words), np.uint64)
        for k in range(0, 300, 2):  # neighbours at all distances around the radius
            fps[k + 1] = fps[k]
            for bit in rng.choice(64 * words, min(64 * words, rng.integers(0, 2 * radius + 2)), replace=False):
                fps[k + 1, bit // 64] ^= np.uint64(1 << int(bit % 64))
        plain = [[(int(a) ^ int(b)).bit_count() for b in map(lambda r: int.from_bytes(r.astype(">u8").tobytes()), fps)] for a in map(lambda r: int.from_bytes(r.astype(">u8").tobytes()), fps)]
        want = {(i, j) for i in range(300) for j in range(300) if plain[i][j] <= radius}
        q, p = simhash.Planes(fps).within(fps, radius)
        assert set(zip(q.tolist(), p.tolist(), strict=True)) == want and len(q) == len(want)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A path of 1,000 nodes, a star whose middle is the largest, and a loop with itself."""
    from leafmill.llm import components as cc

    written = []
    monkeypatch.setattr(cc, "cut", lambda df, name="step": (written.append(name), cut(df, name))[1])
    edges = [(k, k + 1) for k in range(1000)] + [(5000, 2000 + k) for k in range(50)] + [(7, 7), (None, 3)]
    root = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(root) == set(range(1001)) | {5000} | set(range(2000, 2050))
    assert len({root[k] for k in range(1001)}) == 1 and len({root[5000], *(root[2000 + k] for k in range(50))}) == 1 and root[0] != root[5000]
    assert len(written) <= 3 * 12


def test_empty_table(make_docs):
    assert simhash.near_copies(make_docs([])).count() == 0
    assert len({r.root for r in simhash.near_copies(make_docs([(None, None), (4, ""), (4, " ")])).collect()}) == 1
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(make_docs([(None, None), (4, "")])).collect()] == [4, 4]
