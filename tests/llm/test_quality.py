import math
import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import quality

from .test_ngrams import contexts, slow_kn

SF = "/root/testdata/sf0.01"


def test_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(docs.withColumn("kept", F.lit(0)), labels)
    rows = {(r.quality, r.kept): r["count"] for r in out.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    good, bad = rows.get((1, True), 0), rows.get((0, False), 0)
    assert good >= 0.98 * (good + rows.get((1, False), 0))
    assert bad >= 0.6 * (bad + rows.get((0, True), 0))


def test_against_slow_form(spark, make_docs):
    """Perplexity, threshold and verdict of every row, language by language, by the plain model of test_ngrams."""
    rnd = random.Random(4)
    rows, labels = [], []
    for k in range(640):
        lang = ("aa", "bb", "cc", None)[k % 4 if k % 7 else 2]
        letters = {"aa": "abc de", "bb": "xyz uv", "cc": "mno pq", None: "rst"}[lang]
        rows.append((k, "".join(rnd.choice(letters if k % 11 else "kjq!?") for _ in range(rnd.randint(0, 25))), lang))
        if k % 11 and lang is not None and (lang != "cc" or k % 8 == 0):  # few trusted texts of cc
            labels.append((k, 1, 0))
    rows += [(640, None, "aa"), (641, "abc de" * 20, "dd"), (None, "abc", "aa"), rows[3]]
    docs = make_docs(rows).withColumn("text_hash", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("perplexity", F.lit(0))
    got = quality.classify(docs, spark.createDataFrame([*labels, labels[0], (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    held = {r.doc_id for r in spark.range(642).where(F.pmod(F.xxhash64("id"), F.lit(quality.FOLDS)) == quality.HELD_OUT).select(F.col("id").alias("doc_id")).collect()}
    good = {k for k, _, _ in labels}
    by_lang = {}
    for k, t, lang in rows[:640]:
        if k in good:
            by_lang.setdefault(lang, []).append((k, t))
    of = {lang: lang if lang is not None and len(x) >= quality.LEAST * quality.FOLDS else "all" for lang, x in by_lang.items()}
    assert set(of.values()) == {"aa", "bb", "all"}
    learn = {m: [t for lang, x in by_lang.items() for k, t in x if k not in held and m in ("all", of[lang])] for m in ("aa", "bb", "all")}
    model = {m: slow_kn(x, quality.ORDER) for m, x in learn.items()}

    def bits(t, m):
        return -sum(math.log2(model[m](c, x)) for c, x in contexts(t or "", quality.ORDER))

    checked = {m: [] for m in model}
    for lang, x in by_lang.items():
        for k, t in x:
            if k in held:
                b = (bits(t, of[lang]), len(t.encode()) + 1)
                checked["all"].append(b)
                if of[lang] != "all":
                    checked[of[lang]].append(b)
    mean = {m: sum(b for b, _ in x) / sum(n for _, n in x) for m, x in checked.items()}
    smooth = lambda b, n, m: (b + mean[m] * quality.PRIOR) / (n + quality.PRIOR)
    limit = {}
    for m, x in checked.items():
        values = sorted(smooth(b, n, m) for b, n in x)
        limit[m] = values[math.ceil(quality.QUANTILE * len(values)) - 1]
    assert len(got) == len(rows)
    want = {}
    for k, t, lang in rows:
        m = of.get(lang, "all")
        s = m if m != "all" and len(checked[m]) >= quality.LEAST else "all"
        x = smooth(bits(t, m), len((t or "").encode()) + 1, s)
        want[k, t, lang] = (2**x, 2 ** limit[s], x <= limit[s] + 1e-9)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        perplexity, threshold, kept = want[r.doc_id, texts[r.doc_id], r.lang]
        assert r.perplexity == pytest.approx(perplexity, rel=1e-4) and r.threshold == pytest.approx(threshold, rel=1e-4)
        assert r.kept == kept or abs(perplexity - threshold) < 1e-3 * threshold


def test_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(make_docs([(None, None), (1, "a", None), (1, "a", None)]), none).collect()
    assert len(out) == 3 and all(r.kept for r in out)
    assert quality.classify(make_docs([]), none).count() == 0
