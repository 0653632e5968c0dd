"""Fill-in-middle: outputs by a plain form, and the exact way back."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import fill_middle


def slow(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = [None, "", "\n", "\n\n\n", "no end", "a\nb\r\nc\x0bd", "<", "<<\nP>\n<", "x<P>y\nz", "<M>", "é😀\n漢字\n" * 5, "ends in <\n<\nS>x", "a b\x85c\n", "x" * 100_000]


def rows_of(spark, texts, **more):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "of no\nid\n"), (7, "again\nof 7\n")], "doc_id long, text string")
    out = fill_middle.transform(docs, **more)
    return docs.collect(), out.withColumn("restored", fill_middle.restored(F.col("form"), F.col("output"))).collect()


def check(docs, rows, **more):
    assert sorted(((r["doc_id"], *slow(*r, **more)) for r in docs), key=str) == sorted((tuple(r)[:6] for r in rows), key=str)
    assert sorted(((r["doc_id"], r["text"] or "") for r in docs), key=str) == sorted(((r["doc_id"], r["restored"]) for r in rows), key=str)


def test_odd_texts(spark, sample):
    for more in ({}, {"rate": 40, "spm": 0}, {"spm": 100}):
        docs, rows = rows_of(spark, ODD + sample, **more)
        check(docs, rows, **more)
    assert {r["form"] for r in rows} == {"plain", "spm"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="<>PSM\nab", max_size=30), min_size=20, max_size=60))
def test_any_text(spark, texts):
    check(*rows_of(spark, texts))


def test_query_is_the_digest(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\n"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fill_middle.digests(fill_middle.transform(docs)).collect()}
    assert rows[1]["restored_sha256"] == hashlib.sha256(b"a\nb\nc\n").hexdigest()
    assert rows[1]["output_sha256"] == hashlib.sha256(slow(1, "a\nb\nc\n")[4].encode()).hexdigest()
    assert tuple(rows[2])[1:5] == (0, "plain", None, None)
