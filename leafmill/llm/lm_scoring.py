"""Log-probability of documents under a language model learnt from the corpus, beside a unigram base line.

Model: prediction by partial matching over bytes (`ngrams.ppm`), learnt from all training documents: it has all
their contexts, in files that workers map. Base: word unigrams with add-half smoothing. Words that are common in the training part (at most `COMMON` of them) have their
counts in every worker; the others meet their counts in a join.

Defined cases: a null or empty text is one end token; repeated rows count and are scored once per row; without training
documents N and V are 0 and the model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import ngrams
from leafmill.llm.common import cut, key_text, merged, raw, slices

ORDER = 6
#: Words that are broadcast, at most.
COMMON = 100_000
FOLDS, HELD_OUT = 5, 1


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the words of all texts, A-Z lowered; words are binary."""

    def run(batches):
        for batch in merged(batches, 8 << 20):
            found: Counter = Counter()
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found.update(text.lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int = COMMON) -> dict[bytes, int]:
    """The words seen at least so often that they are `most` at most."""
    sizes = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("b")).agg(F.count("*").alias("d"), F.min("n").alias("n")).collect()  # 512 rows at most
    total, least = 0, None
    for row in sorted(sizes, key=lambda r: -r["b"]):
        total += row["d"]
        if total > most:
            break
        least = row["n"]
    if least is None:
        return {}
    table = counts.where(F.col("n") >= least).toArrow()
    return dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))


def scores(texts: DataFrame, counts: DataFrame, documents: int, table: ngrams.Table) -> DataFrame:
    """texts with n_tokens, n_known, train_tokens, base_score and score in place of text."""
    spark = texts.sparkSession
    model = ngrams.shipped(spark, table)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + documents, total["v"] + (documents > 0)
    floor = math.log10(n + 0.5 * (v + 1))
    end = math.log10(documents + 0.5)
    sent = spark.sparkContext.broadcast({w: math.log10(c + 0.5) for w, c in common_words(counts).items()})
    others = [(c, t) for c, t in texts.dtypes if c != "text"]
    names = [c for c, _ in others]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in others), "score double, n_tokens long, known long, sum double, rare array<struct<word: binary, tf: int>>"])

    def run(batches):
        get, lm = sent.value.get, model()
        kind = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))
        for batch in slices(batches, 1 << 20):
            rows = []
            column = batch.column(batch.schema.get_field_index("text"))
            flat, offsets = raw(column)
            score = lm.score(ngrams.LOWER[flat], offsets, np.zeros(batch.num_rows, np.int64))
            for text in column.cast(pa.binary()).to_pylist():
                words = text.lower().split()
                values = [get(w) for w in words]
                rare = Counter([w for w, x in zip(words, values, strict=True) if x is None]) if None in values else {}
                common = [x for x in values if x is not None] if rare else values
                rows.append((len(words) + 1, len(common) + (documents > 0), math.fsum(common) + end, [{"word": w, "tf": c} for w, c in rare.items()]))
            cols = zip(*rows, strict=True)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(score), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), kind), strict=True))], names=[*names, "score", "n_tokens", "known", "sum", "rare"])

    part = cut(texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "tokens")
    rare = part.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts, "word", "left")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"))
    joined = part.join(more, "row", "left")
    return joined.select(
        *names,
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        "score",
    )


def score(docs: DataFrame, order: int = ORDER, limit: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    texts = key_text(docs).select("doc_id", held_out().alias("held_out"), "text")
    train = texts.where(~F.col("held_out")).withColumn("tag", F.lit(0))
    counts = cut(word_counts(train), "words")
    table = ngrams.ppm(cut(ngrams.counts(train, order, lower=True), "grams"), order, limit)
    return scores(texts, counts, train.count(), table)
