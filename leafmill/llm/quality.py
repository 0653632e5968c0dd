"""Quality classifier: perplexity under Kneser-Ney models of trusted text, one for each language.

Trusted text is that labelled quality 1. Models (byte grams, `ngrams.kneser_ney`) learn from four fifths of it; the
other fifth sets each language's threshold, a high quantile of its perplexities. Counts are sharded by gram and joined to
their contexts; the finished model, with all contexts, is in files that workers map, so that the documents' grams need
not go to its shards (README has the figures). Each language has counts, discounts and a threshold of its own; one with
too few trusted texts for a quantile (`LEAST` held-out ones) uses those of all trusted text. A model's number has 13
bits, so the `MOST` languages with most trusted texts can have one.

Defined cases: a null or empty text is its end symbol alone; a null lang is a language of its own, without a model;
repeated rows are scored once per row; without labels nothing is rejected; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import ngrams
from leafmill.llm.common import cut

ORDER, MOST, LEAST = 5, ngrams.MAX_TAGS, 20
#: Held-out trusted texts of a language that its threshold keeps: one in a hundred is given up.
QUANTILE = 0.99
#: A short text's perplexity is drawn to its language's mean as if by so many more bytes.
PRIOR = 60
FOLDS, HELD_OUT = 5, 1


def tagged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs with tag: 1.. for the languages with most trusted texts, 0 for the rest."""
    top = trusted.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST).collect()
    tags = {r["lang"]: k for k, r in enumerate(top, 1) if r["count"] >= LEAST * FOLDS}
    if not tags:
        return docs.withColumn("tag", F.lit(0))
    pairs = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    return docs.withColumn("tag", F.coalesce(pairs[F.col("lang")], F.lit(0)))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, kept, text_hash) of each row."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    texts = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    trusted = texts.select("doc_id", "lang").join(good, "doc_id", "left_semi")
    texts = tagged(texts, trusted)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == HELD_OUT
    # the labels grow with the documents: one plan for all sizes, by shuffle, with the text compressed for it
    learn = ngrams.squeezed(texts.where(~held)).join(good.hint("merge"), "doc_id", "left_semi")
    by_tag = cut(ngrams.counts(learn, ORDER), "grams")
    pooled = by_tag.where(F.col("key") > ngrams.mask(ORDER)).select(F.col("key").bitwiseAND(F.lit(ngrams.mask(ORDER))).alias("key"), "n")
    every = by_tag.union(pooled).groupBy("key").agg(F.sum("n").alias("n"))
    model = ngrams.kneser_ney(every, ORDER)
    rows = cut(ngrams.scores(texts.select("doc_id", "lang", "text", "tag", F.col("tag").alias("model"), F.xxhash64("text").alias("text_hash")), model), "scores")
    checked = rows.join(good, "doc_id", "left_semi").where(held)
    nats = -F.col("log10_prob") / F.log10(F.lit(2.0))
    mean = checked.groupBy("model").agg((F.sum(nats) / F.sum(F.col("n_bytes") + 1)).alias("mean"), F.count("*").alias("m"))
    mean = mean.union(checked.agg(F.lit(-1).alias("model"), (F.sum(nats) / F.sum(F.col("n_bytes") + 1)).alias("mean"), F.count("*").alias("m")))
    bits = (nats + F.col("mean") * PRIOR) / (F.col("n_bytes") + 1 + PRIOR)
    # at most MOST + 2 rows; model -1 stands for all
    both = checked.withColumn("model", F.explode(F.array("model", F.lit(-1)))).join(F.broadcast(mean), "model")
    limits = both.groupBy("model", "mean", "m").agg(F.percentile_approx(bits, quantile, 100_000).alias("limit")).where(f"model = -1 or m >= {LEAST}")
    limits = {r["model"]: (r["mean"], r["limit"]) for r in limits.collect()}
    if not limits:
        return rows.select("doc_id", "lang", "n_bytes", F.pow(F.lit(2.0), nats / (F.col("n_bytes") + 1)).alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"), "text_hash")
    chosen = F.when(F.col("model").isin([m for m in limits if m > 0]), F.col("model")).otherwise(F.lit(-1))
    pick = lambda k: F.create_map(*[F.lit(x) for m, v in limits.items() for x in (m, float(v[k]))])[F.col("model")]
    out = rows.withColumn("model", chosen).withColumn("mean", pick(0))
    return out.select(
        "doc_id",
        "lang",
        "n_bytes",
        F.pow(F.lit(2.0), bits).alias("perplexity"),
        (F.pow(F.lit(2.0), pick(1))).alias("threshold"),
        (F.pow(F.lit(2.0), bits) <= F.pow(F.lit(2.0), pick(1))).alias("kept"),
        "text_hash",
    )
