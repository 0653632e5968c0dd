"""A training corpus from raw documents: what is trusted, clean, once, without repeats, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of docs. Rows are matched by doc_id and a hash of their text, so rows that share
both share a verdict. A null doc_id, lang, source or text is kept as such or as an empty text; an empty table passes
through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import packing, quality, rules, simhash, suffix_dedup
from leafmill.llm.common import cut, documents

#: SQL can't express a language model, a fingerprint or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def _same(docs: DataFrame, chosen: DataFrame):
    return docs["doc_id"].eqNullSafe(chosen["doc_id"]) & (docs["_hash"] == chosen["text_hash"])


def trusted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    verdicts = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = verdicts.where("kept").select("doc_id", "text_hash")
    marked = _marked(docs)
    return marked.join(kept, _same(marked, kept), "left_semi").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that many documents of their host share."""
    kept = rules.judge(docs).where("kept").select("doc_id", "text_hash", "common").dropDuplicates(["doc_id", "text_hash"])
    marked = _marked(docs)
    found = marked.join(kept, _same(marked, kept)).drop(kept["doc_id"])
    text = F.when(F.col("common").isNotNull(), rules.without_lines(F.col("text"), F.col("common"))).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    return found.withColumn("n_chars", F.when(F.col("common").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, 0.8 of them shared or more."""
    chosen = simhash.representatives(simhash.near_copies(docs))
    marked = _marked(docs)
    kept = marked.join(chosen, _same(marked, chosen), "left_semi")
    # repeated rows become one where they are read, so they are no hot group
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that they share."""
    return suffix_dedup.applied(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in training sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", trusted),
    ("quality rules", clean),
    ("simhash near-dedup", once),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
