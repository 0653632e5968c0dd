"""Every operator on clashing columns, null and repeated rows, a text of a million characters, and no rows at all."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontamination, edit_embedding, fill_middle, lm_scoring, packing, pieces, quality, rules, simhash, spelling, suffix_dedup, toxicity, word_dedup

BPE, UNIGRAM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Names that operators give to columns of their own.
CLASHES = "fp key node id th z s n o w h kmer content parts want more row tag held_out lines common gone text_hash root score model piece start length _task _rank bucket place least band kept perplexity edited found".split()


def no_labels(docs):
    return docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")


def items(docs):
    return docs.sparkSession.createDataFrame([(1, "same text same text same text same text same text same"), (None, "w1 w2"), (3, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "op1": edit_embedding.edited,
    "op2": lambda d: pieces.digests(pieces.decode(pieces.encode(d, UNIGRAM), UNIGRAM)),
    "op3": lambda d: quality.classify(d, no_labels(d)),
    "op4": lambda d: toxicity.score(d, no_labels(d)),
    "op5": rules.judge,
    "op6": lambda d: packing.pack(packing.pieces(d, BPE)).where("piece = 0").drop("sequence_id", "offset"),
    "op7": simhash.near_duplicates,
    "op7 stage": simhash.near_copies,
    "op8": lambda d: suffix_dedup.digests(suffix_dedup.dedup(d)),
    "op9": lambda d: word_dedup.digests(word_dedup.dedup(d)),
    "op10": lm_scoring.score,
    "op12": lambda d: decontamination.digests(decontamination.search(d, items(d))),
    "op13": lambda d: fill_middle.digests(fill_middle.transform(d)),
}


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(make_docs, name):
    long = " ".join(f"w{i % 50_021}" for i in range(170_000))
    assert len(long) > 1_000_000
    texts = [(None, None), (None, "same text " * 40), (None, "same text " * 40), (1, ""), (2, "tie " * 60), (2, "tie " * 60), (2, "another text of this id"), (3, long), (4, " \n\t "), (5, "é😀 漢字 " * 30)]
    docs = make_docs(texts)
    plain = rows_of(OPERATORS[name](docs))
    assert len(plain) == len(texts)
    extra = docs
    for c in CLASHES:
        extra = extra.withColumn(c, F.lit("x"))
    assert rows_of(OPERATORS[name](extra)) == plain
    assert OPERATORS[name](make_docs([])).count() == 0


def test_odd_tables_of_words(make_docs):
    """Operator 11 has a row for each word instead of each document."""
    docs = make_docs([(None, None), (None, "same text " * 40), (1, "longer " * 6), (1, "longer " * 6), (2, "abcdef" * 200_000), (3, " \n\t ")])
    plain = rows_of(spelling.variants(docs))
    assert [(r[0], r[3]) for r in plain] == [("longer", 12)]
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("x"))
    assert rows_of(spelling.variants(docs)) == plain


def test_ties_of_the_sample(make_docs, spark):
    """Equal texts under many ids are one text of the sample, and equal rows one row."""
    rows = [(k, "alike " * 30) for k in range(60)] * 2 + [(100 + k, f"text {k} own words") for k in range(60)]
    labels = spark.createDataFrame([(k, 1, 1) for k in range(60)] + [(100 + k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    found, y, weight = toxicity.sample(make_docs(rows), labels)
    assert (y == 1).sum() == 1 and (y == 0).sum() > 20 and len(found) == len(weight) == len(y)
