import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from leafmill.llm import quality, rules
from leafmill.llm.common import cut

from .test_repeats import slow_bytes
from .test_simhash import slow_likeness

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    one = cut(cp.trusted(spark, docs, SF))
    assert one.columns == names and {r.doc_id for r in one.select("doc_id").collect()} == kept and one.count() == len(kept)
    verdict = {r.doc_id: r for r in rules.judge(one).collect()}
    two = cut(cp.clean(spark, one, SF))
    assert two.columns == names and {r.doc_id for r in two.collect()} == {k for k, r in verdict.items() if r.kept}
    rows = two.orderBy("doc_id").collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    three = cut(cp.once(spark, two, SF))
    left = {r.doc_id for r in three.collect()}
    assert three.columns == names and three.count() == len(left)
    # texts that share 0.9 of their five-word shingles are one, those that share less than 0.6 are not
    alike, apart = slow_likeness([r.text for r in rows], 0.9), slow_likeness([r.text for r in rows], 0.6)
    kept = [i for i, r in enumerate(rows) if r.doc_id in left]
    assert len({alike[i] for i in kept}) == len(kept) and {apart[i] for i in kept} == set(apart)
    four = cut(cp.without_repeats(spark, three, SF))
    assert four.columns == names
    source, out = three.orderBy("doc_id").collect(), four.orderBy("doc_id").collect()
    assert [r.n_chars for r in out] == [len(r.text) for r in out]
    for r, (n, gone, _, _) in zip(out, slow_bytes([r.text for r in source]), strict=True):
        assert n - gone - 6 <= len(r.text.encode()) <= n - gone
    five = cp.packed(spark, four, SF)
    assert five.where("piece = 0").count() == len(out)
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, make_docs, stage):
    odd = [(None, None), (None, None), (1, "", None, None), (2, "word " * 20_000), (2, "word " * 20_000), (2, "other text"), (3, "x" * 30_000)]
    for rows in (odd, []):
        docs = make_docs(rows).withColumn("tag", F.lit(1)).withColumn("row", F.lit("r")).withColumn("more", F.lit(2.0)).withColumn("h", F.lit("z"))
        out = cp.STAGES[stage][1](spark, docs, SF)
        assert stage == 4 or out.columns == docs.columns
        assert len(out.collect()) <= len(rows) or stage == 4
