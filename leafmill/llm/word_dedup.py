"""Long runs of words that an earlier document has, removed by a compacted de Bruijn graph of token k-mers.

The graph's nodes are k-mers of words, those that a rolling hash picks (see `repeats`); its edges are the phrases
between them. Edges that always follow each other, and only each other, are compacted into one path by joins (`paths`).
A path has its verdict from its own places: the one of the smallest document stays, and the others go if the words at
their coordinates are those at the first one's, compared by 128-bit digests of the words themselves. At a node with several
edges the graph branches: each of these is a path of its own, and one that goes the way of another in part has the
windows that they share from `repeats`.

Defined cases: a null or empty text has no words; rows with equal doc_id are one document to the rule; a null doc_id is
the smallest; a document of fewer than `length` words loses nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm import repeats
from leafmill.llm.common import cut, released

WORDS = repeats.Kind(repeats.word_symbols, length=50, k=16, ordered=True)
#: Paths are broken before one edge in BREAK, so that ROUNDS doublings find nearly every head; a path that is longer
#: still keeps several edges, with the same result.
BREAK, ROUNDS = 12, 5
EDGE = ["kmer", "content"]


def paths(again: DataFrame, alone: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, th, s, n, kmer, content): places of paths, each named after its first edge.

    Edge u runs into v, and into nothing else, and only u runs into v: then both are in one path. `alone` has the edges
    whose node has no other.
    """
    whole = alone.where("c > 1").select(*EDGE, "c")
    in_text = Window.partitionBy("id", "th").orderBy("s")
    edge, after = F.struct(*EDGE), F.lead(F.struct("s", *EDGE)).over(in_text)
    places = again.join(whole, EDGE).withColumn("after", after)
    nexts = F.when(F.col("after.s") == F.col("s") + F.col("n"), F.struct("after.kmer", "after.content"))
    places = cut(places.select("id", "th", "s", "n", *EDGE, "c", nexts.alias("after")), "places")
    out = places.groupBy(*EDGE, "c").agg(F.min("after").alias("low"), F.max("after").alias("high"), F.count("after").alias("m")).where("m = c and low = high")
    link = out.select(edge.alias("u"), F.col("low").alias("v"), F.col("c"))
    into = places.where("after is not null").groupBy("after").agg(F.countDistinct(edge).alias("ways"), F.count("*").alias("m")).where("ways = 1")
    link = link.join(into.select(F.col("after").alias("v"), "m"), "v").join(whole.select(edge.alias("v"), F.col("c").alias("cv")), "v").where("m = cv and c = cv and u != v")
    link = link.where(F.pmod(F.xxhash64("v"), F.lit(BREAK)) != 0)
    jump = cut(link.select(F.col("v").alias("edge"), F.col("u").alias("head"), F.lit(1).alias("steps")), "links")
    for _ in range(rounds):
        up = jump.select(F.col("edge").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
        jump = jump.join(up, "head", "left").select("edge", F.coalesce("further", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        jump = cut(jump, "paths")
    # the place of each edge is moved onto its path's head; equal (text, path, pass) rows become one
    marked = again.withColumn("edge", edge).join(jump, "edge", "left")
    ordinal = F.row_number().over(in_text) - F.coalesce("steps", F.lit(0))
    marked = marked.withColumn("pass", ordinal).withColumn("path", F.coalesce("head", "edge"))
    merged = marked.groupBy("id", "th", "path", "pass").agg(F.min("s").alias("s"), F.sum("n").cast("int").alias("n"))
    return cut(merged.select("id", "th", "s", "n", "path.*"), "merged")


def covered(docs: DataFrame, kind: repeats.Kind) -> DataFrame:
    """(id, th, spans): the words [a, b) of each text to remove, with the digest that they have to have, if any."""
    texts, length, found = repeats.keyed(docs), kind.length, []

    def sources(again, alone):
        """The first place of each path that has several: that of the smallest document."""
        found.append(paths(again, alone))
        first = found[0].groupBy(*EDGE).agg(F.min(F.struct("id", "th", "s", "n")).alias("first"), F.count("*").alias("c")).where("c > 1")
        return first.select(*EDGE, F.col("first.id").alias("first_id"), "first.*")

    again, dictionary, digests = repeats.verdicts(cut(repeats.phrases(texts, kind), "phrases"), texts, kind, also=sources)
    parts = dictionary.where(F.col("parts").isNotNull()).select(*EDGE, "parts")
    # written, so that its join with the places is one of plain shuffles and a path's many places can be split
    verdict = cut(digests.join(parts, EDGE, "full"), "path-verdicts")
    rows = found[0].join(verdict, EDGE)
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"), F.col("digest")))
    some = F.transform("parts", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.lit(None).cast("binary").alias("digest")))
    rows = rows.select("id", "th", "s", F.explode(F.when(F.col("id") > F.col("first_id"), whole).otherwise(some)).alias("p"))
    span = F.struct((F.col("s") + F.col("p.a")).alias("a"), (F.col("s") + F.col("p.b") - 1 + length).alias("b"), "p.digest")
    return rows.select("id", "th", span.alias("span")).groupBy("id", "th").agg(F.collect_list("span").alias("spans"))


def dedup(docs: DataFrame, kind: repeats.Kind = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept has the words that stay, joined by one space."""
    texts = repeats.keyed(docs)
    spans = covered(docs, kind)

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in released(batches):
            for k in range(0, batch.num_rows, 512):
                part, rows = batch.slice(k, 512), []
                for z, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = expand(z).split()
                    gone = repeats.union([x for x in found or [] if x["digest"] is None or x["digest"] == repeats.words_digest(words[x["a"] : x["b"]])])
                    kept, at = [], 0
                    for a, b in gone:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = repeats.packed(texts).join(spans, repeats.PLACE, "left")
    doc_id = F.when(F.col("id") != repeats.NO_ID, F.col("id")).alias("doc_id")
    return joined.select(doc_id, "z", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
