"""Repeated byte strings of a corpus, removed by prefix-free parsing (see `repeats`).

Defined cases: a null or empty text has no bytes; rows that repeat, doc_id included, count as other places; a text of
fewer than `length` bytes loses nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import repeats
from leafmill.llm.common import released

BYTES = repeats.Kind(repeats.byte_symbols, length=200, k=64, ordered=False)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def dedup(docs: DataFrame, kind: repeats.Kind = BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept has the bytes that stay."""
    texts = repeats.keyed(docs)
    spans = repeats.repeats(docs, kind)

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in released(batches):
            for k in range(0, batch.num_rows, 512):
                part, rows = batch.slice(k, 512), []
                for z, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text, gone = expand(z), repeats.union(found)
                    rows.append((len(text), sum(b - a for a, b in gone), len(gone), without(text, gone)))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = repeats.packed(texts).join(spans, repeats.PLACE, "left")
    doc_id = F.when(F.col("id") != repeats.NO_ID, F.col("id")).alias("doc_id")
    return joined.select(doc_id, "z", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def applied(docs: DataFrame, kind: repeats.Kind = BYTES) -> DataFrame:
    """docs without the repeated strings, all columns kept; bytes of characters cut in two go with their string."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    texts = repeats.keyed(docs, others)
    spans = repeats.repeats(docs, kind)
    more = dict(texts.dtypes).get("more")

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in released(batches):
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                kept = [without(expand(z), repeats.union(found)).decode(errors="ignore") for z, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), *part.columns[3:]], names=["doc_id", "text", *part.schema.names[3:]])

    doc_id = F.when(F.col("id") != repeats.NO_ID, F.col("id")).alias("doc_id")
    joined = repeats.packed(texts).join(spans, repeats.PLACE, "left").select(doc_id, "z", "spans", *(["more"] if more else []))
    out = joined.mapInArrow(run, "doc_id long, text string" + (f", more {more}" if more else ""))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*[own.get(c, F.col(f"more.`{c}`").alias(c)) for c in docs.columns])
