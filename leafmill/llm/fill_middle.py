"""Fill-in-middle order of a document's lines, and the way back.

All of it is DataFrame functions. A text is an array of lines (`regexp_extract_all`); four numbers from the digest of its
doc_id give two cuts and the form; slices of the array, joined behind sentinels, are the output. `restored` finds the
sentinels again and puts the three parts back in order.

Defined cases: a null or empty text has no lines and stays plain, and so does a text that holds a sentinel; a null doc_id
is an empty string to the digest; rows with equal doc_id have equal draws; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): of 100 texts about `rate` are rearranged, `spm` of these 100 with the suffix first."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed), 1)))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(LINE), F.lit(0)))
    n = F.size("units")
    rows = rows.select("doc_id", "text", "units", "h3", "h4", n.alias("n"), F.pmod("h1", n + 1).cast("int").alias("x"), F.pmod("h2", n + 1).cast("int").alias("y"))
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    part = lambda start, count: F.array_join(F.slice("units", start, count), "")
    rows = rows.select("doc_id", "text", F.col("n").cast("long"), form.alias("form"), part(F.lit(1), low).alias("pre"), part(low + 1, high - low).alias("mid"), part(high + 1, F.col("n") - high).alias("suf"))
    psm = F.concat(F.lit(PREFIX), "pre", F.lit(SUFFIX), "suf", F.lit(MIDDLE), "mid")
    spm_text = F.concat(F.lit(SUFFIX), "suf", F.lit(PREFIX), "pre", F.lit(MIDDLE), "mid")
    moved = F.col("form") != "plain"
    chars = lambda c: F.when(moved, F.length(c).cast("long"))
    output = F.when(~moved, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_text)
    return rows.select("doc_id", "n", "form", chars("pre").alias("prefix_chars"), chars("mid").alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text that `output` was made from. Its parts hold no sentinel, so the first of each kind is where a part ends."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    parts = lambda mark: (F.substring(F.substring_index(head, mark, 1), 4, 1 << 30), F.substring_index(head, mark, -1))
    (pre, suf), (suf_first, pre_last) = parts(SUFFIX), parts(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(pre, middle, suf)).otherwise(F.concat(pre_last, middle, suf_first))


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
