"""Queries whose semantics need a fold, a tree or a grammar: Arrow functions over rows, no shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import english, web
from leafmill.operators import html, segment
from leafmill.plans.registry import query, table


@query()
def x7_page_blocks(spark, sf):
    # not deterministic to the optimizer, which would else parse a page once for the filter and once for the rest
    read_page = html.read_page.asNondeterministic()
    read = table(spark, sf, "pages").select("page_id", web.site_of(web.host_of(F.col("url"))).alias("site"), read_page("html", "url").alias("p"))
    fits = read.where("p.status = 'SUCCESS'")
    return fits.select("page_id", "site", F.col("p.title").alias("title"), F.posexplode("p.blocks").alias("ord", "b")).select("page_id", "site", "title", "ord", "b.kind", "b.text")


@query()
def x1_page_status(spark, sf):
    read = table(spark, sf, "pages").select("page_id", html.read_page("html", "url").alias("p"))
    return read.select("page_id", "p.status", "p.title", "p.next_url", F.size("p.blocks").alias("n_blocks"))


@query()
def s11_imports(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.import_page("html", "url").alias("r")).select("page_id", "r.*")


@query()
def k1_paragraphs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(segment.plain_paragraphs("text")).alias("para", "text"))


@query()
def k3_chapters(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.posexplode(segment.plain_chapters("source", "text")).alias("chapter", "c"))
    return found.select("doc_id", "chapter", "c.title", F.size("c.paragraphs").alias("n_paragraphs"))


@query()
def k6_chunks(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.posexplode(segment.spoken_chunks("text")).alias("chunk", "c"))
    return found.select("doc_id", "chunk", "c.start", "c.end", "c.text")


@query()
def g4_english_numbers(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id", english.spoken_english("text").alias("spoken"))


@query("""WITH n AS (SELECT unnest(range(1, 4000)) AS i), r AS (SELECT i, ['', 'M', 'MM', 'MMM'][i // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][i // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][i // 10 % 10 + 1]
    || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][i % 10 + 1] AS w FROM n), d AS (SELECT doc_id, unnest(regexp_extract_all(replace(upper(text), 'IN', 'XI'), '[\\p{L}\\p{N}_]+')) AS numeral FROM documents)
    SELECT doc_id, numeral, i::INT AS value FROM d LEFT JOIN r ON numeral = w WHERE regexp_full_match(numeral, '[IVXLCDM]+')""")
def g7_roman(spark, sf):
    text = F.replace(F.upper("text"), F.lit("IN"), F.lit("XI"))
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(text, F.lit("(?<![\\p{L}\\p{N}_])([IVXLCDM]+)(?![\\p{L}\\p{N}_])"), F.lit(1))).alias("numeral"))
    return words.select("doc_id", "numeral", english.roman_value("numeral").alias("value"))
