"""Queries of graphs, splits, outlines, lines of pages, paragraphs across pages, hosts and word lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.functions import hosts
from leafmill.operators import flow, graph, lines, outline, splits
from leafmill.plans.registry import query, table
from leafmill.sources import lexicons


@query("""WITH RECURSIVE n AS (SELECT g, p_partkey AS node, p_size FROM part, (VALUES (1), (2)) v(g) WHERE p_partkey % 10 <> 7), e AS (SELECT a.g, a.node, b.node AS needs FROM n a JOIN n b ON a.g = b.g AND (b.node = (a.node - a.g) // 2 OR b.node = (a.node + a.g) // 3)),
    r AS (SELECT g, node FROM n WHERE p_size = 50 UNION SELECT e.g, e.needs FROM r JOIN e ON r.g = e.g AND r.node = e.node) SELECT g AS graph, node FROM r""")
def v13_needed_nodes(spark, sf):
    rows = table(spark, sf, "part").where("p_partkey % 10 <> 7").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("graph"), F.col("p_partkey").alias("node"), "p_size")
    name = lambda c: F.concat(F.lit("t"), c)
    inputs = F.array(name(F.expr("(node - graph) div 2")), name(F.expr("(node + graph) div 3")), F.lit(""))
    edges, made = graph.producers(rows.select("graph", "node", inputs.alias("inputs"), F.array(name(F.col("node"))).alias("outputs")))
    wanted = rows.where("p_size = 50").select("graph", name(F.col("node")).alias("name"))
    return graph.reachable(edges, made.join(wanted.hint("merge"), ["graph", "name"]).select("graph", "node"))


def _spark(columns: list[str]) -> list[str]:
    """The SQL of columns with whole division as Spark has it."""
    return [c.replace("//", "div") for c in columns]


_LINES = "SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def _lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, i, length(text) AS n, length(text) % 9 = 0 AS heading FROM ({_LINES})),
    s AS (SELECT doc_id, i, n AS size, 0 AS part FROM l WHERE i = 0 UNION ALL SELECT l.doc_id, l.i, CASE WHEN size >= 1500 OR (heading AND size >= 500) THEN n ELSE size + n END, CASE WHEN size >= 1500 OR (heading AND size >= 500) THEN part + 1 ELSE part END FROM s JOIN l ON l.doc_id = s.doc_id AND l.i = s.i + 1)
    SELECT doc_id, i, part FROM s""")
def n4_size_parts(spark, sf):
    rows = _lines(spark, sf).select("doc_id", F.col("i").alias("line"), F.length("text").alias("n"), (F.length("text") % 9 == 0).alias("heading"))
    return splits.by_size(rows, "doc_id", "line", "n", 1500, "heading", 500).select("doc_id", "i", "part")


_LAID_ROWS = ["length(text) % 9 = 0 AS keep", "CASE WHEN i % 11 IN (4, 5, 6) THEN i // 11 END AS block", "20 * ((length(text) + 59) // 60) + CASE WHEN i % 37 = 0 THEN 450 ELSE 0 END AS height"]
_LAID = ", ".join(_LAID_ROWS)


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, i, {_LAID} FROM ({_LINES})), p AS MATERIALIZED (SELECT doc_id, i, coalesce(sum(height) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, NOT coalesce(lag(keep) OVER w, false) AND NOT coalesce(block = lag(block) OVER w, false) AS may, height FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    q AS MATERIALIZED (SELECT doc_id, i, b, may FROM p UNION ALL SELECT doc_id, max(i) + 1, max(b + height), true FROM p GROUP BY doc_id),
    n AS MATERIALIZED (SELECT p.doc_id, p.i, coalesce(max(q.i) FILTER (q.may), max(q.i), p.i + 1) AS next FROM p LEFT JOIN q ON q.doc_id = p.doc_id AND q.i > p.i AND q.b <= p.b + 400 GROUP BY p.doc_id, p.i),
    s AS (SELECT doc_id, 0::BIGINT AS i FROM p WHERE i = 0 UNION ALL SELECT n.doc_id, n.next FROM s JOIN n ON s.doc_id = n.doc_id AND s.i = n.i)
    SELECT p.doc_id, p.i, (count(s.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) - 1)::INT AS part FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.i = p.i""")
def k10_pages(spark, sf):
    rows = _lines(spark, sf).selectExpr("doc_id", "i AS line", *_spark(_LAID_ROWS))
    return splits.pages(rows, "doc_id", "line", "height", 400, "keep", "block").select("doc_id", "i", "part")


_TREE_ROWS = [
    "p_partkey AS node", "CASE WHEN p_partkey // (doc + 2) > 0 THEN p_partkey // (doc + 2) END AS parent", "p_partkey * 7 % 5 AS ord",
    "CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE 'T' || p_partkey END AS title", "p_partkey % 397 - 1 AS page", "p_size * 1.5 AS top",
]
_TREE = ", ".join(_TREE_ROWS)
_WHOLE = f"""tree AS (SELECT doc, {_TREE} FROM part, (VALUES (1), (2)) v(doc)), step AS (SELECT *, lpad(ord::VARCHAR, 10, '0') || '.' || lpad(node::VARCHAR, 19, '0') || '/' AS s FROM tree),
    t AS (SELECT doc, node, 1 AS level, s AS path FROM step WHERE parent IS NULL UNION ALL SELECT c.doc, c.node, level + 1, path || s FROM t JOIN step c ON c.doc = t.doc AND c.parent = t.node)
    SELECT t.doc, row_number() OVER (PARTITION BY t.doc ORDER BY path) AS seq, level, node, title, page, top::DOUBLE AS top FROM t JOIN tree USING (doc, node) WHERE page >= 0"""
_OUTLINE = f"""tree AS (SELECT doc, {_TREE} FROM part, (VALUES (1), (2)) v(doc)), step AS (SELECT *, lpad(ord::VARCHAR, 10, '0') || '.' || lpad(node::VARCHAR, 19, '0') || '/' AS s FROM tree),
    t AS (SELECT doc, node, 1 AS level, s AS path FROM step WHERE parent IS NULL UNION ALL SELECT c.doc, c.node, level + 1, path || s FROM t JOIN step c ON c.doc = t.doc AND c.parent = t.node WHERE level < 6),
    o AS MATERIALIZED (SELECT * FROM (SELECT t.doc, row_number() OVER (PARTITION BY t.doc ORDER BY path) AS seq, level, node, title, page, top::DOUBLE AS top FROM t JOIN tree USING (doc, node) WHERE page >= 0) WHERE seq <= 5000)"""


def _tree(spark, sf):
    rows = table(spark, sf, "part").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("doc"), "p_partkey", "p_size")
    return rows.selectExpr("doc", *_spark(_TREE_ROWS)).withColumn("top", F.col("top").cast("double"))


def _outline(spark, sf):
    return outline.outline_rows(_tree(spark, sf))


@query(f"WITH RECURSIVE {_WHOLE}")
def s9_outline(spark, sf):
    return outline.whole_outline(_tree(spark, sf))


def _round(k: int) -> str:
    """One level of P8 in SQL: the entries of the least level in each group, and those under long ones as groups."""
    return f"""l{k} AS MATERIALIZED (SELECT *, last_value(CASE WHEN level = least THEN seq END IGNORE NULLS) OVER (PARTITION BY doc, g ORDER BY seq) AS owner FROM (SELECT *, min(level) OVER (PARTITION BY doc, g) AS least FROM g{k})),
    c{k} AS MATERIALIZED (SELECT *, coalesce(lead(page) OVER (PARTITION BY doc, g ORDER BY seq), past) AS upto FROM l{k} WHERE level = least),
    g{k + 1} AS MATERIALIZED (SELECT l.doc, l.seq, l.level, l.title, l.page, l.top, l.owner AS g, c.upto AS past FROM l{k} l JOIN c{k} c ON c.doc = l.doc AND c.seq = l.owner AND c.upto - c.page > 50 WHERE l.level > l.least)"""


_STARTS = f"""{_OUTLINE}, g0 AS MATERIALIZED (SELECT doc, seq, level, title, page, top, 0::BIGINT AS g, 381 AS past FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM o WHERE page <= 380 AND trim(title) <> '') WHERE n >= 2), {_round(0)}, {_round(1)}, {_round(2)},
    starts AS MATERIALIZED (SELECT doc, seq, title, page, top FROM c0 UNION ALL SELECT doc, seq, title, page, top FROM c1 UNION ALL SELECT doc, seq, title, page, top FROM c2)"""


def _starts(spark, sf):
    last = spark.range(1, 3).select(F.col("id").cast("int").alias("doc"), F.lit(380).alias("last_page"))
    return outline.chapter_starts(_outline(spark, sf), last)


@query(f"WITH RECURSIVE {_STARTS} SELECT * FROM starts")
def p8_chapter_starts(spark, sf):
    return _starts(spark, sf)


@query(f"""WITH RECURSIVE {_STARTS}, i AS (SELECT o_orderkey % 2 + 1 AS doc, o_orderkey AS n, o_custkey % 397 AS page, o_totalprice % 300 AS top FROM orders)
    SELECT i.doc, i.n, i.page, i.top, arg_max(seq, (starts.page, starts.top - 2, seq)) AS chapter FROM i LEFT JOIN starts ON starts.doc = i.doc AND (starts.page < i.page OR (starts.page = i.page AND starts.top - 2 <= i.top)) GROUP BY ALL""")
def p8_chapters_of_items(spark, sf):
    items = table(spark, sf, "orders").select((F.col("o_orderkey") % 2 + 1).cast("int").alias("doc"), F.col("o_orderkey").alias("n"), (F.col("o_custkey") % 397).alias("page"), (F.col("o_totalprice") % 300).alias("top"))
    return outline.chapters_of(items, _starts(spark, sf))


# Hosts of other scripts that take the place of some pages' hosts.
_HOSTS = ["автор.today", "bücher.example", "例え.テスト", "straße.de", "ПРИМЕР。рф"]


@query(f"""SELECT page_id, CASE page_id % 7 {" ".join(f"WHEN {k} THEN '{h.lower().encode('idna').decode()}'" for k, h in enumerate(_HOSTS))} WHEN 5 THEN replace(lower(split_part(split_part(url, '/', 3), ':', 1)), '.', '.a%') ELSE lower(split_part(split_part(url, '/', 3), ':', 1)) END AS host FROM pages""")
def r2_ascii_hosts(spark, sf):
    own = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    host = F.when(F.col("page_id") % 7 == 5, F.replace(own, F.lit("."), F.lit(".a%"))).when(F.col("page_id") % 7 == 6, F.upper(own))
    for k, h in enumerate(_HOSTS):
        host = host.when(F.col("page_id") % 7 == k, F.url_encode(F.lit(h)) if k == 1 else F.lit(h))
    return table(spark, sf, "pages").select("page_id", hosts.ascii_host(host).alias("host"))


_RUN_ROWS = [
    "l_orderkey % 7 AS doc", "l_orderkey // 40 AS page", "l_orderkey * 10 + l_linenumber AS run", "l_returnflag || l_linenumber AS text", "l_partkey % 120 * 4.0 + l_partkey % 7 AS left",
    "l_partkey % 120 * 4.0 + l_partkey % 7 + l_quantity / 4 AS right", "l_suppkey % 5 * 12 + l_linenumber % 3 * 0.5 AS baseline", "8.0 + l_linenumber % 4 AS size",
]
_QUOTED = ", ".join(_RUN_ROWS).replace("AS left", 'AS "left"').replace("AS right", 'AS "right"').replace(" 4.0", " 4.0::DOUBLE").replace("0.5 AS", "0.5::DOUBLE AS").replace("8.0 +", "8.0::DOUBLE +")


@query(f"""WITH r AS (SELECT DISTINCT {_QUOTED} FROM lineitem WHERE l_partkey % 120 NOT BETWEEN 50 AND 60), b AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY baseline, "left", run ROWS UNBOUNDED PRECEDING)::INT AS band FROM (SELECT *, CASE WHEN baseline - lag(baseline) OVER w > 0.25 * greatest(size, lag(size) OVER w) THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY doc, page ORDER BY baseline, "left", run))),
    s AS (SELECT *, "left" - reach AS gap FROM (SELECT *, max("right") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, greatest(size, lag(size) OVER w) AS em FROM b WINDOW w AS (PARTITION BY doc, page, band ORDER BY "left", "right", run))),
    c AS (SELECT doc, page, cell, count(DISTINCT band) AS crossed FROM (SELECT doc, page, band, unnest(generate_series(floor(f / 4)::BIGINT, floor(greatest(f, "right") / 4)::BIGINT)) AS cell FROM (SELECT *, CASE WHEN gap > 0 AND gap <= em THEN reach ELSE "left" END AS f FROM s)) GROUP BY ALL), n AS (SELECT doc, page, max(band) + 1 AS bands FROM s GROUP BY ALL),
    f AS (SELECT c.doc, c.page, cell FROM c JOIN n ON c.doc = n.doc AND c.page = n.page WHERE crossed > 0.05 * bands),
    e AS (SELECT s.*, coalesce(gap > em, false) AND (gap > 4 * em OR f.cell IS NULL) AS ends FROM s LEFT JOIN f ON f.doc = s.doc AND f.page = s.page AND f.cell = floor((reach + "left") / 2 / 4)),
    p AS (SELECT *, sum(ends::INT) OVER (PARTITION BY doc, page, band ORDER BY "left", "right", run ROWS UNBOUNDED PRECEDING)::INT AS part FROM e)
    SELECT doc, page, band, part, min("left") AS "left", max("right") AS "right", max(baseline) AS baseline, max(size) AS size, trim(string_agg(CASE WHEN NOT ends AND gap > 0.15 * em THEN ' ' || text ELSE text END, '' ORDER BY "left", "right", run)) AS text FROM p GROUP BY doc, page, band, part""")
def p1_page_lines(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_partkey % 120 not between 50 and 60").selectExpr(*_spark(_RUN_ROWS))
    for c in ("left", "right", "baseline", "size"):
        rows = rows.withColumn(c, F.col(c).cast("double"))
    return lines.built(rows.distinct())


_PAGED = {
    "page": "i // 20", "n": "i", "text": "text", "left": "i % 13 // 12 * 20 + 10.0", "right": "10.0 + least(length(text) * 5, 400)", "baseline": "i % 20 * 12.0 + CASE WHEN i % 17 = 0 THEN 6 ELSE 0 END", "size": "CASE WHEN i % 29 = 0 THEN 14.0 ELSE 10.0 END",
    "block": "i // 20 * 10 + i % 20 // 7", "block_left": "10.0", "block_right": "400.0", "column_right": "410.0", "heading": "i % 31 = 30",
}
_HYPHENED = "replace(replace(text, 'e ', 'e-' || chr(10)), ', ', chr(10))"
_ENDED = "[.!?:…][\"”»)’]*$"


@query(f"""WITH l AS (SELECT doc_id AS doc, {", ".join(f'({v}){"::DOUBLE" if k in ("left", "right", "baseline", "size", "block_left", "block_right", "column_right") else ""} AS "{k}"' for k, v in _PAGED.items())} FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS text FROM (SELECT doc_id, string_split({_HYPHENED}, chr(10)) AS l FROM documents)) WHERE text <> ''),
    w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zé]+')) AS word FROM benchmark), k AS (SELECT doc, page, block, quantile_disc(d, 0.5) AS step FROM (SELECT doc, page, block, baseline - lag(baseline) OVER (PARTITION BY doc, page, block ORDER BY n) AS d FROM l) WHERE d IS NOT NULL GROUP BY ALL),
    a AS (SELECT l.*, coalesce(step, 0) AS step, lag(l.text) OVER o AS lt, lag("right") OVER o AS lr, lag(baseline) OVER o AS lb, lag(size) OVER o AS ls, lag(l.block) OVER o AS lk, lag(heading) OVER o AS lh FROM l LEFT JOIN k ON k.doc = l.doc AND k.page = l.page AND k.block = l.block WINDOW o AS (PARTITION BY l.doc ORDER BY n)),
    b AS (SELECT *, greatest(size, ls) AS em, regexp_matches(text, '^[\\p{{Ll}},;)\\]»”]') AS low, regexp_matches(rtrim(lt), '{_ENDED.replace(chr(39), chr(39) * 2)}') AS ended, coalesce(block = lk, false) AS inside FROM a),
    c AS (SELECT *, lr < CASE WHEN inside THEN block_right ELSE greatest(block_right, column_right) END - em * 2.5 AS short FROM b),
    d AS (SELECT *, lt IS NOT NULL AND NOT (heading OR lh OR regexp_matches(text, '^(?:[■●•▪◆◼►▸❑□○◦‣⁃∙·]|[–—] )') OR abs(size - ls) > em * 0.2) AND CASE WHEN inside THEN NOT ("left" - block_left > em * 0.8 AND NOT low) AND NOT (baseline - lb > step * 1.3 AND step > 0 AND NOT low) AND NOT (short AND ended AND NOT low) AND NOT (lr < 10 + 390 * 0.5 AND NOT low AND NOT regexp_matches(lt, '(?:,|[-­‐])$'))
        WHEN low AND NOT (ended AND short) THEN true ELSE NOT ended AND NOT short END AS goes FROM c),
    e AS (SELECT *, CASE WHEN goes AND regexp_extract(lt, '(\\p{{L}}+)[-­‐]$', 1) <> '' AND regexp_matches(text, '^\\p{{Ll}}') THEN lower(regexp_extract(lt, '(\\p{{L}}+)[-­‐]$', 1)) END AS head, lower(regexp_extract(text, '^\\p{{L}}+')) AS tail FROM d),
    f AS (SELECT *, CASE WHEN head IS NULL THEN ' ' WHEN head || tail IN (FROM w) THEN '' WHEN length(head) >= 2 AND head IN (FROM w) AND tail IN (FROM w) THEN '-' ELSE '' END AS joint, head IS NOT NULL AS drops FROM e),
    g AS (SELECT *, CASE WHEN lead(drops) OVER (PARTITION BY doc ORDER BY n) THEN regexp_replace(text, '[-­‐]$', '') ELSE text END AS bare, last_value(CASE WHEN NOT goes THEN n END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n) AS first FROM f)
    SELECT doc, first AS n, min(page) AS page, bool_or(heading) AS heading, string_agg(CASE WHEN n = first THEN bare ELSE joint || bare END, '' ORDER BY n) AS text FROM g GROUP BY doc, first""")
def p7_paragraphs_across_pages(spark, sf):
    pages, per_page = 3, 20
    texts = F.split(F.expr(_HYPHENED.replace("chr(10)", "char(10)")), "\n", -1)
    # lines are dealt while they still are lists of a range's lines: much less is shuffled than line by line
    size = pages * per_page
    places = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int"))
    ranges = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), texts.alias("l")).where("l is not null")
    ranges = ranges.select("doc", F.posexplode(F.transform(places, lambda r: F.slice("l", r * size + 1, size))).alias("r", "l"))
    ranges = ranges.select("doc", "r", flow.shard(F.col("doc"), F.col("r") * pages, pages).alias("shard"), "l").repartition("shard")
    rows = ranges.select("doc", "shard", "r", F.posexplode("l").alias("k", "text")).withColumn("i", F.col("r") * size + F.col("k"))
    rows = rows.selectExpr("doc", "shard", *_spark([f"{v} AS `{k}`" for k, v in _PAGED.items()]))
    for c in ("left", "right", "baseline", "size", "block_left", "block_right", "column_right"):
        rows = rows.withColumn(c, F.col(c).cast("double"))
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zé]+)"), F.lit(1))).alias("word")).distinct()
    return flow.paragraphs(rows, words, pages)


def _variants(spark, sf):
    # a document's words once each, in its own row: nothing but one row a word and task is dealt
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-zé]+)"), F.lit(1)))
    words = table(spark, sf, "documents").select("doc_id", F.explode(own).alias("word"))
    return words.select("word", F.col("doc_id").alias("value"), (F.col("doc_id") % 13).alias("prob"), F.col("doc_id").alias("line"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zé]+')) AS word FROM documents) SELECT word, arg_max(doc_id, (doc_id % 13, -doc_id)) AS value FROM w WHERE word >= 'm' AND word < 'té' AND starts_with(word, 'n') = false GROUP BY 1""")
def w14_s21_word_list(spark, sf):
    from leafmill.checkpoints import shared_folder

    path = f"{shared_folder(spark)}/leafmill-lexicon-{uuid.uuid4().hex}"
    lexicons.written(lexicons.chosen(_variants(spark, sf)), path, 8)
    return lexicons.found(spark, path).where("word >= 'm' and word < 'té' and not startswith(word, 'n')")
