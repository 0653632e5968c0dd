"""Queries of pages of type, sounds and phonemes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import phonemes, sound
from leafmill.operators import typeset
from leafmill.plans.registry import query, table


def _boxes(spark, sf):
    left, top = (F.floor(x).cast("double") for x in (F.col("l_extendedprice") % 500, F.col("l_quantity") * 12))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 10**11 + F.round(F.col("l_extendedprice") * 100)).cast("long").alias("block"), left.alias("left"), top.alias("top"), (left + 60).alias("right"), (top + 14).alias("bottom"))


_SHAPES = "SELECT l_orderkey AS page, (l_linenumber * 100000000000 + round(l_extendedprice * 100))::BIGINT AS i, floor(l_extendedprice % 500) AS l, floor(l_quantity * 12) AS t FROM lineitem"


@query(f"""WITH RECURSIVE s AS ({_SHAPES}), e AS (SELECT a.page, a.i, b.i AS j FROM s a JOIN s b ON a.page = b.page AND a.l - 6 < b.l + 60 AND b.l < a.l + 66 AND a.t - 6 < b.t + 14 AND b.t < a.t + 20),
    r AS (SELECT page, i, i AS j FROM s UNION SELECT r.page, r.i, e.j FROM r JOIN e ON e.page = r.page AND e.i = r.j), c AS (SELECT page, i, min(j) AS root FROM r GROUP BY 1, 2)
    SELECT c.page, count(*) AS n, min(l) AS "left", min(t) AS top, max(l) + 60 AS "right", max(t) + 14 AS bottom FROM c JOIN s ON c.page = s.page AND c.i = s.i GROUP BY c.page, root""")
def j12_shape_clusters(spark, sf):
    found = typeset.shape_clusters(_boxes(spark, sf).withColumn("kind", F.lit("PATH")))
    return found.select("page", F.col("count").cast("long").alias("n"), "left", "top", "right", "bottom")


@query(f"""WITH s AS ({_SHAPES}), f AS (SELECT page, min(i) AS i FROM s GROUP BY page), p AS (SELECT f.page, f.i AS figure, c.i AS caption, CASE WHEN least(a.t, c.t) + 14 > greatest(a.t, c.t) THEN 0 ELSE greatest(0, c.l - a.l - 60, a.l - c.l - 60, c.t - a.t - 14, a.t - c.t - 14) END + abs(a.t - c.t) * 0.05 AS cost,
    greatest(0, c.l - a.l - 60, a.l - c.l - 60, c.t - a.t - 14, a.t - c.t - 14) AS gap, least(a.t, c.t) + 14 > greatest(a.t, c.t) AS beside FROM f JOIN s a ON a.page = f.page AND a.i = f.i JOIN s c ON c.page = f.page AND c.i > f.i),
    b AS (SELECT page, figure, arg_min({{'c': caption, 'g': gap, 'b': beside}}, (cost, caption)) AS x FROM p GROUP BY 1, 2) SELECT page, figure::BIGINT AS figure, x.c::BIGINT AS caption FROM b WHERE x.g <= 40 OR x.b""")
def j14_captions(spark, sf):
    boxes = _boxes(spark, sf)
    first = boxes.groupBy("page").agg(F.min("block").alias("first"))
    rows = boxes.join(first, "page")
    figures = rows.where("block = first").withColumnRenamed("block", "figure")
    captions = rows.where("block > first").withColumnRenamed("block", "caption").withColumn("labelled", F.lit(True))
    return typeset.paired_captions(figures, captions)


@query()
def l7_reading_order(spark, sf):
    return typeset.reading_order(_boxes(spark, sf).withColumn("size", F.lit(10.0)))


@query("""WITH l AS (SELECT lang || '-Bold' AS font, unnest(string_split(CASE WHEN lang = 'fr' THEN lower(text) ELSE text END, chr(10))) AS text FROM documents),
    c AS (SELECT font, sum(len(list_filter(regexp_extract_all(text, '\\p{Ll}{3}[.!?]\\s(\\p{L})', 1), lambda x: NOT regexp_matches(x, '\\p{Lu}')))) AS small, sum(len(list_filter(regexp_extract_all(text, '\\p{Ll}{3}[.!?]\\s(\\p{L})', 1), lambda x: regexp_matches(x, '\\p{Lu}')))) AS capital,
    sum(len(list_filter(list_transform(string_split(text, ' '), lambda w: regexp_replace(w, '[^\\p{L}]', '', 'g')), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\\p{Ll}*|\\p{Lu}*|\\p{Lu}\\p{Ll}*|\\p{Lu}?\\p{Ll}+(\\p{Lu}\\p{Ll}+)+|\\p{Lu}+s')))) AS odd,
    sum(len(list_filter(list_transform(string_split(text, ' '), lambda w: regexp_replace(w, '[^\\p{L}]', '', 'g')), lambda w: length(w) >= 2))) AS words FROM l GROUP BY font)
    SELECT font FROM c WHERE (small >= 3 AND small >= (small + capital) * 0.2) OR (odd >= 5 AND odd >= words * 0.01)""")
def a13_broken_fonts(spark, sf):
    text = F.when(F.col("lang") == "fr", F.lower("text")).otherwise(F.col("text"))
    lines = table(spark, sf, "documents").select(F.concat("lang", F.lit("-Bold")).alias("font"), F.explode(F.split(text, "\n", -1)).alias("text"))
    return typeset.broken_fonts(lines)


@query("""WITH i AS (SELECT l_orderkey AS chapter, l_linenumber AS ord, l_returnflag AS text FROM lineitem), m AS (SELECT *, contains('an', lower(text)) AS r, row_number() OVER w AS n FROM i WINDOW w AS (PARTITION BY chapter ORDER BY ord)),
    l AS (SELECT *, bool_and(r) OVER (PARTITION BY chapter ORDER BY ord) AS lead FROM m) SELECT chapter, ord FROM l WHERE NOT (lead AND n <= 4)""")
def n6_repeated_titles(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.lit("A n").alias("title"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("text"), F.lit("TEXT").alias("kind"))
    return typeset.without_repeated_title(items).select("chapter", "ord")


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '[«»„“”]', '"', 'g'), '…', '...'), '[–—‒]', '-', 'g'), '[’`]', chr(39), 'g'), '[^А-Яа-яЁёA-Za-zÄÖäö''+ ,.?!;:"()\\-]', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents""")
def z1_sanitized(spark, sf):
    return table(spark, sf, "documents").select("doc_id", phonemes.sanitize(F.col("text")).alias("text"))


@query("""WITH w AS (SELECT p_partkey, ['ба', 'ту', 'ки', 'ро'][(p_partkey % 4)::INT + 1] AS a, ['м+а', 'д+я', 'н+ё', 'ш+и'][(p_partkey // 4 % 4)::INT + 1] AS b FROM part)
    SELECT p_partkey, ['b a0', 't u0', 'kj i0', 'r o0'][(p_partkey % 4)::INT + 1] || ' ' || ['m a1', 'dj a1', 'nj o1', 'sh i1'][(p_partkey // 4 % 4)::INT + 1] AS sounds FROM w""")
def z3_phonemes(spark, sf):
    pick = lambda names, k: F.array(*map(F.lit, names))[k.cast("int")]
    key = F.col("p_partkey")
    word = F.concat(pick(["ба", "ту", "ки", "ро"], key % 4), pick(["м+а", "д+я", "н+ё", "ш+и"], F.floor(key / 4) % 4))
    return table(spark, sf, "part").select("p_partkey", phonemes.phonemes_of(word).alias("sounds"))


@query()
def v9_v10_sounds(spark, sf):
    made = sound.prepared("embedding", F.lit(400), F.lit(300))
    return table(spark, sf, "embeddings").select("vec_id", F.size(made).alias("n"))


@query()
def a20_pitch(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", sound.median_pitch("embedding", F.lit(800)).alias("hz"))


@query("""WITH l AS (SELECT doc_id AS page, i // 3 AS block, i, p[i + 1] AS text, 9 + doc_id % 4 * 2 + i % 2 AS size, doc_id % 5 = 0 AS bold, lang AS font FROM (SELECT doc_id, lang, p, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, lang, string_split(CASE WHEN doc_id % 7 = 0 THEN 'Fig. 3 ' || text ELSE text END, chr(10)) AS p FROM documents))),
    b AS (SELECT page, block, array_to_string(list(text ORDER BY i), ' ') AS text, count(*) AS n, list_sort(list(size))[(count(*) // 2)::INT + 1] AS size, min(size) AS least, bool_and(bold) AS bold, bool_or(font = 'en' AND NOT bold) AS plain FROM l GROUP BY 1, 2)
    SELECT page, block::BIGINT AS block, CASE WHEN regexp_matches(text, '^(?i:figure|fig\\.|table)\\s*[\\dA-ZА-Я]+') THEN 'CAPTION' WHEN n <= 4 AND length(text) <= 200 AND least >= 11.5 THEN CASE WHEN size >= 15 THEN 'HEADING' ELSE 'SUBHEADING' END
    WHEN n <= 2 AND length(text) <= 80 AND bold AND size >= 9.5 AND NOT regexp_matches(text, '[.,;]$') AND NOT plain THEN 'SUBHEADING' END AS kind FROM b""")
def p9_block_kinds(spark, sf):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Fig. 3 "), "text")).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.col("lang").alias("font"), F.posexplode(F.split(text, "\n", -1)).alias("i", "text"))
    lines = rows.select("page", F.floor(F.col("i") / 3).alias("block"), F.col("i").alias("ord"), "text", (9 + F.col("page") % 4 * 2 + F.col("i") % 2).alias("size"), (F.col("page") % 5 == 0).alias("bold"), "font")
    return typeset.block_kinds(lines, 10.0, "en").select("page", "block", "kind")


@query("""WITH g AS (SELECT item_id AS page, i // 40 AS line, i, substr(text, i + 1, 1) AS c, CASE WHEN i % 40 < 20 THEN 'Sans' ELSE 'Serif' END AS font, 8 + i % 3 AS size FROM (SELECT item_id, text, unnest(range(0, length(text))) AS i FROM benchmark)),
    l AS (SELECT page, line, array_to_string(list(CASE WHEN c IN (' ', chr(10)) THEN ' ' WHEN i % 40 = 13 AND lead_ink THEN ' ' || c ELSE c END ORDER BY i), '') AS t, list_sort(list(size) FILTER (c NOT IN (' ', chr(10)))) AS s, max((CASE WHEN font = 'Sans' THEN a ELSE z END, font)) AS f
      FROM (SELECT *, coalesce(lag(c) OVER (PARTITION BY page, line ORDER BY i) NOT IN (' ', chr(10)), false) AS lead_ink, count(*) FILTER (font = 'Sans' AND c NOT IN (' ', chr(10))) OVER (PARTITION BY page, line) AS a, count(*) FILTER (font = 'Serif' AND c NOT IN (' ', chr(10))) OVER (PARTITION BY page, line) AS z FROM g) GROUP BY page, line)
    SELECT page, line::BIGINT AS line, trim(regexp_replace(t, ' +', ' ', 'g')) AS text, f[2] AS font, s[len(s) // 2 + 1] AS size FROM l WHERE trim(t) <> ''""")
def p2_finished_lines(spark, sf):
    letters = table(spark, sf, "benchmark").select(F.col("item_id").alias("page"), F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("i", "text"))
    place = F.col("i") % 40
    x = F.col("i") * 10 + F.when(place >= 13, 5).otherwise(0)  # a gap before the fourteenth
    glyphs = letters.select("page", F.floor(F.col("i") / 40).alias("line"), x.alias("x"), F.lit(10).alias("width"), "text", F.when(place < 20, "Sans").otherwise("Serif").alias("font"), (8 + F.col("i") % 3).alias("size"))
    return typeset.finished_lines(glyphs).select("page", "line", "text", "font", "size")
