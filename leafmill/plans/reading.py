"""Queries of page geometry and of reading aloud."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import layout, reading, speech
from leafmill.plans.registry import query, table

_BOX = "struct(l_extendedprice % 500 as left, l_quantity * 10 as top, l_extendedprice % 500 + 40 as right, l_quantity * 10 + 12 as bottom)"


@query("""WITH l AS (SELECT l_orderkey AS page, l_linenumber AS line, l_extendedprice % 500 AS l, l_quantity * 10 AS t, l_extendedprice % 500 + 40 AS r, l_quantity * 10 + 12 AS b FROM lineitem),
    f AS (SELECT page, line AS figure, l - 100 AS l, t - 100 AS t, r + 100 AS r, b + 100 AS b FROM l WHERE line % 2 = 0)
    SELECT l.page, l.line, min(f.figure) AS figure FROM l JOIN f ON l.page = f.page WHERE least(l.r, f.r) > greatest(l.l, f.l) AND least(l.b, f.b) > greatest(l.t, f.t)
    AND (least(l.r, f.r) - greatest(l.l, f.l)) * (least(l.b, f.b) - greatest(l.t, f.t)) / greatest(0.01, (l.r - l.l) * (l.b - l.t)) >= 0.6 GROUP BY 1, 2""")
def j13_lines_in_figures(spark, sf):
    rows = table(spark, sf, "lineitem")
    lines = rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.expr(_BOX).alias("box"))
    grown = F.struct(*[(F.col(f"box.{k}") + (100 if k in ("right", "bottom") else -100)).alias(k) for k in ("left", "top", "right", "bottom")])
    figures = lines.where("line % 2 = 0").select("page", F.col("line").alias("figure"), grown.alias("box"))
    return layout.contained(lines, figures, 0.6)


@query("""WITH r AS (SELECT l_orderkey % 2 AS parity, l_quantity * 3 AS l, l_extendedprice % 400 + 100 AS r FROM lineitem), s AS (SELECT parity, floor(l / 2) AS step, count(*) AS n FROM r GROUP BY 1, 2),
    c AS (SELECT parity, arg_max(step * 2, (n, -step)) AS col FROM s GROUP BY 1), k AS (SELECT r.parity, col, r, row_number() OVER (PARTITION BY r.parity ORDER BY r) AS i, count(*) OVER (PARTITION BY r.parity) AS n FROM r JOIN c ON r.parity = c.parity WHERE abs(l - col) <= 4)
    SELECT parity, col::BIGINT AS "left", r AS "right" FROM k WHERE i = least(floor(n * 0.9) + 1, n)""")
def a9_text_columns(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") * 3).alias("left"), (F.col("l_extendedprice") % 400 + 100).alias("right"))
    return layout.columns(rows)


@query("""WITH l AS (SELECT string_split(unnest(string_split(text, chr(10))), ' ') AS w FROM documents), i AS (SELECT w, unnest(range(2, len(w))) AS i FROM l WHERE len(w) > 2),
    t AS (SELECT trim(w[i], ',.;:!?()"“”«»’' || chr(39)) AS word, rtrim(w[i - 1], '"”»)’') AS before FROM i), k AS (SELECT word FROM t WHERE length(word) >= 2 AND regexp_full_match(word, '\\p{L}+') AND NOT regexp_matches(before, '[.!?:]$')),
    f AS (SELECT lower(word) AS key, word, count(*) AS n FROM k GROUP BY 1, 2), g AS (SELECT key, sum(n) AS uses, max((n, word)) AS top FROM f GROUP BY key)
    SELECT key, top[2] AS form FROM g WHERE uses >= 3 AND top[1] >= 0.8 * uses AND top[2] <> key""")
def a11_spellings(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n", -1)).alias("text"))
    return layout.spellings(layout.inner_words(lines))


@query("""WITH m AS (SELECT user_id AS doc, event_type AS key, event_id AS "at", coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000) - event_id AS weight FROM events)
    SELECT doc, key, arg_max("at", (weight, -"at")) AS "at" FROM m GROUP BY 1, 2""")
def n9_heaviest_heading(spark, sf):
    marks = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("key"), F.col("event_id").alias("at"), F.lit(1_000_000).cast("long").alias("end"))
    return layout.contents_or_heading(marks)


_TONES = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in reading.TONES.items())


@query(f"""WITH t(tone, rate, pitch, db) AS (VALUES {_TONES}), l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ANGRY' WHEN event_id % 3 = 1 THEN 'WHISPER' ELSE 'none' END AS tone FROM events)
    SELECT event_id, l.tone, round(coalesce(1 + (rate - 1) * 0.5, 1), 6) AS rate, round(coalesce(1 + (pitch - 1) * 0.5, 1), 6) AS pitch, round(coalesce(pow(10, db * 0.5 / 20), 1), 6) AS gain FROM l LEFT JOIN t ON l.tone = t.tone""")
def v7_prosody(spark, sf):
    tone = F.when(F.col("event_id") % 3 == 0, "ANGRY").when(F.col("event_id") % 3 == 1, "WHISPER").otherwise("none")
    out = reading.prosody(table(spark, sf, "events").select("event_id", tone.alias("tone")), 0.5)
    return out.select("event_id", "tone", *[F.round(c, 6).alias(c) for c in ("rate", "pitch", "gain")])


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}]+')) AS word FROM benchmark), o AS (SELECT lower(word) AS key, 'own' AS s FROM w WHERE length(word) % 5 = 0 GROUP BY 1), g AS (SELECT lower(word) AS key, 'shared' AS s FROM w WHERE length(word) % 2 = 0 GROUP BY 1)
    SELECT word, coalesce(o.s, g.s) AS spoken FROM w LEFT JOIN o ON lower(word) = o.key LEFT JOIN g ON lower(word) = g.key""")
def j4_pronunciations(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([\\p{L}]+)"), F.lit(1))).alias("word")).distinct()
    own = words.where("length(word) % 5 = 0").withColumn("spoken", F.lit("own"))
    shared = words.where("length(word) % 2 = 0").withColumn("spoken", F.lit("shared"))
    return reading.pronounced(words, own, shared, own.where("false"))


@query("""SELECT min(o_orderkey) AS "index" FROM orders WHERE o_custkey > 7 OR (o_custkey = 7 AND (o_orderkey % 50 > 3 OR (o_orderkey % 50 = 3 AND o_orderkey % 100 > 40)))""")
def j11_segment_at(spark, sf):
    segments = table(spark, sf, "orders").select(F.col("o_custkey").alias("chapter"), (F.col("o_orderkey") % 50).alias("paragraph"), (F.col("o_orderkey") % 100).alias("end"), F.col("o_orderkey").alias("index"))
    return reading.segment_at(segments, 7, 3, 40)


@query("""WITH p AS (SELECT user_id AS book, arg_max(event_id % 9, (ts, event_id)) AS chapter, max(event_id) AS opened FROM events GROUP BY 1)
    SELECT c_custkey AS book, greatest(0, least(coalesce(p.chapter, 1), 4)) AS chapter, CASE WHEN p.book IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS progress, greatest(100, coalesce(p.opened, 0)) AS opened FROM customer LEFT JOIN p ON p.book = c_custkey""")
def j3_merged_positions(spark, sf):
    log = table(spark, sf, "events").groupBy(F.col("user_id").alias("book")).agg(F.max_by(F.col("event_id") % 9, F.struct("ts", "event_id")).alias("chapter"), F.max("event_id").alias("opened"))
    books = table(spark, sf, "customer").select(F.col("c_custkey").alias("book"), F.lit(1).cast("long").alias("current_chapter"), F.lit(5).alias("chapters"), F.lit(100).cast("long").alias("last_opened"))
    return reading.merged_positions(books, log.withColumn("progress", F.lit(0.5).cast("double")))


@query("""SELECT user_id, event_id, first_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM events""")
def z4_backward_fill(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("event_id")).alias("mark"))
    return reading.backward_fill(rows, "user_id", "event_id", "mark").select("user_id", "event_id", "ahead")


@query("""SELECT arg_max(v, [list_transform(string_split(v, '.'), lambda x: x::INT)]) AS newest FROM (SELECT (p_partkey % 3) || '.' || (p_partkey % 12) || '.' || (p_partkey % 7) AS v FROM part)""")
def l11_newest_version(spark, sf):
    version = F.concat_ws(".", F.col("p_partkey") % 3, F.col("p_partkey") % 12, F.col("p_partkey") % 7)
    return table(spark, sf, "part").select(version.alias("v")).agg(F.max_by("v", reading.version_key(F.col("v"))).alias("newest"))


@query()
def q1_dialogue_parts(spark, sf):
    quoted = F.concat(F.lit('He said: "'), "text", F.lit('!" and left.'))
    found = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(speech.dialogue(quoted, F.lit("en"))).alias("p"))
    return found.select("conv_id", "turn", "p.*")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), f AS (SELECT vec_id, list_transform(range(0, len(e), 8), lambda i: {'s': list_sum(list_transform(e[i + 1:least(i + 8, len(e))], lambda x: x * x)), 'n': least(8, len(e) - i)}) AS f FROM e),
    v AS (SELECT vec_id, list_filter(f, lambda x: sqrt(x.s / x.n) > 0.01) AS v FROM f) SELECT vec_id, CASE WHEN len(v) > 0 THEN sqrt(list_sum(list_transform(v, lambda x: x.s)) / list_sum(list_transform(v, lambda x: x.n))) ELSE 0 END AS level FROM v""")
def a17_speech_level(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", reading.speech_level("embedding", F.lit(400)).alias("level"))
