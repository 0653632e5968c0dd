"""Queries of joins, aggregations and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import corpus, library
from leafmill.plans.registry import query, table


def _lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))


_WORDS = """WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(^|[.!?…]\\s+|\\n)?([\\p{L}]+(?:[-''’][\\p{L}]+)*)')) AS raw FROM documents),
    w AS (SELECT doc_id, regexp_extract(raw, '[\\p{L}]+(?:[-''’][\\p{L}]+)*$') AS word, regexp_matches(raw, '^([.!?…]|\\n)') AS opens FROM r),
    h AS (SELECT translate(lower(word), 'ё', 'е') AS key, count(*) FILTER (NOT regexp_matches(word, '^\\p{Lu}')) AS lower, count(*) FILTER (regexp_matches(word, '^\\p{Lu}') AND NOT opens) AS capital, count(*) FILTER (opens) AS opening FROM w GROUP BY 1) """


def _histogram(spark, sf):
    return corpus.case_histogram(corpus.tokens(table(spark, sf, "documents")))


@query(_WORDS + "SELECT key, lower, capital, opening FROM h")
def a1_word_case_hist(spark, sf):
    return _histogram(spark, sf)


@query(_WORDS + "SELECT key, lower, capital, opening FROM h WHERE capital > 0 AND lower * 2 <= capital")
def a2_name_words(spark, sf):
    return corpus.name_words(_histogram(spark, sf))


@query(_WORDS + "SELECT key, lower, capital, opening FROM h WHERE opening > 0 AND lower > 0 AND lower >= capital AND NOT (capital > 0 AND lower * 2 <= capital)")
def a3_common_words(spark, sf):
    return corpus.common_words(_histogram(spark, sf))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), x AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM l),
    f AS (SELECT doc_id, p[i] AS t, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) AS before FROM x),
    s AS (SELECT doc_id, sum(length(regexp_replace(t, '[^A-Za-z]', '', 'g'))) AS l, sum(length(regexp_replace(t, '[^\\x{0400}-\\x{04FF}]', '', 'g'))) AS c FROM f WHERE before <= 6000 GROUP BY doc_id)
    SELECT doc_id, CASE WHEN c = 0 AND l = 0 THEN 'ru' WHEN c >= l THEN 'ru' ELSE 'en' END AS language FROM s""")
def a7_dominant_language(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    return corpus.dominant_language(lines, "doc_id", "ord")


_PLACED = """SELECT doc_id AS page, i AS ord, p[i] AS text, (i - 1) * 20 AS top, (i - 1) * 20 + 12 AS bottom, len(p) * 20 AS height, (i - 1) * 20 + 10 AS baseline, lang AS font, 9 + length(p[i]) % 9 AS size
    FROM (SELECT doc_id, lang, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents))"""


@query(f"""WITH l AS ({_PLACED}), b AS (SELECT *, CASE WHEN bottom <= height * 0.1 THEN 'top' WHEN top >= height * 0.9 THEN 'bottom' END AS band FROM l),
    k AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '[0-9]|(^|[^\\p{{L}}\\p{{N}}_])[ivxlcdm]{{1,7}}([^\\p{{L}}\\p{{N}}_]|$)')), ' ') AS key,
      (page % 2) || '|' || floor(baseline / 3) || '|' || font || '|' || floor(size * 2) AS slot, size <= 10 * 1.6 AS small FROM b WHERE band IS NOT NULL),
    r AS (SELECT k.*, k.key <> '' AND n >= 3 AS repeated FROM k JOIN (SELECT band, key, count(DISTINCT page) AS n FROM k GROUP BY 1, 2) c ON k.band = c.band AND k.key = c.key),
    h AS (SELECT *, (repeated AND small) OR regexp_full_match(key, '[#\\s\\-–—.|/]*') OR key IN ('page', 'p.', 'стр.', 'стр', 'страница', 'с.') AS head FROM r),
    s AS (SELECT slot FROM h WHERE head AND repeated GROUP BY slot HAVING count(*) >= 5)
    SELECT page, ord FROM h WHERE head OR (small AND slot IN (SELECT slot FROM s))""")
def a10_running_heads(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.split("text", "\n", -1).alias("p"))
    rows = docs.select(F.col("doc_id").alias("page"), F.col("lang").alias("font"), F.size("p").alias("n"), F.posexplode("p").alias("i", "text"))
    at = F.col("i") * 20
    rows = rows.select("page", (F.col("i") + 1).cast("long").alias("ord"), "text", at.alias("top"), (at + 12).alias("bottom"), (F.col("n") * 20).alias("height"), (at + 10).alias("baseline"), "font", (9 + F.length("text") % 9).alias("size"))
    return corpus.running_heads(rows, 10)


@query("""WITH t AS (SELECT 'mode ' || l_returnflag AS text FROM lineitem) SELECT text, count(*) AS n FROM t WHERE length(text) >= 4 GROUP BY text HAVING count(*) >= 3 AND count(*) >= (SELECT count(*) FROM orders) * 0.3""")
def a10_watermarks(spark, sf):
    hidden = table(spark, sf, "lineitem").select(F.concat(F.lit("mode "), "l_returnflag").alias("text"))
    return corpus.watermarks(hidden, table(spark, sf, "orders").count())


@query("""SELECT l_partkey, arg_max(l_suppkey, (l_quantity, -l_orderkey * 10 - l_linenumber)) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_quantity > 0 GROUP BY l_partkey""")
def a12_best_variant(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return corpus.best(rows, "l_partkey", "l_suppkey", "l_quantity", "line")


@query("""WITH q AS (SELECT l_suppkey, floor(l_extendedprice / 1000 * 4) / 4 AS q, l_quantity FROM lineitem), s AS (SELECT l_suppkey, q, sum(l_quantity) AS w FROM q GROUP BY 1, 2)
    SELECT l_suppkey, arg_max(q, (w, -q)) AS mode, max(w) AS w FROM s GROUP BY 1""")
def a8_body_size(spark, sf):
    return corpus.weighted_mode(table(spark, sf, "lineitem").withColumn("size", F.col("l_extendedprice") / 1000), "l_suppkey", "size", "l_quantity")


@query("""SELECT user_id, list_sort(list(value))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def a16_upper_median(spark, sf):
    return corpus.upper_median(table(spark, sf, "events").where("value is not null"), "user_id", "value")


@query("""SELECT count(*) FILTER (quality = toxic) AS n_right, count(*) FILTER (toxic IS NULL) AS n_unknown, count(*) FILTER (quality <> toxic) AS n_wrong, count(*) AS n_rows FROM labels""")
def a21_confusion(spark, sf):
    return corpus.confusion(table(spark, sf, "labels"), "quality", "toxic")


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def a22_role_counts(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS chars_left FROM conversations""")
def a23_left_to_read(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.length("text").cast("long")).over(w).alias("chars_left"))


@query("""WITH b AS (SELECT conv_id, turn, role FROM conversations), a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'narrator' ELSE role END AS role FROM conversations WHERE turn < 5)
    SELECT coalesce(b.role, '-') AS from_role, coalesce(a.role, '') AS to_role, count(*) AS n FROM b LEFT JOIN a USING (conv_id, turn) WHERE coalesce(b.role, '-') <> coalesce(a.role, '') GROUP BY 1, 2""")
def j5_roles_diff(spark, sf):
    before = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    after = before.where("turn < 5").withColumn("role", F.when(F.col("turn") % 3 == 0, "narrator").otherwise(F.col("role")))
    return corpus.roles_diff(before, after, ["conv_id", "turn"])


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}]+')) AS word FROM documents), k AS (SELECT lower(word) AS key, word FROM w)
    SELECT key, word FROM k WHERE key NOT IN (SELECT key FROM k GROUP BY key HAVING count(DISTINCT word) > 1)""")
def j6_anti_ambiguous(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([\\p{L}]+)"), F.lit(1))).alias("word")).distinct()
    keyed = words.select(F.lower("word").alias("key"), "word")
    ambiguous = keyed.groupBy("key").agg(F.countDistinct("word").alias("n")).where("n > 1")
    return keyed.join(ambiguous, "key", "left_anti")


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_orderkey % 2 = 0), a AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2)
    SELECT a.o_custkey, a.o_orderpriority, a.o_orderkey FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = a.o_custkey AND o.o_orderpriority = a.o_orderpriority)""")
def j8_dedupe_append(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return library.new_chapters(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("""SELECT e.user_id, epoch_us(e.ts) AS "at", e.event_id AS item, s.value AS value FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY 1, 2) s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def j15_asof_chapter(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    starts = events.where("event_type = 'purchase' and value is not null").groupBy("user_id", "at").agg(F.max("value").alias("value"))
    return corpus.as_of(events.where("event_type != 'purchase'").withColumnRenamed("event_id", "item"), starts, "user_id", "at", "value")


@query("""WITH RECURSIVE l AS (SELECT 'p' || c_custkey AS url, CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 10 = 7 THEN 'p' || (c_custkey - 2) ELSE 'p' || (c_custkey + 1) END AS next_url FROM customer),
    c AS (SELECT url AS start, 0 AS hop, url, [url] AS seen FROM l UNION ALL SELECT c.start, c.hop + 1, l.next_url, list_append(c.seen, l.next_url) FROM c JOIN l ON c.url = l.url WHERE c.hop < 3 AND l.next_url IS NOT NULL AND NOT list_contains(c.seen, l.next_url))
    SELECT start, hop, url FROM c""")
def j21_next_chain(spark, sf):
    k = F.col("c_custkey")
    links = table(spark, sf, "customer").select(
        F.concat(F.lit("p"), k).alias("url"),
        F.when(k % 10 == 9, None).when(k % 10 == 7, F.concat(F.lit("p"), k - 2)).otherwise(F.concat(F.lit("p"), k + 1)).alias("next_url"),
    )
    return corpus.next_chain(links)


@query("""WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m) SELECT user_id, island::BIGINT AS island, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM n GROUP BY 1, 2, 3""")
def n5_islands(spark, sf):
    return corpus.islands(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("""WITH t AS (SELECT conv_id, turn, sum(length(text) / 14.0 + 0.32) OVER (PARTITION BY conv_id ORDER BY turn) AS "at" FROM conversations) SELECT conv_id, min(turn) AS turn FROM t WHERE "at" >= 30 GROUP BY conv_id""")
def n8_seek(spark, sf):
    segments = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("length"), F.lit(320).alias("pause_ms"))
    return library.seek(segments, "conv_id", "turn", 30.0)


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def t6_latest_position(spark, sf):
    return library.latest(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("""SELECT user_id, max(epoch_us(ts)) AS "at" FROM events WHERE value > 0 GROUP BY user_id ORDER BY "at" DESC, user_id LIMIT 1""")
def l2_continue_latest(spark, sf):
    at = F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at")
    return table(spark, sf, "events").where("value > 0").groupBy("user_id").agg(at).orderBy(F.desc("at"), "user_id").limit(1)


@query("""WITH l AS (SELECT doc_id AS book, text AS t, string_split(translate(lower(text), 'ё', 'е'), 'the') AS p FROM documents WHERE contains(translate(lower(text), 'ё', 'е'), 'the')),
    k AS (SELECT book, p, unnest(range(1, len(p))) AS i FROM l), s AS (SELECT book, i, list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * 3 AS start FROM k)
    SELECT book, 0 AS paragraph, start::INT AS start, (start + 3)::INT AS "end" FROM s ORDER BY book, start LIMIT 300""")
def l5_search_topk(spark, sf):
    return library.search(table(spark, sf, "documents").select(F.col("doc_id").alias("book"), F.lit(0).alias("paragraph"), "text"), " The ")


@query("""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}]+')) AS w FROM benchmark),
    p AS (SELECT t.item_id, t.w AS a, CASE WHEN t.item_id % 2 = 0 THEN list_filter(t.w, lambda x: length(x) > 4) ELSE coalesce(n.w, []) END AS b FROM t LEFT JOIN t n ON n.item_id = t.item_id + 1)
    SELECT item_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS same FROM p""")
def u3_same_words(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}]+)"), F.lit(1)).alias("a"))
    after = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("next"))
    b = F.when(F.col("item_id") % 2 == 0, F.filter("a", lambda x: F.length(x) > 4)).otherwise(F.coalesce("next", F.array().cast("array<string>")))
    return rows.join(after, "item_id", "left").select("item_id", corpus.same_words("a", b).alias("same"))


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS recent,
    coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS before FROM events""")
def n3_recent_turns(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.count("*").over(w.rowsBetween(-6, -1)).alias("recent"), F.coalesce(F.lag("event_type").over(w), F.lit("")).alias("before"))


@query("""SELECT event_id, user_id FROM events e WHERE ts >= (SELECT max(ts) FROM events m WHERE m.user_id = e.user_id AND m.event_type = 'click')""")
def t7_live_session(spark, sf):
    events = table(spark, sf, "events")
    newest = events.where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("since"))
    return events.join(newest, "user_id").where("ts >= since").select("event_id", "user_id")


@query("""WITH v AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS f, count(*) FILTER (event_type = 'purchase') AS m FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN f > 0 AND f >= 3 * m THEN 'F' WHEN m > 0 AND m >= 3 * f THEN 'M' END AS gender FROM v""")
def a5_votes(spark, sf):
    votes = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("f"), F.count_if(F.col("event_type") == "purchase").alias("m"))
    return votes.select("user_id", corpus.vote(F.col("f"), F.col("m")).alias("gender"))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey * 10 AS start, o_orderkey * 10 + 4 AS "end" FROM orders WHERE o_orderkey % 3 = 0), i AS (SELECT o_custkey AS k, o_orderkey * 10 + o_orderkey % 9 AS "at", o_orderkey AS item FROM orders),
    c AS (SELECT i.k, i.item, s.start, CASE WHEN i."at" >= s.start AND i."at" < s."end" THEN -1 ELSE abs(i."at" - s.start) END AS d FROM i LEFT JOIN s ON i.k = s.k)
    SELECT k, item, arg_min(start, (d, start)) AS span FROM c GROUP BY 1, 2""")
def j10_span_at(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item"))
    spans = orders.where("item % 3 = 0").select("k", (F.col("item") * 10).alias("start"), (F.col("item") * 10 + 4).alias("end"))
    items = orders.select("k", "item", (F.col("item") * 10 + F.col("item") % 9).alias("at"))
    return corpus.containing(items, spans, "k")


@query("""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages), r(name, rule, ord) AS (VALUES ('example.com', 'div.text', 1), ('m.example.com', 'div.mobile', 0), ('example.org', 'article', 2))
    SELECT h.host, (SELECT arg_min(rule, ord) FROM r WHERE h.host = r.name OR ends_with(h.host, '.' || r.name)) AS rule FROM h""")
def j20_site_rules(spark, sf):
    from leafmill.functions import web

    hosts = table(spark, sf, "pages").select(web.host_of(F.col("url")).alias("host")).distinct()
    rules = spark.createDataFrame([("example.com", "div.text", 1), ("m.example.com", "div.mobile", 0), ("example.org", "article", 2)], "name string, rule string, ord int")
    return corpus.by_rule(hosts, rules)
