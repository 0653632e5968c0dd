"""Queries of words, labels, shelves, casts and voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import words as wd
from leafmill.operators import corpus, library, shelf, voices
from leafmill.plans.registry import query, table


@query("""SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}]', ' ', 'g'), '[\\x{FFFD}\\x{0000}-\\x{001F}\\x{E000}-\\x{F8FF}]', '', 'g') AS text
    FROM (SELECT doc_id, replace(replace(text, 'f', 'ﬁ'), 'h', chr(160) || 'ﬂ') AS text FROM documents)""")
def c3_clean_glyphs(spark, sf):
    odd = F.replace(F.replace("text", F.lit("f"), F.lit("ﬁ")), F.lit("h"), F.lit(" ﬂ"))
    return table(spark, sf, "documents").select("doc_id", wd.clean_glyphs(odd).alias("text"))


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(CASE doc_id % 3 WHEN 0 THEN '▪  ' || text WHEN 1 THEN replace(text, ', ', ' ..... ') ELSE text || ' . . . . 7' END, '\\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '^[■●•▪◆◼►▸❑□○◦‣⁃∙·]\\s*', '• '), '(\\s*\\.){4,}\\s*|\\s*…{2,}\\s*|(\\s*·){4,}\\s*', ' … ', 'g'), '\\s+', ' ', 'g')) AS text FROM d""")
def c2_tidy(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("▪  "), "text")).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit(", "), F.lit(" ..... "))).otherwise(F.concat("text", F.lit(" . . . . 7")))
    return table(spark, sf, "documents").select("doc_id", wd.tidy(text).alias("text"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM (SELECT replace(text, 'ß', 's') AS text FROM benchmark)), m AS (SELECT w AS word FROM w UNION SELECT substr(w, 1, 2) || upper(substr(w, 3)) FROM w UNION SELECT upper(w) || 's' FROM w)
    SELECT word, length(word) >= 3 AND NOT regexp_full_match(word, '\\p{Ll}*|\\p{Lu}*|\\p{Lu}\\p{Ll}*|\\p{Lu}?\\p{Ll}+(\\p{Lu}\\p{Ll}+)+|\\p{Lu}+s') AS odd FROM m""")
def c5_odd_case(spark, sf):
    w = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.replace("text", F.lit("ß"), F.lit("s")), F.lit("(\\p{L}+)"), F.lit(1))).alias("w")).distinct()
    forms = w.select(F.explode(F.array(F.col("w"), F.concat(F.substring("w", 1, 2), F.upper(F.expr("substr(w, 3)"))), F.concat(F.upper("w"), F.lit("s")))).alias("word")).distinct()
    return forms.select("word", wd.is_odd_case(F.col("word")).alias("odd"))


@query("""WITH f AS (SELECT p_partkey, ['InfoDisp', 'Helvetica', 'Times', 'Bold'][(p_partkey % 4)::INT + 1] || ['Bold-Roman', 'Light,Oblique', 'BoldItalicMT', ''][(p_partkey // 4 % 4)::INT + 1] AS font FROM part)
    SELECT p_partkey, coalesce(nullif(regexp_replace(string_split(string_split(font, '-')[1], ',')[1], '(?i)(regular|roman|bold|semibold|demibold|demi|medium|light|black|heavy|book|italic|oblique|condensed|narrow|mt|ps)+$', ''), ''), font) AS family FROM f""")
def c5_font_family(spark, sf):
    pick = lambda names, k: F.array(*map(F.lit, names))[k.cast("int")]
    key = F.col("p_partkey")
    font = F.concat(pick(["InfoDisp", "Helvetica", "Times", "Bold"], key % 4), pick(["Bold-Roman", "Light,Oblique", "BoldItalicMT", ""], F.floor(key / 4) % 4))
    return table(spark, sf, "part").select("p_partkey", wd.font_family(font).alias("family"))


@query("""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([.!?…])(\\s)', '\\1' || chr(1) || '\\2', 'g'), '[^\\x01]+')) AS s FROM documents), t AS (SELECT doc_id, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM s)
    SELECT doc_id, count(*) FILTER (regexp_matches(s, '\\p{L}')) AS n, md5(string_agg(s, '|' ORDER BY s) FILTER (regexp_matches(s, '\\p{L}'))) AS digest FROM t GROUP BY doc_id""")
def c14_sentences(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", wd.sentences(F.replace("text", F.lit("\x01"), F.lit(""))).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.when(F.size("s") > 0, F.md5(F.array_join(F.sort_array("s"), "|"))).alias("digest"))


@query("""SELECT conv_id, turn, regexp_replace('«' || text || '» "' || role || '" end', '«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|"[^"]*"', ' ', 'g') AS text FROM conversations""")
def c18_without_quotes(spark, sf):
    text = F.concat(F.lit("«"), "text", F.lit('» "'), "role", F.lit('" end'))
    return table(spark, sf, "conversations").select("conv_id", "turn", wd.without_quotes(text).alias("text"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) SELECT w AS word, list_filter(range(0, length(w)), lambda i: contains('aeiouy', w[i + 1])) AS vowels,
    regexp_replace(replace(w, 'e', '+e'), '\\+([aeiouy])', '\\1́', 'g') AS acute, replace(replace(w, 'e', '+e'), '+', '') AS bare, substr(w, 1, 1) || '+' || substr(w, 2) AS second FROM w""")
def c9_stress(spark, sf):
    w = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    marked = F.replace("word", F.lit("e"), F.lit("+e"))
    return w.select("word", F.transform(wd.vowel_places(F.col("word")), lambda i: i.cast("long")).alias("vowels"), wd.styled(marked, "acute").alias("acute"), wd.styled(marked, "none").alias("bare"), wd.stressed(F.col("word"), F.lit(1)).alias("second"))


@query("""WITH h AS (SELECT doc_id, text, instr(lower(text), 'on') - 1 AS s, length(text) AS n FROM documents WHERE contains(lower(text), 'on')), l AS (SELECT *, greatest(s - 48, 0) AS low, least(s + 2 + 64, n) AS high FROM h),
    c AS (SELECT *, instr(substr(text, low + 1, s - low), ' ') AS sp, substr(text, s + 3, high - s - 2 + CASE WHEN high < n THEN 1 ELSE 0 END) AS tail FROM l),
    e AS (SELECT *, CASE WHEN low > 0 AND sp > 0 THEN low + sp ELSE low END AS a, length(tail) - length(string_split(tail, ' ')[-1]) - 1 AS ls FROM c), f AS (SELECT *, CASE WHEN high < n AND ls > 0 THEN s + 2 + ls ELSE high END AS b FROM e)
    SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, b - a) || CASE WHEN b < n THEN '…' ELSE '' END AS snippet, (CASE WHEN a > 0 THEN 1 ELSE 0 END + s - a)::INT AS "from" FROM f""")
def c20_snippets(spark, sf):
    docs = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("on"))).withColumn("s", F.instr(F.lower("text"), "on") - 1)
    return docs.select("doc_id", wd.snippet(F.col("text"), F.col("s"), F.col("s") + 2).alias("c")).select("doc_id", "c.snippet", F.col("c.from").alias("from"))


@query("""SELECT o_orderkey, CASE WHEN m < 1 THEN 'меньше минуты' WHEN m < 60 THEN '≈ ' || floor(m + 0.5)::INT || ' мин ' || w ELSE '≈ ' || floor(m / 60)::INT || ' ч ' || floor(m - floor(m / 60)::INT * 60 + 0.5)::INT || ' мин ' || w END AS label
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'слушать' ELSE 'читать' END AS w, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey * 37 % 200000) / (1.25 * 850) ELSE (o_orderkey * 37 % 200000) / 1100.0::DOUBLE END AS m FROM orders)""")
def c21_a23_remaining(spark, sf):
    listening = F.col("o_orderkey") % 2 == 0
    minutes = wd.minutes_left(F.col("o_orderkey") * 37 % 200000, F.lit(1.25), listening)
    return table(spark, sf, "orders").select("o_orderkey", wd.remaining(minutes, listening).alias("label"))


@query("""SELECT p_partkey, rtrim(rtrim(printf('%.2f', 0.5 + (p_partkey % 40) * 0.05), '0'), '.') || '×' AS label FROM part""")
def c21_speed_labels(spark, sf):
    return table(spark, sf, "part").select("p_partkey", wd.speed_label(F.lit(0.5) + (F.col("p_partkey") % 40) * 0.05).alias("label"))


@query("""WITH l AS (SELECT page_id, ['Скачать fb2', 'FB2.ZIP', 'fb2 epub', 'xfb2', 'file.fb2.zip ', 'fb23', 'Doc fb2', 'в fb2!'][(page_id % 8)::INT + 1] AS label FROM pages)
    SELECT page_id, NOT regexp_matches(lower(label), 'epub|rtf|pdf|txt|doc') AND regexp_matches(lower(label), '(^|[^a-zа-яё0-9])fb2(\\.zip)?($|[^a-zа-яё0-9])') AS fb2 FROM l""")
def f10_says_fb2(spark, sf):
    labels = F.array(*map(F.lit, ["Скачать fb2", "FB2.ZIP", "fb2 epub", "xfb2", "file.fb2.zip ", "fb23", "Doc fb2", "в fb2!"]))
    return table(spark, sf, "pages").select("page_id", wd.says_fb2(labels[(F.col("page_id") % 8).cast("int")]).alias("fb2"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(CASE WHEN doc_id % 7 = 0 THEN text || 'ж' ELSE text END, '[\\x{0400}-\\x{04FF}]') THEN 'ru' ELSE 'en' END AS language FROM documents""")
def w11_book_language(spark, sf):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("ж"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", wd.book_language(text).alias("language"))


_AGE = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id * 97 % 30000000 - 1000 END"


@query(f"""WITH e AS (SELECT event_id, {_AGE} AS age, event_id % 3 = 0 AS failed, event_id % 17 = 0 AS forced, CASE WHEN event_id % 5 > 0 THEN 'v' || event_id % 2 END AS installed FROM events)
    SELECT event_id, forced OR age IS NULL OR age < 0 OR age >= CASE WHEN failed THEN 120000 ELSE 21600000 END AS app,
    installed IS NOT NULL AND (forced OR age IS NULL OR installed <> 'v1' OR age >= CASE WHEN failed THEN 120000 ELSE 21600000 END) AS voices FROM e""")
def f13_checks_due(spark, sf):
    i = F.col("event_id")
    age, failed, forced = F.expr(_AGE), i % 3 == 0, i % 17 == 0
    installed = F.when(i % 5 > 0, F.concat(F.lit("v"), i % 2))
    return table(spark, sf, "events").select("event_id", wd.check_due(age, failed, forced).alias("app"), wd.voice_check_due(F.lit("v1"), installed, age, failed, forced).alias("voices"))


_STAGES = ["CHECKING", "UP_TO_DATE", "AVAILABLE", "DOWNLOADING", "PREPARING", "CONFIRMING", "CHECK_FAILED", "INSTALL_FAILED", "UNKNOWN"]
_FIXED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in wd.HEADLINES.items())


@query(f"""WITH s AS (SELECT event_id, {_STAGES}[(event_id % 9)::INT + 1] AS stage, event_id % 2 = 0 AS asked, event_id % 4 AS latest, event_id * 1000003 % 90000000 AS size, event_id * 700001 % 90000000 AS done FROM events)
    SELECT event_id, CASE WHEN stage IN ('AVAILABLE', 'INSTALL_FAILED') THEN asked OR latest <> 1 WHEN stage IN ('DOWNLOADING', 'PREPARING', 'CONFIRMING') THEN true WHEN stage = 'UNKNOWN' THEN false ELSE asked END AS shown,
    CASE stage WHEN 'UP_TO_DATE' THEN 'У вас самая свежая версия' || CASE WHEN asked THEN ' — от мая' ELSE '' END WHEN 'AVAILABLE' THEN 'Вышла новая версия от мая' || CASE WHEN size > 0 THEN ' (≈ ' || size // 1048576 || ' МБ)' ELSE '' END
    WHEN 'DOWNLOADING' THEN 'Скачиваем обновление' || CASE WHEN done > 0 OR size > 0 THEN ': ' || done // 1048576 || CASE WHEN size > 0 THEN ' из ' || size // 1048576 ELSE '' END || ' МБ' ELSE '' END {_FIXED} END AS headline FROM s""")
def f21_update_card(spark, sf):
    i = F.col("event_id")
    stage, asked, size, done = F.array(*map(F.lit, _STAGES))[(i % 9).cast("int")], i % 2 == 0, i * 1000003 % 90000000, i * 700001 % 90000000
    when = F.when((stage == "AVAILABLE") | asked, "мая")
    return table(spark, sf, "events").select("event_id", wd.update_shown(stage, asked, i % 4, F.lit(1)).alias("shown"), wd.update_headline(stage, when, size, done, size).alias("headline"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS site FROM pages""")
def c21_site_labels(spark, sf):
    return table(spark, sf, "pages").select("page_id", wd.site_label(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)).alias("site"))


@query("""WITH t AS (SELECT item_id, url_encode(text) AS e FROM benchmark), p AS (SELECT item_id, list_transform(regexp_extract_all(e, '%[0-7][0-9A-F]|%[89A-F][0-9A-F]|[^%]'), lambda x: CASE WHEN regexp_full_match(x, '%[0-7].') THEN chr(('0x' || x[2:3])::INT) ELSE x END) AS c FROM t)
    SELECT item_id, array_to_string(c, '') AS escaped FROM p""")
def r4_percent_encoded(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", wd.percent_encoded(F.col("text")).alias("escaped"))


# --- shelves


@query("""SELECT s_suppkey, CASE WHEN trim(s) = '' THEN 'Неизвестный автор' ELSE s END AS author, upper(f) AS format, s_suppkey % 10 / 10.0 > 0 AND s_suppkey % 10 / 10.0 < 0.995 AS reading
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE s_name END AS s, 'fb' || s_suppkey % 3 AS f FROM supplier)""")
def f3_f12_shelf(spark, sf):
    books = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "  ").otherwise(F.col("s_name")).alias("author"), F.concat(F.lit("fb"), F.col("s_suppkey") % 3).alias("format"))
    return shelf.shelf_rows(books).withColumn("reading", shelf.in_progress(F.col("s_suppkey") % 10 / 10.0))


@query("""WITH b AS (SELECT doc_id AS book, source, lang AS format FROM documents WHERE doc_id % 3 = 0), a AS (SELECT doc_id, source, lang AS format FROM documents WHERE doc_id % 3 = 1)
    SELECT a.doc_id, a.source, a.format, min(b.book) AS book FROM a JOIN b ON a.source = b.source AND a.format = b.format GROUP BY ALL""")
def j9_known_books(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("format"))
    books = docs.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "book")
    return shelf.known_book(books, docs.where("doc_id % 3 = 1")).select("doc_id", "source", "format", "book")


@query("""SELECT arg_max(o_custkey, (o_orderkey % 997, o_custkey)) AS book FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def l3_last_opened(spark, sf):
    openings = table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), (F.col("o_orderkey") % 997).alias("at"))
    return shelf.last_opened(openings, table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("book")))


@query("""SELECT o_orderkey, o_custkey AS book FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def w4_deleted_books(spark, sf):
    gone = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("book"))
    return shelf.without_books(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("book")), gone)


@query("""WITH t AS (SELECT c_custkey AS k, c_name AS v FROM customer), c AS (SELECT user_id AS k, arg_max({'v': CASE WHEN event_id % 4 > 0 THEN event_type END}, event_id) AS v FROM events GROUP BY 1)
    SELECT k, v FROM (SELECT coalesce(t.k, c.k) AS k, CASE WHEN c.k IS NOT NULL THEN c.v.v ELSE t.v END AS v FROM t FULL JOIN c ON t.k = c.k) WHERE v IS NOT NULL""")
def w5_w7_upserts(spark, sf):
    kept = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    changes = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("v"), "event_id")
    return shelf.upserted(kept, changes, ["k"], "event_id")


@query("""WITH p AS (SELECT event_type AS word, user_id AS book, event_id AS "at", 'v' || event_id AS spoken, event_id % 3 = 0 AS e FROM events), l AS (SELECT book, word, arg_max({'s': spoken, 'e': e}, "at") AS p, max("at") AS "at" FROM p GROUP BY ALL),
    o AS (SELECT c_custkey AS book, CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'quiet' END AS word, 'old' AS spoken FROM customer UNION ALL SELECT NULL, w, 'shared' FROM (VALUES ('click'), ('other')) v(w)), k AS (SELECT word, arg_max(p, "at") AS p FROM l GROUP BY word)
    SELECT book, word, spoken FROM o WHERE book IS NOT NULL AND (book, word) NOT IN (SELECT (book, word) FROM l) UNION ALL SELECT NULL, word, spoken FROM o WHERE book IS NULL AND word NOT IN (SELECT word FROM l)
    UNION ALL SELECT book, word, p.s FROM l WHERE NOT p.e UNION ALL SELECT NULL, word, p.s FROM k WHERE p.e""")
def w6_put_words(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("book"), F.when(F.col("c_custkey") % 2 == 0, "click").otherwise("quiet").alias("word"), F.lit("old").alias("spoken"))
    old = old.union(spark.createDataFrame([(None, "click", "shared"), (None, "other", "shared")], "book long, word string, spoken string"))
    puts = table(spark, sf, "events").select(F.col("user_id").alias("book"), F.upper("event_type").alias("word"), F.concat(F.lit("v"), "event_id").alias("spoken"), (F.col("event_id") % 3 == 0).alias("everywhere"), F.col("event_id").alias("at"))
    return shelf.put_word(old, puts)


@query("""WITH o AS (SELECT p_name AS word, 'own' AS spoken FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), s AS (SELECT p_name AS word, 'shared' AS spoken FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
    SELECT coalesce(o.word, s.word) AS word, coalesce(o.spoken, s.spoken) AS spoken, o.word IS NOT NULL AS own, (o.word IS NOT NULL)::INT + (s.word IS NOT NULL)::INT AS listed FROM o FULL JOIN s ON o.word = s.word""")
def s18_u2_l10_pronunciations(spark, sf):
    part = table(spark, sf, "part")
    own = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("word"), F.lit("own").alias("spoken")).distinct()
    shared = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("word"), F.lit("shared").alias("spoken")).distinct()
    listed = shelf.pronunciations(own, shared).groupBy("word").agg(F.count("*").cast("int").alias("listed"))
    return shelf.spoken_for(own, shared).join(listed, "word").select("word", "spoken", "own", "listed")


@query("""SELECT l_orderkey AS book, count(*) AS n, sum(b) AS bytes, max(r) AS last FROM (SELECT l_orderkey, b, sum(b) OVER w AS used, row_number() OVER w AS r FROM (SELECT DISTINCT ON (l_orderkey, sha) l_orderkey, sha, ord, b FROM
    (SELECT l_orderkey, 'h' || l_linenumber % 3 AS sha, l_linenumber AS ord, 100 AS b, 10 + l_linenumber * 4 AS wide FROM lineitem) WHERE wide >= 16 ORDER BY l_orderkey, sha, ord) WINDOW w AS (PARTITION BY l_orderkey ORDER BY ord)) WHERE used <= 250 GROUP BY 1""")
def w12_stored_pictures(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").cast("long").alias("ord"), F.concat(F.lit("h"), F.col("l_linenumber") % 3).alias("sha1"), F.lit(100).cast("long").alias("bytes"), (10 + F.col("l_linenumber") * 4).alias("width"), F.lit(50).alias("height"), F.lit("png").alias("extension"))
    kept = shelf.stored_pictures(rows, 250)
    return kept.groupBy("book").agg(F.count("*").alias("n"), F.sum(F.lit(100)).alias("bytes"), F.max(F.regexp_extract("name", "img(\\d+)\\.png", 1).cast("long")).alias("last"))


@query("""SELECT c_custkey AS name, CASE WHEN c_nationkey % 3 = 0 THEN 'F' END AS gender, c_custkey % 9 AS mentions, CASE WHEN c_nationkey % 3 = 0 THEN 'known' ELSE 'unclear' END AS part FROM customer WHERE c_nationkey % 3 = 0 OR c_custkey % 9 >= 5""")
def f17_cast_split(spark, sf):
    return shelf.cast_split(table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.when(F.col("c_nationkey") % 3 == 0, "F").alias("gender"), (F.col("c_custkey") % 9).alias("mentions")))


_NAMES = ["маша", "маши", "машу", "иван", "ивана", "иваном", "лань чжань", "лань чжаня", "костя", "кость", "дом", "мир"]
_BASES = {"маша": "маша", "маши": "маша", "машу": "маша", "иван": "иван", "ивана": "иван", "иваном": "иван", "лань чжань": "лань чжань", "лань чжаня": "лань чжань", "костя": "костя", "кость": "костя", "дом": "дом", "мир": "мир"}
_BASE_ROWS = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(_BASES.items()))


@query(f"""WITH b(name, base, i) AS (VALUES {_BASE_ROWS}), m AS (SELECT b.name, base, count(*) * CASE WHEN b.name = base THEN 5 ELSE 1 END AS n FROM events JOIN b ON event_id % 12 = i GROUP BY 1, 2)
    SELECT base AS name, sum(n)::BIGINT AS n FROM m GROUP BY 1 HAVING sum(n) >= 3 OR base = 'мир'""")
def a6_j19_members(spark, sf):
    names = F.array(*map(F.lit, _NAMES))
    spoken = table(spark, sf, "events").select(names[(F.col("event_id") % 12).cast("int")].alias("name"))
    base = F.when(F.col("name").isin([k for k, v in _BASES.items() if k == v]), 5).otherwise(1)
    mentions = spoken.groupBy("name").agg(F.sum(base).alias("n"))
    return shelf.members(mentions, spark.createDataFrame([("мир",)], "name string"))


@query("""WITH n AS (SELECT DISTINCT w[1] || CASE WHEN len(w) > 9 THEN ' ' || w[2] ELSE '' END AS name FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark) WHERE len(w) > 1), m AS (SELECT name, length(name) * 1000 + ascii(name) AS ord FROM n), p AS (SELECT DISTINCT name, ord, unnest(string_split(name, ' ')) AS part FROM m),
    s AS (SELECT DISTINCT lower(text) AS sentence, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE length(text) < 600), f AS (SELECT DISTINCT word, sentence, name, ord FROM s JOIN p ON substr(part, 1, 2) = substr(word, 1, 2) WHERE length(word) >= 2 AND (part = word OR (least(length(part), length(word)) >= 3 AND abs(length(part) - length(word)) <= 2 AND substr(part, 1, greatest(3, least(length(part), length(word)) - 2)) = substr(word, 1, greatest(3, least(length(part), length(word)) - 2))))),
    g AS (SELECT word, sentence, arg_min(name, (ord, name)) FILTER (contains(sentence, name)) AS named, count(*) AS n, min(name) AS sole FROM f GROUP BY 1, 2) SELECT word, sentence, coalesce(named, CASE WHEN n = 1 THEN sole END) AS member FROM g WHERE named IS NOT NULL OR n = 1""")
def j18_characters(spark, sf):
    tokens = lambda text: F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    w = table(spark, sf, "benchmark").select(tokens("text").alias("w")).where("size(w) > 1")
    cast = w.select(F.when(F.size("w") > 9, F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)))).otherwise(F.get("w", F.lit(0))).alias("name")).distinct()
    words = table(spark, sf, "documents").where("length(text) < 600").select(F.lower("text").alias("sentence"), F.explode(tokens("text")).alias("word")).distinct()
    return shelf.characters_of(words, cast.withColumn("ord", F.length("name") * 1000 + F.ascii("name")))


@query("""WITH f AS (SELECT user_id AS line, event_id AS frame FROM events), m AS (SELECT user_id AS line, event_id AS frame FROM events WHERE event_id % 5 = 0)
    SELECT line, frame, (SELECT max(m.frame) FROM m WHERE m.line = f.line AND m.frame <= f.frame) AS mark FROM f""")
def j16_playing(spark, sf):
    frames = table(spark, sf, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("frame"))
    return shelf.playing(frames, frames.where("frame % 5 = 0"))


@query("""WITH s AS (SELECT chr((97 + p_partkey % 24)::INT) AS symbol, max(p_partkey % 24) AS id FROM part GROUP BY 1) SELECT symbol, id FROM s UNION ALL SELECT 'z', id FROM s WHERE symbol = 'b'""")
def v14_vocabulary(spark, sf):
    rows = table(spark, sf, "part").select(F.char(97 + F.col("p_partkey") % 24).alias("symbol"), (F.col("p_partkey") % 24).alias("id"))
    return shelf.vocabulary(rows.union(rows.select(F.concat("symbol", "symbol"), "id")), {"z": "b", "a": "c", "y": "?"})


@query("""SELECT p_partkey AS path, p_size AS size, p_partkey % 7 AS mtime FROM part WHERE p_size > 10""")
def v15_valid_cache(spark, sf):
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"), (F.col("p_partkey") % 7).alias("mtime"))
    return shelf.still_valid(files, files.withColumn("size", F.when(F.col("size") > 10, F.col("size")).otherwise(F.col("size") + 1)))


_CANDIDATES = "l_orderkey AS page, l_linenumber AS ord, l_extendedprice % 900 AS text, l_extendedprice % 900 - l_quantity AS net, l_extendedprice % 700 AS narrative, l_quantity - 2 AS leftover, l_linenumber % 3 AS blocks"


@query(f"""WITH c AS (SELECT {_CANDIDATES} FROM lineitem) SELECT page, arg_max(ord, (narrative, -leftover, -ord)) AS ord FROM c WHERE text >= 80 AND net >= 80 AND net * 2 >= text AND narrative >= 80 AND leftover >= 0 AND (blocks > 1 OR narrative >= 300) GROUP BY page""")
def l6_f18_best_candidates(spark, sf):
    return shelf.best_candidates(table(spark, sf, "lineitem").selectExpr(*_CANDIDATES.split(", ")))


@query("""WITH u AS (SELECT l_orderkey AS page, l_partkey % 5 AS node, 0 AS kind, l_linenumber AS ord FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_orderkey, l_partkey % 5, 1, l_linenumber FROM lineitem)
    SELECT page, node, (min((kind, ord)))[1] AS kind, (min((kind, ord)))[2]::BIGINT AS ord FROM u GROUP BY 1, 2""")
def u1_candidates(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 5).alias("node"), F.col("l_linenumber").alias("ord"))
    return shelf.united(rows.where("ord % 2 = 0"), rows)


_PAGES = "l_suppkey AS book, l_orderkey * 10 + l_linenumber AS page, floor(l_extendedprice % 400)::INT AS letters, l_discount * 10 AS image_share, (l_partkey % 3)::INT AS clusters, (l_quantity * 20)::INT AS bad_glyphs"


@query(f"""WITH p AS (SELECT {_PAGES} FROM lineitem), s AS (SELECT *, letters < 200 AND ((image_share >= 0.45 AND letters < 120) OR (letters < 20 AND clusters = 0 AND image_share > 0.1)) AS scanned FROM p),
    b AS (SELECT book, count(*) FILTER (scanned) >= greatest(2, count(*) // 4) OR (count(*) <= 3 AND count(*) FILTER (scanned) > 0) AS whole FROM s GROUP BY 1)
    SELECT s.book, page, scanned, (bad_glyphs >= 150 AND letters < bad_glyphs // 4) OR (whole AND scanned) AS recognize FROM s JOIN b ON s.book = b.book""")
def f11_scanned_pages(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page"), F.floor(F.col("l_extendedprice") % 400).cast("int").alias("letters"), (F.col("l_discount") * 10).alias("image_share"), (F.col("l_partkey") % 3).cast("int").alias("clusters"), (F.col("l_quantity") * 20).cast("int").alias("bad_glyphs"))
    return shelf.scanned_pages(rows)


# --- voices

_ENGINES = ["KOKORO", "KOKORO_RU", "VOSK", "SYSTEM"]


@query(f"""WITH e AS (SELECT event_id, {_ENGINES}[(event_id % 4)::INT + 1] AS c, {_ENGINES}[(event_id // 4 % 4)::INT + 1] AS n, {_ENGINES}[(event_id // 16 % 4)::INT + 1] AS r, CASE WHEN event_id % 3 = 0 THEN 'en' ELSE 'ru' END AS l FROM events)
    SELECT event_id, CASE WHEN NOT (c = 'KOKORO' AND l <> 'en') AND NOT (c = 'KOKORO_RU' AND l = 'en') THEN c WHEN NOT (n = 'KOKORO' AND l <> 'en') AND NOT (n = 'KOKORO_RU' AND l = 'en') THEN n
    WHEN NOT (r = 'KOKORO' AND l <> 'en') AND NOT (r = 'KOKORO_RU' AND l = 'en') THEN r ELSE n END AS engine FROM e""")
def f15_narrators(spark, sf):
    engine = lambda k: F.struct(F.array(*map(F.lit, _ENGINES))[(F.floor(F.col("event_id") / k) % 4).cast("int")].alias("engine"))
    language = F.when(F.col("event_id") % 3 == 0, "en").otherwise("ru")
    return table(spark, sf, "events").select("event_id", voices.narrator_for(engine(1), engine(4), engine(16), language)["engine"].alias("engine"))


_ROLE = "CASE event_id % 5 WHEN 0 THEN 'NARRATOR' WHEN 1 THEN 'MALE' WHEN 2 THEN 'FEMALE' WHEN 3 THEN 'SPEECH' ELSE 'UNKNOWN' END"
_MODE = "CASE event_id % 3 WHEN 0 THEN 'OFF' WHEN 1 THEN 'SINGLE' ELSE 'BY_GENDER' END"


@query(f"""WITH e AS (SELECT event_id, {_ROLE} AS role, {_MODE} AS mode, CASE WHEN event_id % 7 > 0 THEN 's' END AS s, CASE WHEN event_id % 11 > 0 THEN 'm' END AS m FROM events)
    SELECT event_id, CASE mode WHEN 'SINGLE' THEN CASE WHEN role = 'NARRATOR' THEN 'n' ELSE coalesce(s, 'n') END WHEN 'BY_GENDER' THEN CASE role WHEN 'MALE' THEN coalesce(m, 'n') WHEN 'FEMALE' THEN 'f' ELSE 'n' END ELSE 'n' END AS voice FROM e""")
def f16_role_voices(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", voices.voice_for(F.expr(_MODE), F.expr(_ROLE), F.when(i % 7 > 0, "s"), F.when(i % 11 > 0, "m"), F.lit("f"), F.lit("n")).alias("voice"))


@query(f"""WITH e AS (SELECT event_id, {_MODE} AS mode, 'v' || event_id % 5 AS m, 'v' || event_id // 5 % 5 AS f, 'v' || event_id // 25 % 5 AS n FROM events),
    k AS (SELECT *, CASE WHEN m IN ('v0', 'v1', 'v2') AND m <> n THEN m ELSE CASE WHEN n <> 'v0' THEN 'v0' ELSE 'v2' END END AS man FROM e),
    w AS (SELECT *, CASE WHEN f IN ('v0', 'v1', 'v2') AND f <> n AND f <> man THEN f ELSE CASE WHEN n <> 'v1' AND man <> 'v1' THEN 'v1' END END AS woman FROM k)
    SELECT event_id, CASE WHEN mode = 'BY_GENDER' THEN man ELSE m END AS male, CASE WHEN mode = 'BY_GENDER' THEN woman ELSE f END AS female FROM w""")
def f16_distinct_voices(spark, sf):
    i = F.col("event_id")
    voice = lambda k: F.concat(F.lit("v"), F.floor(i / k) % 5)
    offer = F.array(*[F.struct(F.lit(c).alias("choice"), F.lit(g).alias("gender")) for c, g in (("v0", "MALE"), ("v1", "FEMALE"), ("v2", "MALE"))])
    picked = voices.distinct_voices(F.expr(_MODE), F.lit("x"), voice(1), voice(5), voice(25), offer)
    return table(spark, sf, "events").select("event_id", picked["male"].alias("male"), picked["female"].alias("female"))


@query("""SELECT c_custkey AS speaker, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey % 7 <> 0, c_nationkey % 2 <> 0, c_custkey) AS place FROM customer""")
def l8_voice_order(spark, sf):
    """Each engine's voices in their order; market segments are the engines."""
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("engine"), F.col("c_custkey").alias("speaker"), (F.col("c_custkey") % 7 == 0).alias("recommended"), (F.col("c_nationkey") % 2 == 0).alias("male"))
    return voices.voice_places(rows).select("speaker", "place")


@query("""SELECT c_name AS name, row_number() OVER (PARTITION BY seg ORDER BY l <> 'ru', net, absent, q DESC, c_name) AS place FROM (SELECT c_name, c_mktsegment AS seg, CASE c_custkey % 3 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' ELSE 'de' END AS l, c_custkey % 2 = 0 AS net, c_custkey % 5 = 0 AS absent, c_nationkey AS q FROM customer) WHERE l <> 'de'""")
def s24_system_voices(spark, sf):
    k = F.col("c_custkey")
    language = F.when(k % 3 == 0, "ru").when(k % 3 == 1, "en").otherwise("de")
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("engine"), F.col("c_name").alias("name"), language.alias("language"), (k % 2 == 0).alias("needs_network"), (k % 5 == 0).alias("not_installed"), F.col("c_nationkey").alias("quality"))
    return voices.system_places(rows).select("name", "place")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'ABSENT' WHEN p_size > 25 THEN 'FAST' ELSE 'LEGACY' END AS kind, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_partkey % 4 = 2 THEN 0 END WHEN p_partkey % 4 IN (0, 1) THEN p_partkey % 4 END AS speaker,
    list_filter(['a', 'b', 'c'], lambda x: NOT list_contains(CASE WHEN p_size % 2 = 0 THEN ['b'] ELSE ['a', 'c'] END, x)) AS missing FROM part""")
def f19_u5_installs(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    found = F.when(size % 2 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("c")))
    speaker = voices.speaker_in(F.when(size % 2 == 0, "DIMA").otherwise("BASE"), key % 4)
    return table(spark, sf, "part").select("p_partkey", voices.install_kind(size % 3 != 0, F.greatest(size - 25, F.lit(0))).alias("kind"), speaker.alias("speaker"), voices.missing_files(F.array(*map(F.lit, "abc")), found).alias("missing"))


@query("""WITH p AS (SELECT c_custkey AS book, unnest(range(0, 4)) AS page FROM customer), m AS (SELECT o_custkey AS book, o_orderkey % 9 AS paragraph, o_orderkey % 50 AS o FROM orders)
    SELECT p.book, page, count(*) AS n FROM p JOIN m ON p.book = m.book WHERE (paragraph, o) >= (page * 2, 10) AND (paragraph, o) < (page * 2 + 2, 10) GROUP BY 1, 2""")
def f14_bookmarks(spark, sf):
    place = lambda p: F.struct(p.cast("long").alias("paragraph"), F.lit(10).cast("long").alias("offset"))
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("book"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page"))
    pages = pages.select("book", F.col("page").cast("long").alias("page"), place(F.col("page") * 2).alias("first"), place(F.col("page") * 2 + 2).alias("past"))
    marks = table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), (F.col("o_orderkey") % 9).alias("paragraph"), (F.col("o_orderkey") % 50).alias("offset"))
    return shelf.bookmarked(pages, marks)


@query("""SELECT e.user_id, e.event_id, 'stress of ' || event_type AS found FROM events e WHERE event_type IN ('click', 'purchase')""")
def s20_s21_lexicon(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("word"))
    lexicon = events.select("word").distinct().where("word in ('click', 'purchase')").withColumn("found", F.concat(F.lit("stress of "), "word"))
    return shelf.found_words(events, lexicon).select("user_id", "event_id", "found")


@query("""SELECT p_partkey, '{' || '"2":{"kind":"CAPTION"},"' || (10 + p_partkey % 7) || '":{"kind":"IMAGE","image":"p' || p_partkey || '.png","width":' || p_size || ',"height":9}' || '}' AS styles, CASE WHEN p_partkey % 7 < 3 THEN [p_partkey % 7] ELSE [] END AS later FROM part""")
def v1_styles(spark, sf):
    key = F.col("p_partkey")
    json = F.concat(F.lit('{"x":{"kind":"NOTE"},"3":{"kind":"ODD"},"'), 10 + key % 7, F.lit('":{"kind":"IMAGE","image":"p'), key, F.lit('.png","width":'), "p_size", F.lit(',"height":9},"2":{"kind":"CAPTION","image":"null","width":4}}'))
    rows = table(spark, sf, "part").select("p_partkey", shelf.decoded_styles(json).alias("s"))
    later = F.map_keys(shelf.part_styles(F.col("s"), F.lit(10), F.lit(13)))
    return rows.select("p_partkey", shelf.encoded_styles(F.col("s")).alias("styles"), F.transform(later, lambda k: k.cast("long")).alias("later"))


@query("""WITH e AS (SELECT event_id, ['SUPERTONIC', 'VOSK', 'SYSTEM', 'KOKORO'][(event_id % 4)::INT + 1] AS engine, ['ANGRY', 'SAD', 'JOY'][(event_id % 3)::INT + 1] AS tone, CASE WHEN event_id % 5 = 0 THEN 'NARRATOR' ELSE 'MALE' END AS role, CASE WHEN event_id % 7 = 0 THEN 'OFF' ELSE 'VIVID' END AS em FROM events)
    SELECT event_id, CASE WHEN engine = 'SUPERTONIC' THEN 1.2::DOUBLE * 1.1::DOUBLE * 1.05::DOUBLE ELSE 1.2::DOUBLE * 1.1::DOUBLE END AS speed, CASE WHEN engine = 'VOSK' THEN CASE WHEN em <> 'OFF' AND role <> 'NARRATOR' AND tone IN ('ANGRY', 'JOY') THEN 0.75 ELSE 0.55 END END::DOUBLE AS noise,
    CASE WHEN engine = 'SYSTEM' THEN 1.07 ELSE 1 END::DOUBLE AS pitch FROM e""")
def v8_voice_params(spark, sf):
    i = F.col("event_id")
    pick = lambda names: F.array(*map(F.lit, names))[(i % len(names)).cast("int")]
    role, emotions = F.when(i % 5 == 0, "NARRATOR").otherwise("MALE"), F.when(i % 7 == 0, "OFF").otherwise("VIVID")
    params = voices.voice_params(pick(["SUPERTONIC", "VOSK", "SYSTEM", "KOKORO"]), F.lit(1.2), F.lit(1.1), F.lit(1.07), emotions, role, pick(["ANGRY", "SAD", "JOY"]))
    return table(spark, sf, "events").select("event_id", params.alias("p")).select("event_id", "p.speed", "p.noise", "p.pitch")


@query("""WITH RECURSIVE a AS (SELECT page_id AS url, CASE WHEN page_id % 3 = 0 THEN '200' ELSE '302' END AS s, CASE WHEN page_id % 3 = 0 THEN NULL ELSE (page_id * 7 + 1) % 53 END AS l FROM pages),
    w AS (SELECT url, url AS "at", [url] AS seen, 0 AS hop, '' AS status FROM a UNION ALL SELECT w.url, CASE WHEN n.status = '' THEN a.l ELSE w."at" END, CASE WHEN n.status = '' THEN list_append(w.seen, a.l) ELSE w.seen END, hop + 1, n.status
      FROM w LEFT JOIN a ON a.url = w."at", LATERAL (SELECT CASE WHEN a.l IS NULL THEN coalesce(a.s, 'none') WHEN list_contains(w.seen, a.l) THEN 'LOOP' WHEN a.l % 11 = 5 THEN 'BLOCKED' WHEN hop = 5 THEN 'TOO_MANY' ELSE '' END AS status) n WHERE w.status = '')
    SELECT url, "at", nullif(status, 'none') AS status, len(seen)::INT AS seen FROM w WHERE status <> ''""")
def s14_u6_redirects(spark, sf):
    pages, key = table(spark, sf, "pages"), F.col("page_id")
    answers = pages.select(key.alias("url"), F.when(key % 3 == 0, "200").otherwise("302").alias("status"), F.when(key % 3 > 0, (key * 7 + 1) % 53).alias("location"))
    return corpus.redirected(answers.select("url"), answers, lambda source, target: target % 11 != 5)


@query("""SELECT event_id FROM (SELECT event_id, user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events) WHERE n IS NULL OR n - t >= 3600000000""")
def t9_debounced(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return corpus.debounced(events, "user_id", "t", "event_id", 3_600_000_000).select("event_id")


@query("""WITH u AS (SELECT l_orderkey AS book, l_linenumber AS ord, l_suppkey % 10 AS id, l_quantity > 45 AS g FROM lineitem), t AS (SELECT o_orderkey AS book, o_custkey % 10 AS id, 'p' || o_custkey AS c FROM orders),
    r AS (SELECT u.book, count(*) FILTER (t.c IS NULL) AS s, count(*) AS n, bool_or(g) AS g FROM u LEFT JOIN t ON u.book = t.book AND u.id = t.id GROUP BY 1)
    SELECT book, list_filter([CASE WHEN s > 0 THEN 'Пропущено рисунков: ' || s END, CASE WHEN g THEN 'Кодировка определена по буквам' END, CASE WHEN s = n THEN 'Рисунков нет' END], lambda x: x IS NOT NULL)[1:2] AS warnings FROM r""")
def j2_a15_l9_pictures(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("ord"), (F.col("l_suppkey") % 10).alias("id"), (F.col("l_quantity") > 45).alias("guessed"))
    kept = table(spark, sf, "orders").select(F.col("o_orderkey").alias("book"), (F.col("o_custkey") % 10).alias("id"), F.concat(F.lit("p"), "o_custkey").alias("content"), F.lit(0).alias("place"))
    found = corpus.resolved(rows, kept)
    guessed = rows.groupBy("book").agg(F.max("guessed").alias("guessed"))
    return corpus.warnings(found.join(guessed, "book"))


@query("""WITH s AS (SELECT l_orderkey AS book, l_linenumber * 100000000000 + round(l_extendedprice * 100)::BIGINT AS i, sum((l_partkey % 300 + 1) * 14) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT book, i, sum(n) OVER (PARTITION BY book ORDER BY i) - n AS "at" FROM s)
    SELECT a.book, a.i AS "index", least(count(*), 24) AS ahead FROM c a JOIN c b ON a.book = b.book AND b.i >= a.i AND b."at" - a."at" < 840 * 14 GROUP BY 1, 2""")
def t1_look_ahead(spark, sf):
    index = (F.col("l_linenumber") * 10**11 + F.round(F.col("l_extendedprice") * 100)).cast("long")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), index.alias("index"), ((F.col("l_partkey") % 300 + 1) * 14).alias("length"))
    return shelf.look_ahead(rows, seconds=840).select("book", "index", "ahead")


@query("""WITH w AS (SELECT item_id AS doc_id, regexp_extract_all(lower(text), '[\\p{L}+]+') AS w FROM benchmark), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)
    SELECT doc_id, (i - 1)::INT AS place, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before, w[i + 1] AS after FROM p""")
def n1_neighbours(spark, sf):
    return shelf.neighbours(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))


@query("""SELECT user_id AS book, greatest(arg_max(event_id % 9 - 2, event_id), 0) AS chapter, least(greatest(arg_max(value, event_id), 0.0), 1.0) AS progress, arg_max(event_id, event_id) FILTER (event_id % 3 > 0) AS opened FROM events WHERE value IS NOT NULL GROUP BY 1""")
def w3_positions(spark, sf):
    i = F.col("event_id")
    log = table(spark, sf, "events").where("value is not null").select(F.col("user_id").alias("book"), i.alias("seq"), (i % 9 - 2).alias("chapter"), F.col("value").alias("progress"), F.when(i % 3 > 0, i).alias("opened"))
    return shelf.positions(log)


@query("""WITH t AS (SELECT user_id AS talk, event_id AS ord, event_type AS speaker FROM events), b AS (SELECT *, lag(speaker) OVER w AS before, list(speaker) OVER (PARTITION BY talk ORDER BY ord ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS six FROM t WINDOW w AS (PARTITION BY talk ORDER BY ord))
    SELECT talk, ord, speaker, last_value(CASE WHEN speaker IS DISTINCT FROM before THEN before END IGNORE NULLS) OVER (PARTITION BY talk ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS other, coalesce(len(list_filter(six, lambda s: s <> speaker)), 0)::INT AS others FROM b""")
def n3_last_others(spark, sf):
    return shelf.last_others(table(spark, sf, "events").select(F.col("user_id").alias("talk"), F.col("event_id").alias("ord"), F.col("event_type").alias("speaker")))


@query("""WITH w AS (SELECT DISTINCT replace(unnest(regexp_extract_all(lower(text), '\\p{L}+')), 'q', 'ё') AS word FROM benchmark UNION SELECT DISTINCT replace(unnest(regexp_extract_all(lower(text), '\\p{L}+')), 'on', 'ё') FROM benchmark UNION SELECT DISTINCT replace(unnest(regexp_extract_all(lower(text), '\\p{L}+')), 'on', 'е') FROM benchmark)
    SELECT word FROM w WHERE word NOT IN (SELECT translate(word, 'ё', 'е') FROM w WHERE contains(word, 'ё'))""")
def j7_plain_spellings(spark, sf):
    w = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(\\p{L}+)"), F.lit(1))).alias("w"))
    forms = w.select(F.explode(F.array(*[F.replace("w", F.lit(a), F.lit(b)) for a, b in (("q", "ё"), ("on", "ё"), ("on", "е"))])).alias("word")).distinct()
    return corpus.without_plain_spelling(forms)


@query("""SELECT s_suppkey, regexp_replace(regexp_replace(translate(lower(trim('  ' || s_name || chr(39) || 's Ёж ')), 'ё' || chr(769), 'е'), '(\\S)[''’]s(\\s|$)', '\\1\\2', 'g'), 'x^', '') AS key FROM supplier""")
def c12_name_keys(spark, sf):
    from leafmill.functions import text as tx

    return table(spark, sf, "supplier").select("s_suppkey", tx.name_key(F.concat(F.lit("  "), "s_name", F.lit("'s Ёж "))).alias("key"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 - 1 >= 0 THEN ((least(o_orderkey % 7 - 1, 4) + (least(o_orderkey % 300, 100)::FLOAT / 100::FLOAT)::FLOAT)::FLOAT / 5::FLOAT)::FLOAT ELSE 0 END::FLOAT AS progress FROM orders""")
def v2_progress(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", library.to_progress(key % 7 - 1, key % 300, F.lit(100), F.lit(5)).alias("progress"))


@query("""SELECT o_custkey AS book_id, k AS kind, c AS chapter, count(*) AS n FROM (SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'BOOKMARK' WHEN 1 THEN 'HIGHLIGHT' ELSE 'ODD' END AS k, (o_orderkey % 4)::INT AS c FROM orders) WHERE k <> 'ODD' GROUP BY 1, 2, 3""")
def s17_l4_annotations(spark, sf):
    from leafmill.sources import stores

    one = F.struct(F.when(F.col("o_orderkey") % 3 == 0, "BOOKMARK").when(F.col("o_orderkey") % 3 == 1, "HIGHLIGHT").otherwise("ODD").alias("kind"), (F.col("o_orderkey") % 4).alias("chapter"), F.lit(1).alias("paragraph"), F.lit(2).alias("start"))
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("book_id")).agg(F.to_json(F.collect_list(one)).alias("json"))
    return stores.annotations(rows).groupBy("book_id", "kind", "chapter").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN ['маша', 'n' || s_suppkey] ELSE ['маша'] END AS names FROM supplier""")
def s19_choices(spark, sf):
    from leafmill.sources import stores

    key = F.col("s_suppkey")
    json = F.concat(F.lit('{"маша":"f","odd":"x","n'), key, F.lit('":"'), F.when(key % 2 == 0, "m").otherwise("?"), F.lit('"}'))
    return table(spark, sf, "supplier").select("s_suppkey", F.map_keys(stores.choices(json)).alias("names"))


_ENGINE = "CASE {k} % 4 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN 'KOKORO' WHEN 2 THEN 'SUPERTONIC' ELSE 'VOSK' END"
_CATALOG = f"""{_ENGINE.format(k='p_partkey')} AS engine, p_name AS voice, p_size % 9 AS speaker, CASE p_size % 3 WHEN 0 THEN 'a female voice' WHEN 1 THEN 'male' ELSE 'clear' END AS description, p_brand AS package, CASE WHEN p_size % 2 = 0 THEN 'ru' ELSE 'en' END AS language, p_size % 5 = 0 AS not_installed, CASE WHEN p_size % 7 > 0 THEN p_size % 7 > 3 END AS male, p_partkey AS ord, p_size % 11 = 0 AS is_default"""
_NARRATORS = f"""c_custkey AS narrator, {_ENGINE.format(k='c_custkey')} AS engine, 'Brand#' || (c_custkey % 5 + 1) || (c_nationkey % 5 + 1) AS package, CASE WHEN c_nationkey % 2 = 0 THEN 'ru' ELSE 'en' END AS language, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE '' END AS voice"""


@query(f"""WITH c AS (SELECT {_CATALOG} FROM part), n AS (SELECT {_NARRATORS} FROM customer)
    SELECT narrator, voice, gender, place FROM (SELECT narrator, c.voice, CASE c.engine WHEN 'SUPERTONIC' THEN CASE WHEN speaker < 5 THEN 'FEMALE' ELSE 'MALE' END WHEN 'KOKORO' THEN CASE WHEN contains(description, 'female') THEN 'FEMALE' WHEN contains(description, 'male') THEN 'MALE' END ELSE CASE WHEN male THEN 'MALE' WHEN NOT male THEN 'FEMALE' END END AS gender, row_number() OVER (PARTITION BY narrator ORDER BY ord, c.voice) AS place
    FROM c JOIN n USING (engine) WHERE c.engine <> 'SYSTEM' OR (c.package = n.package AND c.language = n.language AND NOT not_installed)) WHERE place <= 24""")
def f20_offered_voices(spark, sf):
    narrators = table(spark, sf, "customer").select(F.expr("struct(" + _NARRATORS + ")").alias("n")).select("n.*")
    return voices.offered(narrators, table(spark, sf, "part").select(F.expr("struct(" + _CATALOG + ")").alias("c")).select("c.*"))


@query(f"""WITH d AS (SELECT package, language, arg_min(voice, ord) AS heard FROM (SELECT {_CATALOG} FROM part) WHERE engine = 'SYSTEM' AND is_default GROUP BY 1, 2) SELECT narrator, coalesce(nullif(voice, ''), CASE WHEN engine = 'SYSTEM' THEN heard END, voice) AS heard FROM (SELECT {_NARRATORS} FROM customer) LEFT JOIN d USING (package, language)""")
def f20_heard_narrators(spark, sf):
    narrators = table(spark, sf, "customer").select(F.expr("struct(" + _NARRATORS + ")").alias("n")).select("n.*")
    return voices.engine_default(narrators, table(spark, sf, "part").select(F.expr("struct(" + _CATALOG + ")").alias("c")).select("c.*"))
