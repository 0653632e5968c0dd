"""Queries of column functions: one scan, one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.functions import web
from leafmill.operators import library, shelf, voices
from leafmill.plans.registry import query, table

_CHAPTER = r"^(?:(?i:(?:глава|chapter|часть|part)\s+(?:\d+|[ivxlcdm]+)(?:[. :—–-].*)?|пролог|эпилог|prologue|epilogue)(?:[. :—–-].*)?)$"


@query("""SELECT doc_id, trim(regexp_replace(replace(text, chr(173), ''), '[\\t\\n\\r\\x{00A0}\\x{2000}-\\x{200B} ]+', ' ', 'g')) AS text FROM documents""")
def c1_normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query("SELECT doc_id, translate(lower(text), 'ё', 'е') AS folded, length(text) AS n FROM documents")
def c7_fold_search(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"), F.length("text").cast("long").alias("n"))


@query("SELECT item_id, translate(lower(text), 'ё+', 'е') AS key FROM benchmark")
def c8_word_key(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.word_key(F.col("text")).alias("key"))


@query("SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM benchmark")
def c11_same_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.letters_key(F.col("text")).alias("key"))


@query("""SELECT doc_id, length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g')) AS cyrillic, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
    CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 4 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 2 * length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g')) THEN 'en' ELSE 'ru' END AS language FROM documents""")
def c16_script_letters(spark, sf):
    cyrillic, latin = tx.letter_counts(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", cyrillic.cast("long").alias("cyrillic"), latin.cast("long").alias("latin"), tx.language(F.col("text"), "ru").alias("language"))


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, line, length(line) <= 120 AND regexp_matches(trim(line), '"
    + _CHAPTER.replace("'", "''")
    + "') AS h FROM l) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (h) AS n_headings FROM m GROUP BY doc_id"
)
def f7_heading(spark, sf):
    lines = F.split("text", "\n", -1)
    heads = F.filter(lines, lambda x: tx.is_heading(x))
    return table(spark, sf, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(heads).cast("long").alias("n_headings"))


@query("""WITH s AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, turn, CASE WHEN NOT contains(text, '!') THEN NULL
    WHEN regexp_matches(text, '!\\s*!') OR regexp_matches(text, '(^|[^\\p{L}-])\\p{Lu}{3,}([^\\p{L}-]|$)') THEN 'ANGRY' WHEN regexp_matches(text, '\\?\\s*!|!\\s*\\?') THEN 'SURPRISE' ELSE 'EXCLAIM' END AS tone FROM s""")
def q13_sentence_tone(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.sentence_tone(F.col("text")).alias("tone"))


@query()
def a19_cer(spark, sf):
    """Each passage against the next one; the SQL engine's edit distance counts bytes, so there is no SQL."""
    got = table(spark, sf, "benchmark").select("item_id", "text")
    wanted = got.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return got.join(wanted, "item_id").select("item_id", tx.character_error(F.col("text"), F.col("next")).alias("cer"))


@query("""SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[\\\\/:*?"<>|]', '_', 'g'))[1:60], ''), 'Книга') AS name FROM pages""")
def w16_file_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.safe_file_name(F.col("url")).alias("name"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM pages""")
def w10_xml_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.xml_escape(F.col("html")).alias("xml"))


@query("SELECT page_id, nullif(rtrim(regexp_extract('see ' || url || '). ok', 'https?://\\S+', 0), '.,)]'), '') AS url FROM pages")
def s28_shared_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.shared_url(F.concat(F.lit("see "), "url", F.lit("). ok"))).alias("url"))


@query("SELECT event_id, CASE WHEN event_id % 100 BETWEEN 11 AND 14 THEN 'глав' WHEN event_id % 10 = 1 THEN 'глава' WHEN event_id % 10 BETWEEN 2 AND 4 THEN 'главы' ELSE 'глав' END AS form FROM events")
def g6_plural(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.plural(F.col("event_id"), "глава", "главы", "глав").alias("form"))


_TAIL = ", ".join(f"'{x}'" for x in web.THREE_LABELS)


@query(f"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages), l AS (SELECT page_id, host, list_filter(string_split(host, '.'), lambda x: x <> '') AS p FROM h)
    SELECT page_id, host, CASE WHEN len(p) < 2 THEN NULL WHEN len(p) = 2 THEN array_to_string(p, '.') WHEN array_to_string(p[-2:], '.') IN ({_TAIL}) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS site FROM l""")
def r3_site_of(spark, sf):
    host = web.host_of(F.col("url"))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), web.site_of(host).alias("site"))


@query("""WITH p AS (SELECT page_id, trim(url) AS u FROM pages), q AS (SELECT page_id, u, lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS h,
    regexp_extract(u, '^[a-zA-Z]+://[^/?#:]+:(\\d+)', 1) AS port, regexp_extract(u, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1) AS path, regexp_extract(u, '(\\?[^#]*)', 1) AS query FROM p)
    SELECT page_id, s || '://' || h || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END || CASE WHEN path = '' THEN '/' ELSE path END || query AS url FROM q""")
def r1_canonical_url_ascii(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.canonical(F.col("url")).alias("url"))


@query("SELECT page_id, nullif(regexp_extract(url, '^(https?://[^/?#]+)', 1), '') AS origin FROM pages")
def r6_origin(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.origin(F.col("url")).alias("origin"))


_NUMBERED = "CASE page_id % 4 WHEN 0 THEN '?page=' || page_id WHEN 1 THEN '?page=' || page_id || '&chapter=5#top' WHEN 2 THEN '?q=a&glava=9&p=' || page_id ELSE '' END"


@query(f"""WITH u AS (SELECT page_id, 'https://site.example/book/chapter-' || page_id AS base, {_NUMBERED} AS q FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN base || '?page=' || (page_id + 1) WHEN 1 THEN base || '?page=' || (page_id + 1) || '&chapter=5' WHEN 2 THEN base || '?q=a&glava=10&p=' || page_id
    ELSE 'https://site.example/book/chapter-' || (page_id + 1) END AS next FROM u""")
def r5_numeric_next(spark, sf):
    url = F.concat(F.lit("https://site.example/book/chapter-"), F.col("page_id"), F.expr(_NUMBERED))
    return table(spark, sf, "pages").select("page_id", web.numeric_next(url).alias("next"))


def _has(text: str, words: list[str]) -> str:
    return " OR ".join(f"contains({text}, '{w}')" for w in words)


@query(f"SELECT doc_id, length(text) <= 1000 AND ({_has('lower(text)', web.ANTIBOT)}) AS antibot, length(text) <= 1500 AND ({_has('lower(text)', web.PAYWALL)}) AS paywall FROM documents")
def f4_f6_guards(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", web.is_antibot(F.lit(""), text).alias("antibot"), web.is_paywall(text).alias("paywall"))


@query("SELECT page_id, regexp_matches('/' || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '(?i)/(?:login|signin|sign-in|log-in|enter|vhod|auth|register|registration)(?:/|\\?.*)?$') AS login FROM pages")
def f5_login_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.is_login(F.col("url")).alias("login"))


@query("""SELECT o_orderkey, CAST(greatest(0, least(1, (CAST(o_orderkey % 7 AS FLOAT) + CAST(o_orderkey % 10 AS FLOAT) / CAST(10 AS FLOAT)) / 6)) AS FLOAT) >= 0.995 AS done,
    o_orderkey % 7 + o_orderkey % 10 = 0 AS untouched FROM orders""")
def f2_progress(spark, sf):
    chapter, within = F.col("o_orderkey") % 7, (F.col("o_orderkey") % 10).cast("float") / F.lit(10).cast("float")
    progress = library.overall_progress(chapter, within, F.lit(6))
    return table(spark, sf, "orders").select("o_orderkey", (library.status(progress) == "done").alias("done"), (library.status(progress) == "new").alias("untouched"))


@query("""SELECT doc_id FROM documents WHERE (contains(lower(source), 'src1') OR contains(lower(lang), 'src1') OR contains(lower(text), 'src1')) AND (doc_id % 1000) / 1000.0 > 0 AND (doc_id % 1000) / 1000.0 < 0.995""")
def f1_library_filter(spark, sf):
    progress = (F.col("doc_id") % 1000) / F.lit(1000.0)
    return table(spark, sf, "documents").where(library.matches(" SRC1 ", "reading", F.col("text"), F.col("source"), F.col("lang"), progress)).select("doc_id")


@query("""SELECT page_id, upper(hex(encode(h))[1:8]) = '504B0304' AS zip, upper(hex(encode(h))[1:8]) = '504B0304' OR contains(lower(substr(h, 1, 500)), '<fictionbook') AS fb2, sha256(h) AS digest, sha1(h) AS short FROM
    (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'PK' || chr(3) || chr(4) || html WHEN 1 THEN '<?xml?><FictionBook>' || html ELSE html END AS h FROM pages)""")
def v5_v6_magic(spark, sf):
    k = F.col("page_id") % 3
    html = F.when(k == 0, F.concat(F.lit("PK\x03\x04"), "html")).when(k == 1, F.concat(F.lit("<?xml?><FictionBook>"), "html")).otherwise(F.col("html"))
    content = F.encode(html, "UTF-8")
    return table(spark, sf, "pages").select("page_id", shelf.is_zip(content).alias("zip"), shelf.looks_like_fb2(content).alias("fb2"), F.sha2(content, 256).alias("digest"), F.sha1(content).alias("short"))


_CODES = ["supertonic:12", "kokoro:-3", "kokoroRu:2", "vosk:99", "system:com.x:voice:1", "system: :v", "vosk:x", "bad", " ", "system:a"]


@query(f"""WITH c AS (SELECT p_partkey, {_CODES}[(p_partkey % 10)::INT + 1] AS c FROM part) SELECT p_partkey, CASE c WHEN 'supertonic:12' THEN 'supertonic:9' WHEN 'kokoro:-3' THEN 'kokoro:0' WHEN 'vosk:99' THEN 'vosk:56' WHEN 'kokoroRu:2' THEN c WHEN 'system:com.x:voice:1' THEN c END AS code FROM c""")
def v3_voice_decode(spark, sf):
    code = F.array(*map(F.lit, _CODES))[(F.col("p_partkey") % 10).cast("int")]
    return table(spark, sf, "part").select("p_partkey", voices.encoded_choice(voices.decoded_choice(code)).alias("code"))


@query("""WITH p AS (SELECT page_id, page_id % 5 AS k, 'https://s.example/book/' || page_id AS u FROM pages)
    SELECT page_id, CASE k WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS pager FROM p""")
def f8_page_turn(spark, sf):
    k, base = F.col("page_id") % 5, F.concat(F.lit("https://s.example/book/"), F.col("page_id"))
    source = F.when(k == 1, F.concat(base, F.lit("/page/1"))).otherwise(base)
    target = F.when(k == 0, F.concat(base, F.lit("/page/2"))).when(k == 1, F.concat(base, F.lit("/page/2"))).when(k == 2, F.concat(base, F.lit("/chapter/2"))).otherwise(F.concat(base, F.lit("?page=2")))
    return table(spark, sf, "pages").select("page_id", web.is_page_turn(source, target, k == 4).alias("pager"))


@query("""SELECT page_id, page_id % 4 IN (0, 3) AS allowed FROM pages""")
def f9_redirects(spark, sf):
    k = F.col("page_id") % 4
    source = F.lit("https://www.litmir.me/br/?b=7&p=1")
    target = F.when(k == 0, "https://litmir.club/br/?b=7").when(k == 1, "https://litmir.club/br/?b=8").when(k == 2, "http://litmir.club/br/?b=7").otherwise("https://m.litmir.net/other")
    return table(spark, sf, "pages").select("page_id", web.allows_redirect(source, target).alias("allowed"))


@query("""SELECT event_id, CASE WHEN s < 400 THEN NULL WHEN s IN (401, 403, 404) THEN 'HTTP_' || s ELSE 'NETWORK' END AS reason, s >= 500 OR s = 403 AS retry FROM (SELECT event_id, 200 + (event_id % 40) * 10 + event_id % 5 AS s FROM events)""")
def r10_status_reasons(spark, sf):
    status = 200 + (F.col("event_id") % 40) * 10 + F.col("event_id") % 5
    return table(spark, sf, "events").select("event_id", web.reason_of(status).alias("reason"), web.retryable(status).alias("retry"))
