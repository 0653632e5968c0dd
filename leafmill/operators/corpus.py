"""Statistics of a corpus as aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, word, gap): words of letters with inner hyphens and apostrophes, and whether one opens a sentence."""
    found = F.regexp_extract_all("text", F.lit("(^|[.!?…]\\s+|\\n)?([\\p{L}]+(?:[-'’][\\p{L}]+)*)"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("raw")).select(
        "doc_id",
        F.regexp_extract("raw", "[\\p{L}]+(?:[-'’][\\p{L}]+)*$", 0).alias("word"),
        F.col("raw").rlike("^([.!?…]|\\n)").alias("opens"),
    )


def case_histogram(words: DataFrame) -> DataFrame:
    """A1: (key, lower, capital, opening): how often a word is in lower case, capital inside a sentence, opening one."""
    capital = F.col("word").rlike("^\\p{Lu}")
    key = F.translate(F.lower("word"), "ё", "е").alias("key")
    return words.groupBy(key).agg(
        F.count_if(~capital).alias("lower"),
        F.count_if(capital & ~F.col("opens")).alias("capital"),
        F.count_if(F.col("opens")).alias("opening"),
    )


def name_words(histogram: DataFrame) -> DataFrame:
    """A2: words that are capital inside sentences at least twice as often as in lower case."""
    return histogram.where("capital > 0 and lower * 2 <= capital")


def common_words(histogram: DataFrame) -> DataFrame:
    """A3: words that open sentences and are no names."""
    return histogram.where("opening > 0 and lower > 0 and lower >= capital and not (capital > 0 and lower * 2 <= capital)")


def best(rows: DataFrame, key: str, value: str, score: str, order: str) -> DataFrame:
    """The value with the largest score of each key, the first on ties; scores of 0 or less do not count."""
    first = F.max_by(value, F.struct(F.col(score), -F.col(order)))
    return rows.where(F.col(score) > 0).groupBy(key).agg(first.alias(value), F.max(score).alias(score))


# Margins of a page, what a running head is made of, words of a page number.
MARGIN, LARGE, HEAD_PAGES, SLOT_LINES = 0.1, 1.6, 3, 5
NUMBER_WORD = "[0-9]|(^|[^\\p{L}\\p{N}_])[ivxlcdm]{1,7}([^\\p{L}\\p{N}_]|$)"
PAGE_WORDS = ["page", "p.", "стр.", "стр", "страница", "с."]
HIDDEN_CHARS, HIDDEN_SHARE = 4, 0.3


def running_heads(lines: DataFrame, body: float) -> DataFrame:
    """A10: (page, ord) of the lines that are running heads, feet or page numbers.

    lines has page, ord, text, top, bottom, height, baseline, font and size. A head is a line of one margin whose words,
    those with numbers left out, stand there on three pages; a line without a text besides numbers is a page number; and a
    line goes too where five heads have its place and font.
    """
    band = F.when(F.col("bottom") <= F.col("height") * MARGIN, "top").when(F.col("top") >= F.col("height") * (1 - MARGIN), "bottom")
    words = F.filter(F.split(F.lower("text"), "\\s+"), lambda w: (w != "") & ~w.rlike(NUMBER_WORD))
    slot = F.struct((F.col("page") % 2).alias("side"), F.floor(F.col("baseline") / 3).alias("at"), "font", F.floor(F.col("size") * 2).alias("size"))
    rows = lines.withColumn("band", band).where("band is not null").select("page", "ord", "band", F.array_join(words, " ").alias("key"), slot.alias("slot"), (F.col("size") <= body * LARGE).alias("small"))
    pages = rows.groupBy("band", "key").agg(F.count_distinct("page").alias("pages"))
    rows = rows.join(pages, ["band", "key"]).withColumn("repeated", (F.col("key") != "") & (F.col("pages") >= HEAD_PAGES))
    number = F.col("key").rlike("^[#\\s\\-–—.|/]*$") | F.col("key").isin(PAGE_WORDS)
    rows = rows.withColumn("head", (F.col("repeated") & F.col("small")) | number)
    slots = rows.where("head and repeated").groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= SLOT_LINES)
    return rows.join(slots.withColumnRenamed("slot", "found"), F.col("slot") == F.col("found"), "left").where("head or (found is not null and small)").select("page", "ord")


def watermarks(hidden: DataFrame, pages: int) -> DataFrame:
    """A10: texts drawn beside the pages, on three pages or more and on 30 % of all."""
    texts = hidden.where(F.length("text") >= HIDDEN_CHARS).groupBy("text").agg(F.count("*").alias("n"))
    return texts.where((F.col("n") >= HEAD_PAGES) & (F.col("n") >= pages * HIDDEN_SHARE))


def dominant_language(paragraphs: DataFrame, key: str, order: str, fallback: str = "ru", enough: int = 6000) -> DataFrame:
    """(key, language) by the letters of the first paragraphs, up to the one that makes over `enough` characters."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cyrillic, latin = (F.regexp_count("text", F.lit(p)) for p in ("[\\u0400-\\u04FF]", "[A-Za-z]"))
    first = paragraphs.withColumn("_before", before).where(F.col("_before") <= enough)
    sums = first.groupBy(key).agg(F.sum(cyrillic).alias("c"), F.sum(latin).alias("l"))
    return sums.select(key, F.when((F.col("c") == 0) & (F.col("l") == 0), fallback).when(F.col("c") >= F.col("l"), "ru").otherwise("en").alias("language"))


def roles_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(from_role, to_role, n) of the rows whose role changed; missing afterwards is ''."""
    joined = before.join(after.withColumnRenamed("role", "to_role"), keys, "left")
    changed = joined.select(F.coalesce("role", F.lit("-")).alias("from_role"), F.coalesce("to_role", F.lit("")).alias("to_role"))
    return changed.where("from_role != to_role").groupBy("from_role", "to_role").agg(F.count("*").alias("n"))


def without_ambiguous(words: DataFrame) -> DataFrame:
    """Words whose ё-less key stands for one word only."""
    keyed = words.withColumn("key", F.translate("word", "ё", "е"))
    ambiguous = keyed.groupBy("key").agg(F.countDistinct("word").alias("n")).where("n > 1")
    return keyed.join(ambiguous, "key", "left_anti")


def as_of(items: DataFrame, starts: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each item with the value of the last start at or before it.

    Both sides in one ordered window: one shuffle by `by` and no join of ranges.
    """
    a = items.select(by, at, F.col("item"), F.lit(1).alias("_side"), F.lit(None).cast(dict(starts.dtypes)[value]).alias("_v"))
    b = starts.select(by, at, F.lit(None).cast(dict(items.dtypes)["item"]).alias("item"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    upto = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(upto)).where("_side = 1").select(by, at, "item", value)


def islands(rows: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Runs of neighbouring rows with equal flag: (key, island, flag, first, last, n)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_new", F.coalesce((F.lag(flag).over(w) != F.col(flag)).cast("int"), F.lit(0)))
    numbered = marked.withColumn("island", F.sum("_new").over(w))
    return numbered.groupBy(key, "island", flag).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def next_chain(links: DataFrame, hops: int = 3) -> DataFrame:
    """(start, hop, url) along next links, `hops` at most, a page met before ends the chain."""
    path = links.select(F.col("url").alias("start"), F.lit(0).alias("hop"), "url", F.array("url").alias("seen"))
    every = path
    step = links.select(F.col("url").alias("from"), "next_url")
    for k in range(1, hops + 1):
        path = path.join(step, F.col("url") == F.col("from")).where(F.col("next_url").isNotNull() & ~F.array_contains("seen", F.col("next_url")))
        path = path.select("start", F.lit(k).alias("hop"), F.col("next_url").alias("url"), F.array_append("seen", F.col("next_url")).alias("seen"))
        every = every.unionByName(path)
    return every.select("start", "hop", "url")


def same_words(a, b) -> F.Column:
    """Word sets equal, or one in the other; an empty one fits all."""
    x, y = (F.array_distinct(F.col(x) if isinstance(x, str) else x) for x in (a, b))
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def confusion(rows: DataFrame, wanted: str, got: str) -> DataFrame:
    """Right, unknown, wrong and missed of a labelling, and all rows."""
    w, g = F.col(wanted), F.col(got)
    return rows.agg(
        F.count_if(w == g).alias("n_right"),
        F.count_if(g.isNull()).alias("n_unknown"),
        F.count_if(w != g).alias("n_wrong"),
        F.count("*").alias("n_rows"),
    )


def weighted_mode(rows: DataFrame, key: str, size: str, weight: str) -> DataFrame:
    """The size, cut down to quarters, with the largest weight of each key; the smallest on ties."""
    quarter = (F.floor(F.col(size) * 4) / 4).alias("q")
    sums = rows.groupBy(key, quarter).agg(F.sum(weight).alias("w"))
    return sums.groupBy(key).agg(F.max_by("q", F.struct("w", -F.col("q"))).alias("mode"), F.max("w").alias("w"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The element at n div 2 of the sorted values; ranks in a window, so no group is gathered into a row."""
    w = Window.partitionBy(key).orderBy(value)
    ranked = rows.select(key, value, F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    return ranked.where("r = floor(n / 2) + 1").select(key, F.col(value).alias("median"))


def vote(female, male) -> F.Column:
    """A5: a gender with three times the other's votes, else null."""
    return F.when((female > 0) & (female >= 3 * male), "F").when((male > 0) & (male >= 3 * female), "M")


def without_plain_spelling(words: DataFrame) -> DataFrame:
    """Words written with a plain letter go where the accented spelling is there too."""
    accented = words.where(F.contains("word", F.lit("ё"))).select(F.translate("word", "ё", "е").alias("word")).distinct()
    return words.join(accented, "word", "left_anti")


def containing(items: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, item, span): the span that holds a place, else the one with the nearest start, the first on ties.

    An as-of window finds the last start at or before a place and the next one after it; no ranges are joined.
    """
    a = items.select(key, F.col("at"), "item", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("end"))
    b = spans.select(key, F.col("start").alias("at"), F.lit(None).cast(dict(items.dtypes)["item"]).alias("item"), F.lit(0).alias("_side"), F.col("end").cast("long").alias("end"))
    w = Window.partitionBy(key).orderBy("at", "_side")
    mark = F.when(F.col("_side") == 0, F.struct("at", "end"))
    both = a.unionByName(b).select("*", F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("low"), F.first(mark, True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("high"))
    holds = F.col("at") < F.col("low.end")
    nearer = F.col("high.at") - F.col("at") < F.col("at") - F.col("low.at")
    span = F.when(holds, F.col("low.at")).when(F.col("low").isNull() | nearer, F.col("high.at")).otherwise(F.col("low.at"))
    return both.where("_side = 1").select(key, "item", span.alias("span"))


def by_rule(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Hosts with the first rule whose name is the host or an ending of it; each ending is an equal key."""
    labels = F.split("host", "\\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keyed = hosts.withColumn("name", F.explode(endings)).join(rules, "name")
    found = keyed.groupBy("host").agg(F.min_by("rule", "ord").alias("rule"))
    return hosts.join(found, "host", "left")


def redirected(requests: DataFrame, answers: DataFrame, allowed, hops: int = 5) -> DataFrame:
    """(url, at, status, seen) of requests that follow redirects, at most `hops` of them.

    answers has (url, status, location), one row an address; allowed(source, target) is asked before each hop. A hop to an
    address that was seen is a LOOP, one that is not allowed is BLOCKED, and one too many is TOO_MANY; else the status is
    that of the last answer, null where there is none. Each hop is one join of what still moves.
    """
    answers = answers.select(F.col("url").alias("at"), F.col("status").cast("string").alias("answer"), F.col("location").alias("to"))
    going = requests.select("url", F.col("url").alias("at"), F.array("url").alias("seen"))
    done = []
    for hop in range(hops + 1):
        met = going.join(answers, "at", "left").withColumn("to", F.when(F.col("answer").startswith("3"), F.col("to")))
        end = (
            F.when(F.col("to").isNull(), F.col("answer"))
            .when(F.array_contains("seen", F.col("to")), "LOOP")
            .when(~F.coalesce(allowed(F.col("at"), F.col("to")), F.lit(False)), "BLOCKED")
            .when(F.lit(hop == hops), "TOO_MANY")
            .otherwise("")
        )
        met = met.withColumn("status", end)
        done.append(met.where("status is null or status != ''").select("url", "at", "status", F.size("seen").alias("seen")))
        going = met.where("status = ''").select("url", F.col("to").alias("at"), F.array_append("seen", F.col("to")).alias("seen"))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def debounced(events: DataFrame, key: str, at: str, tie: str, quiet: int) -> DataFrame:
    """The events of each key after which nothing comes for so long; of equal times the last by tie."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return events.withColumn("_next", F.lead(at).over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col(at) >= quiet)).drop("_next")


def resolved(uses: DataFrame, things: DataFrame) -> DataFrame:
    """Uses (book, ord, id) with what is kept under the id, null where nothing is; of several the last by place holds."""
    last = things.groupBy("book", "id").agg(F.max_by("content", "place").alias("content"))
    return uses.join(last, ["book", "id"], "left").select("book", "ord", "id", "content")


def warnings(found: DataFrame, most: int = 2) -> DataFrame:
    """(book, warnings): what is said of a book's skipped pictures and guessed letters, at most so many."""
    counts = found.groupBy("book").agg(F.count_if(F.col("content").isNull()).alias("skipped"), F.count("*").alias("all"), F.max(F.col("guessed").cast("int")).alias("guessed"))
    said = F.array_compact(
        F.array(
            F.when(F.col("skipped") > 0, F.concat(F.lit("Пропущено рисунков: "), "skipped")),
            F.when(F.col("guessed") == 1, "Кодировка определена по буквам"),
            F.when(F.col("skipped") == F.col("all"), "Рисунков нет"),
        )
    )
    return counts.select("book", F.slice(said, 1, most).alias("warnings"))
