"""Quality rules: base counts of a text, and how much of it is lines that many documents of its host share.

All of it is DataFrame functions. Lines are normalised (case, white space) and hashed. A line is common if more than MANY
distinct documents of its host have it, and more than SHARE of the host's distinct documents; common lines are removed,
and a document that keeps too little is rejected.

Distinct documents, for a line as for a host, are classes of near copies, each counted once: copies are one text, and a
text goes by the band of its sketch that most texts of its host share. The sketch is the least hashes of its three-word
windows; BANDS parts of it are bands. Of two near copies most bands are the same; a family has BANDS classes at most, and
those of its texts that share no band with another (3 % of a family at a likeness of 0.8, one in a thousand at 0.9, an
estimate). So that these do not make a family's own lines common, a line has to have more than STRAY of its texts as
distinct documents too. Documents with a fifth or more of words of their own have few bands without these.

Defined cases: a null or empty text has no words and fails the base rule; a null host is a host of its own; repeated
rows are judged alike; a text of less than three words is a class of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut

#: The pattern of white space that parts words.
WHITE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT = 50, 50
#: A line is common if more distinct documents of its host have it than MANY, and than this share of the host's.
MANY, SHARE = 10, 0.002
#: A document is depleted if common lines hold more than this share of its words.
DEPLETED = 0.7
#: Least hashes of a text's windows in its sketch, bands of these; fewer than MANY, so that a family is less than that.
SKETCH, BANDS = 64, 8
STRAY = 0.04
#: Bits of a place in a text; the other 34 of a window's key are of its hash.
PLACE = 30


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def _pairs(array: str, size: Column, test) -> Column:
    """test(x, y) of neighbours in an array column."""
    return F.zip_with(F.slice(array, 1, size - 1), F.slice(array, 2, size - 1), test)


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows, which have words w, with n_repeat_words and sketch.

    n_repeat_words: words in three-word windows that occur twice or more. Windows are sorted as numbers, a part of the
    hash before the place; those whose hash has a neighbour are compared by their words. The repeated places, in order,
    cover three words each, less what the next place covers again.
    """
    n = F.greatest(F.size("w") - 2, F.lit(0))
    windows = F.arrays_zip(*(F.slice("w", k, n).alias("abc"[k - 1]) for k in (1, 2, 3)))
    rows = rows.withColumn("z", F.sort_array(F.transform(windows, lambda x, i: F.shiftleft(F.xxhash64(x), PLACE).bitwiseOR(i.cast("long")))))
    part = lambda x: F.shiftright(x, PLACE)
    sketch = F.slice(F.array_distinct(F.transform(F.slice("z", 1, 2 * SKETCH), part)), 1, SKETCH)
    rows = rows.withColumn("sketch", sketch).withColumn("same", F.when(F.size("z") > 1, _pairs("z", F.size("z"), lambda x, y: part(x) == part(y))))
    never = F.array(F.lit(False))
    flags = F.zip_with(F.concat(never, "same"), F.concat("same", never), lambda x, y: x | y)
    kept = lambda place: F.filter(F.zip_with("z", flags, lambda x, f: F.when(f, place(x))), lambda x: x.isNotNull())
    repeated = F.array_contains("same", True)
    rows = rows.withColumn("z", F.when(repeated, kept(lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))))
    word = lambda k: F.get("w", k)
    rows = rows.withColumn("z", F.array_sort(F.transform("z", lambda i: F.struct(word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("i"))))).drop("w")
    rows = rows.withColumn("same", F.when(F.size("z") > 1, _pairs("z", F.size("z"), lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]))))
    rows = rows.withColumn("z", F.col("z.i")).withColumn("z", F.array_sort(kept(lambda i: i)))
    covered = F.aggregate(_pairs("z", F.size("z"), lambda x, y: F.least(F.lit(3), y - x)), F.lit(3), lambda total, x: total + x)
    return rows.withColumn("n_repeat_words", F.when(F.size("z") > 0, covered).otherwise(0).cast("long")).drop("z", "same")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.array_join(words(F.lower(line)), " "))


def without_lines(text: Column, common: Column) -> Column:
    """text without the lines whose hash is in common."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(common, line_hash(x))), "\n")


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines) of each row.

    lines has the hash and the words of each line that has a word, in order.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", text.alias("text"), words(text).alias("w"))
    with_word = F.filter(F.split("text", "\n", -1), lambda x: F.rtrim(x, F.lit(" \t\r\u000b\u000c")) != "")
    rows = rows.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("text_hash"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        with_word.alias("lines"),
        "w",
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    rows = rows.withColumn("lines", F.transform("lines", lambda x: F.struct(line_hash(x).alias("h"), F.size(words(x)).alias("n"))))
    return with_repeats(rows)


def classes(texts: DataFrame) -> DataFrame:
    """(source, text_hash, class) of distinct texts: the band that most texts of the host share, or the text itself."""
    band = lambda b: F.filter("sketch", lambda v: F.pmod(v, F.lit(BANDS)) == b)
    bands = F.array(*map(band, range(BANDS)))
    each = texts.select("source", "text_hash", F.explode(bands).alias("band")).where(F.size("band") > 0)
    each = cut(each.withColumn("band", F.xxhash64("band")), "bands")
    shared = each.groupBy(F.col("source").alias("host"), F.col("band").alias("liked")).agg(F.count("*").alias("n")).where("n > 1")
    found = each.join(shared, (F.col("band") == F.col("liked")) & F.col("source").eqNullSafe(F.col("host"))).select("source", "text_hash", "band", "n")
    return found.groupBy("source", "text_hash").agg(F.max(F.struct("n", "band"))["band"].alias("class"))


def common_lines(rows: DataFrame, many: int = MANY, share: float = SHARE) -> DataFrame:
    """(source, h) of the lines above the limits."""
    texts = cut(rows.select("source", "text_hash", "sketch", F.array_distinct("lines.h").alias("lines")).dropDuplicates(["source", "text_hash"]), "distinct-texts")
    by = classes(texts).select(F.col("source").alias("host"), F.col("text_hash").alias("same"), "class")
    known = texts.join(by, (F.col("text_hash") == F.col("same")) & F.col("source").eqNullSafe(F.col("host")), "left")
    known = cut(known.select("source", "lines", F.coalesce("class", "text_hash").alias("class")), "text-classes")
    each = known.select("source", "class", F.explode("lines").alias("h")).groupBy("source", "h", "class").agg(F.count("*").alias("texts"))
    lines = each.groupBy("source", "h").agg(F.count("*").alias("n"), F.sum("texts").alias("texts")).where((F.col("n") > many) & (F.col("n") > STRAY * F.col("texts")))
    hosts = known.select("source", "class").distinct().groupBy(F.col("source").alias("host")).agg(F.count("*").alias("all"))
    return lines.join(hosts, F.col("source").eqNullSafe(F.col("host"))).where(F.col("n") > F.col("all") * share).select("source", "h")


def judge(docs: DataFrame, many: int = MANY, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, removed_words, text_hash, common) of each row.

    common has the hashes of the row's common lines, null without any.
    """
    rows = cut(counted(docs).withColumn("row", F.monotonically_increasing_id()), "counted")
    common = common_lines(rows, many, share)
    places = rows.select("row", "source", F.explode("lines").alias("x")).select("row", "source", "x.*")
    hits = places.join(common, (places["h"] == common["h"]) & places["source"].eqNullSafe(common["source"]), "left_semi")
    gone = hits.groupBy("row").agg(F.sum("n").alias("gone"), F.collect_set("h").alias("common"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    removed = F.coalesce("gone", F.lit(0))
    return rows.join(gone, "row", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (removed <= depleted * F.col("n_words"))).alias("kept"),
        removed.alias("removed_words"),
        "text_hash",
        "common",
    )
