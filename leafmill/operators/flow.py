"""Lines of pages as paragraphs that go on over columns and pages.

Whether a line goes on with the one before is a matter of these two, and of what their texts begin and end with, which is
marked once. Books are cut into ranges of pages; each range is made into parts of paragraphs by itself, and whether its
first part goes on with the ranges before is told by one row a range, without texts. So a book is no group, however many
pages it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.checkpoints import kept

# Marks that end a sentence, begin an item, break a word; in ems: a short line, an indent.
ENDS, ITEMS, HYPHENS = "[.!?:…][\"”»)’]*$", "^(?:[■●•▪◆◼►▸❑□○◦‣⁃∙·]|[–—] )", "[-­‐]"
SHORT, INDENT, STEP, SIZE = 2.5, 0.8, 1.3, 0.2
#: Pages of a range.
PAGES = 64
#: What the line after a line needs to know of it, and what a line needs to know of itself.
LAST = ["right", "baseline", "size", "block", "block_right", "edge", "heading", "half", "ended", "tied", "head", "soft", "address"]
OWN = ["indent", "baseline", "size", "block", "heading", "step", "lower", "item", "tail", "small"]


def shard(doc: Column, page: Column, pages: int = PAGES) -> Column:
    """The key that lines are dealt by: of a book and a range of its pages. Lines of no book are one book."""
    return F.concat(F.when(doc.isNull(), "-").otherwise("+"), F.coalesce(doc.cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.floor(page / pages).cast("string"), F.lit("")))


def marked(lines: DataFrame, pages: int) -> DataFrame:
    """lines (doc, page, n, text and what paragraphs() says) with shard, range, and the marks of LAST and OWN but step."""
    text = F.col("text")
    token = F.lower(F.substring_index(F.rtrim("text"), " ", -1))
    address = F.contains(token, F.lit("www.")) | F.contains(token, F.lit("://"))
    hyphen = text.rlike(f"{HYPHENS}$")
    return lines.select(
        "doc", "shard" if "shard" in lines.columns else shard(F.col("doc"), F.col("page"), pages).alias("shard"), F.floor(F.col("page") / pages).alias("range"), "page", "n", "text", "right", "baseline", "size", "block", "block_right", "heading",
        (F.col("left") - F.col("block_left")).alias("indent"),
        F.greatest("block_right", "column_right").alias("edge"),
        (F.col("right") < F.col("block_left") + (F.col("block_right") - F.col("block_left")) * 0.5).alias("half"),
        text.rlike("^[\\p{Ll},;)\\]»”]").alias("lower"),
        text.rlike("^[\\p{Ll}0-9]").alias("small"),
        text.rlike(ITEMS).alias("item"),
        F.rtrim("text").rlike(ENDS).alias("ended"),
        (text.rlike(",$") | hyphen).alias("tied"),
        F.when(hyphen, F.lower(F.regexp_extract("text", f"(\\p{{L}}+){HYPHENS}$", 1))).otherwise("").alias("head"),
        text.rlike("­$").alias("soft"),
        F.lower(F.regexp_extract("text", "^(\\p{Ll}\\p{L}*)", 1)).alias("tail"),
        # 2: what comes next goes on without a space, 1: if it begins with a small letter or a digit
        F.when(~address, 0).when(token.endswith("/"), 2).when(token.rlike("[._=?&-]$"), 1).otherwise(0).alias("address"),
    )


def goes_on(own: str = "", last: str = "last") -> Column:
    """Whether a line goes on with the paragraph of the one before it, by indent, step, short lines and marks.

    own is the prefix of the line's columns (OWN), last the struct (LAST) of the line before.
    """
    me, last = (lambda c: F.col(f"{own}{c}")), F.col(last)
    em = F.greatest(me("size"), last["size"])
    lower, ended = me("lower"), last["ended"]
    inside = me("block") == last["block"]
    short = last["right"] < F.when(inside, last["block_right"]).otherwise(last["edge"]) - em * SHORT
    never = me("heading") | last["heading"] | me("item") | (F.abs(me("size") - last["size"]) > em * SIZE)
    indented = (me("indent") > em * INDENT) & ~lower
    apart = (me("baseline") - last["baseline"] > me("step") * STEP) & (me("step") > 0) & ~lower
    within = ~indented & ~apart & ~(short & ended & ~lower) & ~(last["half"] & ~lower & ~last["tied"])
    beyond = F.when(lower & ~(ended & short), True).otherwise(~ended & ~short)
    return F.coalesce(last.isNotNull() & ~never & F.when(inside, within).otherwise(beyond), F.lit(False))


def with_steps(lines: DataFrame) -> DataFrame:
    """lines with step, the usual distance of baselines in each block: the middle one of them."""
    block = ["shard", "page", "block"]
    rows = lines.withColumn("_d", F.col("baseline") - F.lag("baseline").over(Window.partitionBy(block).orderBy("n")))
    middle = F.expr(f"percentile_disc(0.5) within group (order by _d) over (partition by {', '.join(block)})")
    whole = F.col("doc").isNotNull() & F.col("page").isNotNull() & F.col("block").isNotNull()
    return rows.withColumn("step", F.coalesce(F.when(whole, middle), F.lit(0.0))).drop("_d")


def joints(rows: DataFrame, words: DataFrame, own: str = "", last: str = "last") -> DataFrame:
    """rows with goes_on as goes_on() has it, with joint, what stands between a line and the one before, and drop, whether that one's hyphen goes.

    A word cut by a hyphen is joined, unless the book knows the compound and not the joined word, or only its two parts;
    an address cut at its own marks goes on without a space. words (word) are the book's, in lower case, each once.
    """
    tail, last = F.col(f"{own}tail"), F.col(last)
    rows = rows.withColumn("drop", F.coalesce((last["head"] != "") & (tail != "") & F.col("goes_on"), F.lit(False)))
    # lines without a cut word look for what is no word, each for another: if Spark deals them by it they don't meet
    none = F.concat(F.lit(" "), F.xxhash64("doc", "n").cast("string"))
    for name, word in (("_joined", F.concat(last["head"], tail)), ("_hyphened", F.concat(last["head"], F.lit("-"), tail)), ("_one", last["head"]), ("_two", tail)):
        rows = rows.withColumn("_key", F.when(F.col("drop"), word).otherwise(none))
        rows = rows.join(words.select(F.col("word").alias("_w"), F.lit(True).alias(name)), F.col("_key") == F.col("_w"), "left").drop("_w", "_key")
    known = lambda c: F.col(c).isNotNull()
    apart = F.when(known("_joined"), False).when(known("_hyphened"), True).otherwise((F.length(last["head"]) >= 2) & known("_one") & known("_two"))
    address = (last["address"] == 2) | ((last["address"] == 1) & F.col(f"{own}small"))
    joint = F.when(F.col("drop"), F.when(apart & ~last["soft"], "-").otherwise("")).when(address, "").otherwise(" ")
    return rows.withColumn("joint", joint).drop("_joined", "_hyphened", "_one", "_two")


def _text(order: str, piece: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: x[piece]), "")


def _bare(text: Column, drops: Column) -> Column:
    return F.when(drops, F.regexp_replace(text, f"{HYPHENS}$", "")).otherwise(text)


def paragraphs(lines: DataFrame, words: DataFrame, pages: int = PAGES) -> DataFrame:
    """(doc, n, page, heading, text): paragraphs and headings of books in order; n is that of their first line.

    lines have doc, page, n, text, left, right, baseline, size, block, block_left, block_right, column_right and heading;
    those without text are left out. n orders the lines of a book. The result doesn't depend on `pages`. Lines are dealt
    by book and range once, with their texts; if they have a column shard, made by shard(), and are dealt by it, not at all.
    """
    words = kept(words.select("word").where("word is not null").distinct())
    rows = with_steps(marked(lines.where("text != ''"), pages))
    inside = Window.partitionBy("shard").orderBy("n")
    rows = rows.withColumn("_me", F.struct(*LAST)).withColumn("last", F.lag("_me").over(inside)).withColumn("goes_on", goes_on())
    rows = joints(rows, words)
    # parts of paragraphs within ranges; the first line of a range begins one
    begins = ~F.col("goes_on") | F.col("last").isNull()
    rows = rows.withColumn("first", F.last(F.when(begins, F.col("n")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_drops", F.coalesce(F.lead("drop").over(inside), F.lit(False)))
    piece = F.concat(F.when(F.col("n") == F.col("first"), "").otherwise(F.col("joint")), _bare(F.col("text"), F.col("_drops")))
    parts = rows.withColumn("_piece", piece).groupBy("shard", "doc", "range", "first").agg(F.min("page").alias("page"), F.max("heading").alias("heading"), _text("n", "_piece").alias("text"))
    # one row a range, without texts: its first line, its last one, and where its last part begins
    edge = rows.groupBy("shard", "doc", "range").agg(F.min_by(F.struct("n", *OWN), "n").alias("_own"), F.max_by("_me", "n").alias("_me"), F.max("first").alias("_open"))
    over = Window.partitionBy("doc").orderBy("range")
    edge = joints(edge.withColumn("n", F.col("_own.n")).withColumn("last", F.lag("_me").over(over)).withColumn("goes_on", goes_on("_own.")), words, "_own.")
    open_ = F.when(F.col("_open") > F.col("n"), F.col("_open")).when(~F.col("goes_on"), F.col("n"))
    carried = F.last(open_, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.select("shard", F.col("n").alias("_n"), "_open", F.when(F.col("goes_on"), carried).alias("_carried"), "joint", F.coalesce(F.lead("drop").over(over), F.lit(False)).alias("_drops"))
    parts = parts.join(edge.hint("merge"), "shard")
    goes = (F.col("first") == F.col("_n")) & F.col("_carried").isNotNull()
    text = F.concat(F.when(goes, F.col("joint")).otherwise(""), _bare(F.col("text"), F.col("_drops") & (F.col("first") == F.col("_open"))))
    parts = parts.select("doc", "range", F.when(goes, F.col("_carried")).otherwise(F.col("first")).alias("n"), "page", "heading", text.alias("text"))
    return parts.groupBy("doc", "n").agg(F.min("page").alias("page"), F.max("heading").alias("heading"), _text("range", "text").alias("text"))
