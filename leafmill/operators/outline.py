"""A book's tree of bookmarks as rows in reading order, and the chapters that begin at them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.checkpoints import kept

# How deep and how long an outline is read; pages of a chapter that is cut at the entries under it, and how
# often; points that an entry may lie above its text.
DEEPEST, MOST, LONG_PAGES, NESTED, ABOVE = 6, 5000, 50, 2, 2.0


def _number(column: str):
    """A whole number in figures that sort as text: fewer figures first, negative ones before all."""
    n = F.col(column).cast("long")
    least = F.lpad(n.bitwiseAND(F.lit(2**63 - 1)).cast("string"), 19, "0")
    return F.when(n < 0, F.concat(F.lit("!"), least)).otherwise(F.concat(F.char(F.length(n.cast("string")) + 64), n.cast("string")))


def whole_outline(tree: DataFrame) -> DataFrame:
    """outline_rows without its bounds: every entry under a root, however deep, and all of a book's entries.

    What leads to an entry from above is found by doubling: each round joins the way to an entry's `up` before its own, so
    rounds grow with the logarithm of the depth. A round that ends at no root leaves cycles and what is under them, and
    entries whose parent is missing. Books are numbered by ranges of their paths; no book is one task.
    """
    entries = tree.select("doc", "node", "title", "page", F.coalesce("top", F.lit(0.0)).alias("top"))
    ways = kept(tree.select("doc", "node", F.col("parent").alias("up"), F.concat(_number("ord"), _number("node")).alias("path"), F.lit(1).alias("level")))
    done, rest = ways.where("up is null"), ways.where("up is not null")
    while True:
        above = done.unionByName(rest).select("doc", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("level").alias("_level")).hint("merge")
        longer = kept(rest.join(above, ["doc", "up"]).select("doc", "node", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), (F.col("_level") + F.col("level")).alias("level")))
        if longer.where("up is null").isEmpty():
            break
        done, rest = done.unionByName(longer.where("up is null")), longer.where("up is not null")
    there = entries.where("page >= 0").hint("merge")
    rows = kept(done.select("doc", "node", "path", "level").join(there, ["doc", "node"]))
    ranges = kept(rows.repartitionByRange("doc", "path").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("doc").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("doc", "_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    rows = ranges.join(counts.drop("count"), ["doc", "_range"])
    seq = F.row_number().over(Window.partitionBy("doc", "_range").orderBy("path")) + F.col("_before")
    return rows.select("doc", seq.alias("seq"), "level", "node", "title", "page", "top")


def outline_rows(tree: DataFrame, deepest: int = DEEPEST, most: int = MOST) -> DataFrame:
    """(doc, seq, level, node, title, page, top) of tree (doc, node, parent, ord, title, page, top), in reading order.

    The bounds are the reader's; whole_outline has none. Entries under the root have no parent. A join for each of `deepest` levels goes down; an entry without a page is left
    out, those under it are not; a book has `most` rows at most. Equal ords go by node. A cycle has no root and gives no rows.
    """
    # a place among its siblings, in figures that sort as text
    step = F.concat(F.lpad(F.col("ord").cast("string"), 10, "0"), F.lit("."), F.lpad(F.col("node").cast("string"), 19, "0"), F.lit("/"))
    tree = tree.select("doc", "node", "parent", "title", "page", "top", step.alias("step"))
    nodes = tree.where("parent is not null")
    # entries above, dealt to what is under them; levels are tables of their own, which the next level and the result read
    upper = kept(tree.where("parent is null").withColumnRenamed("step", "path").drop("parent"))
    first = Window.partitionBy("doc").orderBy("path")
    best = lambda level, k: level.where("page >= 0").withColumn("level", F.lit(k)).withColumn("seq", F.row_number().over(first)).where(F.col("seq") <= most).drop("seq")
    found = best(upper, 1)
    for k in range(2, deepest + 1):
        above = upper.select("doc", F.col("node").alias("parent"), "path").hint("merge")
        upper = kept(nodes.join(above, ["doc", "parent"]).select("doc", "node", "title", "page", "top", F.concat("path", "step").alias("path")))
        found = found.unionByName(best(upper, k))
    rows = found.withColumn("seq", F.row_number().over(first)).where(F.col("seq") <= most)
    return kept(rows.select("doc", "seq", "level", "node", "title", "page", F.coalesce("top", F.lit(0.0)).alias("top")))


def chapter_starts(rows: DataFrame, last_pages: DataFrame) -> DataFrame:
    """(doc, seq, title, page, top): the entries of outline_rows that begin chapters; last_pages has (doc, last_page).

    Of the entries of a book those of the least level count, and of those under one that has over LONG_PAGES pages again
    those of the least level, NESTED times. Entries without a title, or past the last page, and books with one entry have none.
    """
    usable = rows.join(last_pages, "doc").where("page between 0 and last_page and trim(title) != ''")
    usable = usable.withColumn("_n", F.count("*").over(Window.partitionBy("doc"))).where("_n >= 2")
    group = usable.select("doc", "seq", "level", "title", "page", "top", F.lit(0).cast("long").alias("g"), (F.col("last_page") + 1).alias("past"))
    found = None
    for _ in range(NESTED + 1):
        part = Window.partitionBy("doc", "g")
        least = group.withColumn("least", F.min("level").over(part))
        chosen = F.col("level") == F.col("least")
        least = least.withColumn("owner", F.last(F.when(chosen, F.col("seq")), ignorenulls=True).over(part.orderBy("seq"))).where("owner is not null")
        tops = least.where(chosen)
        found = tops.select("doc", "seq", "title", "page", "top") if found is None else found.unionByName(tops.select("doc", "seq", "title", "page", "top"))
        ends = tops.select("doc", F.col("seq").alias("owner"), F.col("page").alias("from"), F.coalesce(F.lead("page").over(part.orderBy("seq")), F.col("past")).alias("to"))
        group = least.where(~chosen).drop("past").join(ends.where(F.col("to") - F.col("from") > LONG_PAGES), ["doc", "owner"])
        group = group.select("doc", "seq", "level", "title", "page", "top", F.col("owner").cast("long").alias("g"), F.col("to").alias("past"))
    return found


def chapters_of(items: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc, n, page, top, chapter): the seq of the start that each item (doc, n, page, top) comes after, null before the first.

    An item may lie ABOVE points over its start; of starts at one place the last counts.
    """
    place = lambda p, t: F.struct(F.col(p).cast("long").alias("page"), F.col(t).cast("double").alias("top"))
    a = items.select("doc", "n", "page", "top", place("page", "top").alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("_seq"))
    b = starts.withColumn("_t", F.col("top") - ABOVE)
    none = lambda t: F.lit(None).cast(t)
    b = b.select("doc", none(dict(items.dtypes)["n"]).alias("n"), none(dict(items.dtypes)["page"]).alias("page"), none(dict(items.dtypes)["top"]).alias("top"), place("page", "_t").alias("_at"), F.lit(0).alias("_asks"), F.col("seq").cast("long").alias("_seq"))
    w = Window.partitionBy("doc").orderBy("_at", "_asks", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("chapter", F.last("_seq", ignorenulls=True).over(w)).where("_asks = 1").select("doc", "n", "page", "top", "chapter")
