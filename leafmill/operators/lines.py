"""Runs of glyphs as lines, cut where a gutter between columns runs through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values, in widths of an em: how far baselines of one line are apart, gaps inside of a line and between columns, and
# the gap that becomes a space.
SAME_BASELINE, RUN_GAP, GUTTER_GAP, SPACE_GAP = 0.25, 1.0, 4.0, 0.15
#: Points of a cell of a page's projection, and the share of its bands that may cross a cell of a gutter.
CELL, CROSSED = 4.0, 0.05


def bands(runs: DataFrame) -> DataFrame:
    """runs (doc, page, run, text, left, right, baseline, size) with band: runs whose baselines follow each other closely."""
    w = Window.partitionBy("doc", "page").orderBy("baseline", "left", "run")
    step = F.col("baseline") - F.lag("baseline").over(w)
    new = F.coalesce((step > SAME_BASELINE * F.greatest("size", F.lag("size").over(w))).cast("int"), F.lit(0))
    return runs.withColumn("_new", new).withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def swept(rows: DataFrame) -> DataFrame:
    """rows of bands with at, their place in the band, reach, how far the runs left of each come, gap, the room up to it, and em, the larger of both sizes.

    The sweep goes from left to right; a run that another one covers is no end of it. Runs of one place and number go by
    their text, the greater first; later steps keep this order.
    """
    w = Window.partitionBy("doc", "page", "band").orderBy("left", "right", "run", F.desc("text"), "baseline", "size")
    rows = rows.withColumn("at", F.row_number().over(w)).withColumn("reach", F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("gap", F.col("left") - F.col("reach")).withColumn("em", F.greatest("size", F.lag("size").over(w)))


def projection(rows: DataFrame) -> DataFrame:
    """(doc, page, cell, crossed): for the cells of a page, by how many of its bands each is covered, and of how many.

    Small gaps in a band count as covered.
    """
    small = (F.col("gap") > 0) & (F.col("gap") <= RUN_GAP * F.col("em"))
    from_ = F.when(small, F.col("reach")).otherwise(F.col("left"))
    cells = F.explode(F.sequence(F.floor(from_ / CELL), F.floor(F.greatest(from_, "right") / CELL)))
    crossed = rows.select("doc", "page", "band", cells.alias("cell")).distinct().groupBy("doc", "page", "cell").agg(F.count("*").alias("crossed"))
    count = rows.groupBy("doc", "page").agg((F.max("band") + 1).alias("bands"))
    return crossed.join(count, ["doc", "page"])


def built(runs: DataFrame) -> DataFrame:
    """(doc, page, band, part, left, right, baseline, size, text): the lines of pages; a band with gutters is several.

    A gap ends a line if it is wider than any between words, or if it is wider than small and an empty stripe of the page
    runs through its middle, crossed by no more than CROSSED of its bands. Runs without text, or below one point, are left out.
    """
    rows = swept(bands(runs.where((F.col("size") >= 1) & (F.length(F.trim("text")) > 0))))
    middle = F.floor((F.col("reach") + F.col("left")) / 2 / CELL)
    stripes = projection(rows).where(F.col("crossed") > CROSSED * F.col("bands")).select("doc", "page", F.col("cell").alias("_cell"), F.lit(True).alias("_full"))
    wide = F.coalesce(F.col("gap") > RUN_GAP * F.col("em"), F.lit(False))
    rows = rows.withColumn("_cell", F.when(wide, middle)).join(stripes, ["doc", "page", "_cell"], "left")
    ends = wide & ((F.col("gap") > GUTTER_GAP * F.col("em")) | F.col("_full").isNull())
    w = Window.partitionBy("doc", "page", "band").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.sum(ends.cast("int")).over(w).cast("int"))
    spaced = F.when(~ends & (F.col("gap") > SPACE_GAP * F.col("em")), F.concat(F.lit(" "), F.trim("text"))).otherwise(F.trim("text"))
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_text"))), lambda x: x["_text"]), ""))
    return rows.withColumn("_text", spaced).groupBy("doc", "page", "band", "part").agg(
        F.min("left").alias("left"), F.max("right").alias("right"), F.max("baseline").alias("baseline"), F.max("size").alias("size"), text.alias("text"))
