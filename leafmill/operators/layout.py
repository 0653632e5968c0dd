"""Page geometry as column functions, band joins and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Length that two spans share; negative for a gap."""
    return F.least(a_high, b_high) - F.greatest(a_low, b_low)


def share_inside(a: str, b: str) -> Column:
    """Share of rectangle a (struct of left, top, right, bottom) inside b."""
    c = lambda r, k: F.col(f"{r}.{k}")
    w = overlap(c(a, "left"), c(a, "right"), c(b, "left"), c(b, "right"))
    h = overlap(c(a, "top"), c(a, "bottom"), c(b, "top"), c(b, "bottom"))
    area = F.greatest(F.lit(0.0), c(a, "right") - c(a, "left")) * F.greatest(F.lit(0.0), c(a, "bottom") - c(a, "top"))
    return F.when((w > 0) & (h > 0), w * h / F.greatest(area, F.lit(0.01))).otherwise(0.0)


def contained(lines: DataFrame, figures: DataFrame, least: float, band: float = 64.0) -> DataFrame:
    """(page, line, figure): the first figure of the page that holds at least that share of a line.

    Both sides are dealt to bands of the page's height, so the join has equal keys and looks at neighbours only.
    """
    bands = lambda r: F.explode(F.sequence(F.floor(F.col(f"{r}.top") / band), F.floor(F.col(f"{r}.bottom") / band)))
    a = lines.select("page", "line", "box", bands("box").alias("band"))
    b = figures.select("page", "figure", F.col("box").alias("frame"), bands("box").alias("band"))
    hits = a.join(b, ["page", "band"]).where(share_inside("box", "frame") >= least)
    return hits.groupBy("page", "line").agg(F.min("figure").alias("figure"))


def columns(lines: DataFrame) -> DataFrame:
    """(parity, left, right) of the main text column of left and right pages.

    left is the most frequent start in steps of two points, the least on ties; right is the element at nine tenths of
    the ends of lines that start within four points of it.
    """
    rows = lines.select((F.col("page") % 2).alias("parity"), "left", "right")
    starts = rows.groupBy("parity", F.floor(F.col("left") / 2).alias("step")).agg(F.count("*").alias("n"))
    left = starts.groupBy("parity").agg(F.max_by(F.col("step") * 2, F.struct("n", -F.col("step"))).alias("column"))
    near = rows.join(F.broadcast(left), "parity").where(F.abs(F.col("left") - F.col("column")) <= 4)
    # which point of the page holds the element, by counts of points; then which of the values in that point
    points = near.groupBy("parity", "column", F.floor("right").alias("point")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("parity", "column").orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("parity", "column")))
    points = points.withColumn("nth", F.least(F.floor(F.col("all") * 0.9) + 1, "all")).where("upto >= nth and upto - n < nth")
    inside = near.withColumn("point", F.floor("right")).join(F.broadcast(points.select("parity", "column", "point", (F.col("nth") - (F.col("upto") - F.col("n"))).alias("nth"))), ["parity", "column", "point"])
    values = inside.groupBy("parity", "column", "right", "nth").agg(F.count("*").alias("n"))
    values = values.withColumn("upto", F.sum("n").over(Window.partitionBy("parity", "column").orderBy("right").rowsBetween(Window.unboundedPreceding, 0)))
    return values.where("upto >= nth").groupBy("parity", F.col("column").alias("left")).agg(F.min("right").alias("right"))


# What is trimmed off a word of a line, and what closes a sentence before the next one.
EDGES, QUOTES, CLOSES = ",.;:!?()\"“”«»’'", "\"”»)’", "[.!?:]$"


def inner_words(lines: DataFrame) -> DataFrame:
    """The words of lines that tell how a word is written: not a line's first or last, none that opens a sentence."""
    words = lines.select(F.split("text", " ").alias("w"))
    places = words.select("w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i")).where("size(w) > 2 and i < size(w) - 1")
    rows = places.select(F.trim(F.col("w")[F.col("i")], F.lit(EDGES)).alias("word"), F.rtrim(F.col("w")[F.col("i") - 1], F.lit(QUOTES)).alias("before"))
    return rows.where((F.length("word") >= 2) & F.col("word").rlike("^\\p{L}+$") & ~F.col("before").rlike(CLOSES)).select("word")


def spellings(words: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(key, form): words used often enough that are nearly always written one way, and not in lower case."""
    forms = words.groupBy(F.lower("word").alias("key"), "word").agg(F.count("*").alias("n"))
    by_key = forms.groupBy("key").agg(F.sum("n").alias("uses"), F.max(F.struct("n", "word")).alias("top"))
    return by_key.where((F.col("uses") >= least) & (F.col("top.n") >= share * F.col("uses")) & (F.col("top.word") != F.col("key"))).select("key", F.col("top.word").alias("form"))


def contents_or_heading(marks: DataFrame) -> DataFrame:
    """Of a title's places, the one with most text until the next place; the first on ties."""
    w = Window.partitionBy("doc").orderBy("at")
    weighed = marks.withColumn("weight", F.coalesce(F.lead("at").over(w), F.col("end")) - F.col("at"))
    return weighed.groupBy("doc", "key").agg(F.max_by("at", F.struct("weight", -F.col("at"))).alias("at"))
