"""A library of documents: progress, filters, latest-wins positions, idempotent appends and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import text as tx

# A document is finished from here on; search limits.
DONE, SEARCH_LIMIT, SEARCH_CHARS = 0.995, 300, 2


def overall_progress(chapter: Column, within: Column, chapters: Column) -> Column:
    """share of the document read, 32-bit arithmetic, 0 without chapters."""
    share = (chapter.cast("float") + within.cast("float")) / chapters
    return F.when(chapters > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0).cast("float")


def status(progress: Column) -> Column:
    """which shelf a progress belongs to."""
    return F.when(progress >= DONE, "done").when(progress > 0, "reading").otherwise("new")


def matches(query: str, shelf: str, title: Column, author: Column, kind: Column, progress: Column) -> Column:
    """the query in any of the columns, whatever the case, and the shelf; a shelf can also be a format."""
    needle = query.strip().lower()
    hit = F.lit(not needle)
    for c in (title, author, kind):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle))
    on = {"all": F.lit(True), "reading": (progress > 0) & (progress < DONE), "done": progress >= DONE}
    return hit & on.get(shelf, F.lower(kind) == shelf.lower())


def latest(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last value of each key, by `order`; one aggregation with map-side combining."""
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return log.groupBy(key).agg(newest).select(key, "v.*")


def new_chapters(stored: DataFrame, arriving: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Arriving rows whose key is not stored, the first of each key; a null key never matches."""
    known = arriving.where(" and ".join(f"{k} is not null" for k in keys))
    first = known.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in arriving.columns if c not in keys]), order).alias("v")).select(*keys, "v.*")
    loose = arriving.where(" or ".join(f"{k} is null" for k in keys)).select(*first.columns)
    return first.join(stored.select(*keys).distinct(), keys, "left_anti").unionByName(loose)


def search(paragraphs: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(book, paragraph, start, end) of the query's places, in order, `limit` at most.

    Splitting at the needle gives places that do not overlap, left to right; the limit is a top-k with no full sort.
    """
    needle = query.strip().lower().replace("ё", "е")
    if len(needle) < SEARCH_CHARS:
        return paragraphs.select("book", "paragraph", F.lit(0).alias("start"), F.lit(0).alias("end")).where("false")
    folded = tx.fold(F.col("text"))
    pieces = F.split(folded, f"\\Q{needle}\\E", -1)
    sizes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.length(x))
    hits = paragraphs.where(F.contains(folded, F.lit(needle))).select("book", "paragraph", F.posexplode(sizes).alias("k", "gap"))
    before = Window.partitionBy("book", "paragraph").orderBy("k")
    start = (F.sum("gap").over(before) + F.col("k") * len(needle)).cast("int")
    placed = hits.select("book", "paragraph", start.alias("start"))
    return placed.withColumn("end", F.col("start") + len(needle)).orderBy("book", "paragraph", "start").limit(limit)


def to_progress(paragraph: Column, offset: Column, length: Column, count: Column) -> Column:
    """V2: a place as chapter progress, 32-bit."""
    size = F.greatest(length, F.lit(1))
    index = F.greatest(F.lit(0), F.least(paragraph, count - 1))
    part = F.greatest(F.lit(0), F.least(offset, size)).cast("float") / size.cast("float")
    return F.when((count > 0) & (paragraph >= 0), ((index + part).cast("float") / count.cast("float"))).otherwise(0.0).cast("float")


def seconds(length: Column, speed: float, pause_ms: Column) -> Column:
    """How long a segment takes to read, with its pause."""
    return length / (14.0 * speed) + pause_ms / 1000.0


def seek(segments: DataFrame, key: str, order: str, target: float, speed: float = 1.0) -> DataFrame:
    """For each key the first segment with `target` seconds or more read at its end."""
    run = Window.partitionBy(key).orderBy(order)
    timed = segments.withColumn("at", F.sum(seconds(F.col("length"), speed, F.col("pause_ms"))).over(run))
    return timed.where(F.col("at") >= target).groupBy(key).agg(F.min(order).alias(order))
