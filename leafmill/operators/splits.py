"""Sequences cut where a running size passes a limit and starts anew: chapters by length, pages by height.

Where a part ends depends on where it begins, so a plain running sum can't tell. But each item, if a part began with it,
has one next beginning: a search in the prefix sums. The beginnings that count are those that lead on from the first
item; they are found by doubling the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.checkpoints import settled


def prefix_sums(rows: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """rows with i, the place of each in its sequence from 0, and before, the sizes of those before it."""
    w = Window.partitionBy(key).orderBy(order)
    sums = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("before", F.coalesce(F.sum(F.coalesce(F.col(size), F.lit(0))).over(sums), F.lit(0)))


def first_at_least(rows: DataFrame, key: str, target: Column, counts: Column, name: str) -> DataFrame:
    """rows with the least later place among those that count whose `before` is at least the target, as `name`; null without one.

    Places and questions stand in one descending order of values, where each question takes the last place before it.
    """
    asks = rows.select(key, F.col("i").alias("_i"), target.alias("_v"), F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("_j"))
    there = rows.where(counts).select(key, F.col("i").alias("_i"), F.col("before").alias("_v"), F.lit(0).alias("_asks"), F.col("i").alias("_j"))
    w = Window.partitionBy(key).orderBy(F.desc("_v"), "_asks", F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    found = asks.unionByName(there).withColumn(name, F.last("_j", ignorenulls=True).over(w)).where("_asks = 1").select(F.col(key).alias("_k"), "_i", name)
    return rows.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.col("i") == F.col("_i"))).drop("_k", "_i")


def last_at_most(rows: DataFrame, key: str, target: Column, counts: Column, name: str) -> DataFrame:
    """rows with the greatest place among those that count whose `before` is at most the target, as `name`; null without one."""
    asks = rows.select(key, F.col("i").alias("_i"), target.alias("_v"), F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("_j"))
    there = rows.where(counts).select(key, F.col("i").alias("_i"), F.col("before").alias("_v"), F.lit(0).alias("_asks"), F.col("i").alias("_j"))
    w = Window.partitionBy(key).orderBy("_v", "_asks", "_i").rowsBetween(Window.unboundedPreceding, 0)
    found = asks.unionByName(there).withColumn(name, F.last("_j", ignorenulls=True).over(w)).where("_asks = 1").select(F.col(key).alias("_k"), "_i", name)
    return rows.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.col("i") == F.col("_i"))).drop("_k", "_i")


def led_to(steps: DataFrame, key: str, rounds: list[int] | None = None) -> DataFrame:
    """(key, i): the places that lead on from place 0 by steps (key, i, next); next is greater than i, or null.

    Each round the steps are twice as long, and all places known lead on by one of them. `rounds` takes how many each knew.
    """
    jump = settled(steps.where("next is not null").select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.col(key).isNull().alias("_null"), "i", "next"))
    same = ["_k", "_null"]
    marks = settled(steps.where("i = 0").select(F.col(key), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.col(key).isNull().alias("_null"), "i"))
    known = marks.count()
    while True:
        if rounds is not None:
            rounds.append(known)
        on = marks.join(jump, [*same, "i"]).select(key, *same, F.col("next").alias("i"))
        marks = settled(marks.unionByName(on).distinct())
        now = marks.count()
        if now == known:
            return marks.select(key, "i")
        known = now
        jump = settled(jump.alias("a").join(jump.select(*same, F.col("i").alias("next"), F.col("next").alias("further")), [*same, "next"]).select(*same, "i", F.col("further").alias("next")))


def _numbered(rows: DataFrame, begins: DataFrame, key: str) -> DataFrame:
    """rows with part, the number of the part that each is in, from 0."""
    marks = begins.select(F.col(key).alias("_k"), F.col("i").alias("_i"), F.lit(1).alias("_begins"))
    met = rows.join(marks, F.col(key).eqNullSafe(F.col("_k")) & (F.col("i") == F.col("_i")), "left").drop("_k", "_i")
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("part", (F.count("_begins").over(w) - 1).cast("int")).drop("_begins")


def by_size(rows: DataFrame, key: str, order: str, size: str, hard: int, heading: str | None = None, soft: int | None = None, rounds: list[int] | None = None) -> DataFrame:
    """Rows with their place i and part: a part ends before an item once it has `hard` letters, or `soft` before a heading.

    Sizes are counted from the part's beginning; an item is never cut. Null sizes are 0; limits are above 0; order is
    distinct in a sequence.
    """
    known = settled(prefix_sums(rows, key, order, size))
    steps = first_at_least(known, key, F.col("before") + hard, F.lit(True), "_hard")
    if heading:
        steps = first_at_least(steps, key, F.col("before") + soft, F.coalesce(F.col(heading), F.lit(False)), "_soft").withColumn("next", F.least("_hard", "_soft"))
    else:
        steps = steps.withColumn("next", F.col("_hard"))
    return _numbered(known, led_to(steps, key, rounds), key).drop("before")


def pages(rows: DataFrame, key: str, order: str, height: str, most: float, keep: str, block: str, rounds: list[int] | None = None) -> DataFrame:
    """Rows with their place i and part: pages of items, as full as they get, of heights no more than `most`.

    A page doesn't end after an item that `keep`s with the next one (a heading), nor within a block (rows of one table have
    the same number); where no such end fits, it ends after the last item that does, or after one that is higher than a
    page. Heights are a column, so whoever lays text out brings the measure. An item without a height takes no room.
    """
    known = prefix_sums(rows, key, order, height)
    w = Window.partitionBy(key).orderBy("i")
    inside = F.coalesce(F.col(block) == F.lag(block).over(w), F.lit(False))
    known = settled(known.withColumn("_may", ~F.coalesce(F.lag(keep).over(w), F.lit(False)) & ~inside))
    # one place more, behind the last item: what fits to the end ends there
    ends = known.groupBy(key).agg((F.max("i") + 1).alias("i"), (F.max_by("before", "i") + F.max_by(F.coalesce(F.col(height), F.lit(0)), "i")).alias("before"))
    places = known.select(key, "i", "before", "_may").unionByName(ends.withColumn("_may", F.lit(True)))
    steps = last_at_most(places, key, F.col("before") + most, F.col("_may"), "_good")
    steps = last_at_most(steps, key, F.col("before") + most, F.lit(True), "_any")
    later = lambda c: F.when(F.col(c) > F.col("i"), F.col(c))
    steps = steps.withColumn("next", F.coalesce(later("_good"), later("_any"), F.col("i") + 1))
    last = ends.select(F.col(key).alias("_k"), F.col("i").alias("_end"))
    steps = steps.join(last, F.col(key).eqNullSafe(F.col("_k"))).where("i < _end").withColumn("next", F.when(F.col("next") < F.col("_end"), F.col("next")))
    return _numbered(known, led_to(steps, key, rounds), key).drop("before", "_may")
