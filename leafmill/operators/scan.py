"""State machines over long sequences, as scans of composed maps.

A row of a sequence maps each state to the next one. Such maps compose, and composing is associative, so a sequence is cut
into blocks, blocks of blocks and so on: maps are composed upwards, states are handed downwards, and no task holds more
than a block, however long one sequence is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and blocks of a block of the next level.
FAN = 256


def _steps(n: int, fan: int) -> int:
    levels = 0
    while n > 0:
        n, levels = n // fan, levels + 1
    return levels


def states(rows: DataFrame, keys: list[str], order: str, maps: DataFrame, on: str, size: int, start: int = 0, fan: int = FAN) -> DataFrame:
    """rows with the state before each of them, as column state.

    Sequences go by `keys`, in ascending `order` (a long from 0 on, gaps allowed; ties in the order of the other columns,
    which have to be comparable). `maps` (`on`, map) has for each value of `on` the array of next states, `size` of them;
    it is small: a row for each distinct kind of row. Null keys are sequences of their own; rows with a null order or
    without a map are left out.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(order).isNotNull()).join(F.broadcast(maps.select(on, F.col("map").alias("_map"))), on)
    names, to_long = rows.columns, lambda c: F.floor(c / F.lit(fan)).cast("long")
    item = F.struct(F.col(order).cast("long").alias("_at"), F.struct(*names).alias("_row"), "_map")
    group = [*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), to_long(F.col(order)).alias("_block")]
    ks = [f"_k{n}" for n in range(len(keys))]
    identity = F.array(*[F.lit(s).cast("int") for s in range(size)])
    compose = lambda items: F.aggregate(items, identity, lambda done, x: F.transform(done, lambda s: F.element_at(x["_map"], s + 1)))
    leaves = known.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_items"))  # one block
    levels = [leaves.select(*ks, "_block", compose(F.col("_items")).alias("_map"))]
    highest = known.agg(F.max(F.col(order).cast("long"))).head()[0] or 0
    for _ in range(max(0, _steps(highest // fan, fan))):
        below = levels[-1]
        grouped = below.groupBy(*ks, to_long(F.col("_block")).alias("_up")).agg(F.array_sort(F.collect_list(F.struct(F.col("_block").alias("_at"), "_map"))).alias("_items"))
        levels.append(grouped.select(*ks, F.col("_up").alias("_block"), compose(F.col("_items")).alias("_map")))
    entry = levels[-1].select(*ks, "_block", F.lit(start).cast("int").alias("_state"))
    walked = F.aggregate(
        "_items", F.struct(F.col("_state").alias("s"), F.array().cast("array<int>").alias("seen")),
        lambda done, x: F.struct(F.element_at(x["_map"], done["s"] + 1).alias("s"), F.array_append(done["seen"], done["s"]).alias("seen")), lambda done: done["seen"])
    same = lambda a, b, also: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in ks] + [also]
    for below in reversed(levels[:-1]):
        grouped = below.groupBy(*ks, to_long(F.col("_block")).alias("_up")).agg(F.array_sort(F.collect_list(F.struct(F.col("_block").alias("_at"), "_map"))).alias("_items"))
        met = grouped.alias("a").join(entry.alias("b"), same("a", "b", F.col("a._up") == F.col("b._block"))).select(*(f"a.{k}" for k in ks), "_items", "_state")
        seen = met.select(*ks, "_items", walked.alias("_seen")).select(*ks, F.explode(F.arrays_zip("_items", "_seen")).alias("x"))
        entry = seen.select(*ks, F.col("x._items._at").alias("_block"), F.col("x._seen").alias("_state"))
    met = leaves.alias("a").join(entry.alias("b"), same("a", "b", F.col("a._block") == F.col("b._block"))).select("_items", "_state")
    found = met.select("_items", walked.alias("_seen")).select(F.explode(F.arrays_zip("_items", "_seen")).alias("x"))
    return found.select("x._items._row.*", F.col("x._seen").alias("state"))
