"""Byte n-grams: counts over a corpus, models with back-off weights, and scores of whole texts.

A text is its bytes and one end symbol (0), after `order - 1` symbols 0. A gram of o symbols is the number whose lowest
byte is its last symbol, with a model's number (tag) in bits 48-60 and o in bits 61-63. A model is a set of grams with
log10 probability and back-off weight: an unseen gram costs its context's weight and goes on in the shorter context.

Defined cases: an empty text is its end symbol; a byte 0 in a text is the same symbol as an end; a model of no text at all
gives every symbol 1 / 256; rows that repeat count as often as they come.
"""

from __future__ import annotations

import functools
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, merged, raw, shared_path, slices

MAX_ORDER, MAX_TAGS = 6, (1 << 13) - 1
_TAG, _ORDER = 48, 61
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SCATTER = np.uint64(0x9E3779B97F4A7C15)


def grams(flat: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Keys (no tag, no order) of the grams that end at each symbol of each text, end symbols included."""
    n, pad = len(offsets) - 1, order - 1
    sizes = np.diff(offsets)
    padded = np.zeros(len(flat) + (n + 1) * max(pad, 1), np.uint64)
    ends = offsets[1:] + (np.arange(n) + 1) * max(pad, 1)
    scored = np.ones(len(padded), bool)
    scored[: max(pad, 1)] = False
    for t in range(1, max(pad, 1)):
        scored[ends + t] = False
    at = scored.copy()
    at[ends] = False
    padded[at] = flat
    key = np.zeros(len(padded), np.uint64)
    for t in range(order):
        key[t:] |= padded[: len(padded) - t] << np.uint64(8 * t)
    assert sizes.sum() == at.sum()
    return key[scored]


def mask(order: int) -> int:
    return (1 << 8 * order) - 1


def squeezed(texts: DataFrame) -> DataFrame:
    """texts, which has doc_id, tag and text, with the text compressed: less than half as much to shuffle."""

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            small = pa.array([squeeze(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), small], names=["doc_id", "tag", "text"])

    kind = dict(texts.dtypes)
    return texts.select("doc_id", "tag", "text").mapInArrow(run, f"doc_id {kind['doc_id']}, tag int, text binary")


def counts(texts: DataFrame, order: int, lower: bool = False) -> DataFrame:
    """(key, n) of the highest order, tags in the keys; texts has (text, tag). Added up where they are read first.

    A binary text is a compressed one (`squeezed`).
    """
    small = dict(texts.dtypes)["text"] == "binary"

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in merged(batches, 1 << 20 if small else 4 << 20):
            column = pa.array([expand(z) for z in batch.column(0).to_pylist()], pa.binary()) if small else batch.column(0)
            flat, offsets = raw(column)
            tags = np.repeat(batch.column(1).to_numpy().astype(np.uint64) << np.uint64(_TAG), np.diff(offsets) + 1)
            key, n = np.unique(grams(LOWER[flat] if lower else flat, offsets, order) | tags, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return texts.select("text", "tag").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def shorter(key: Column, order: int) -> Column:
    """The gram's last `order` symbols, its tag kept."""
    return key.bitwiseAND(F.lit(mask(order) | (MAX_TAGS << _TAG)))


def context(key: Column, order: int) -> Column:
    """What comes before the last symbol of a gram of `order`."""
    tag = key.bitwiseAND(F.lit(MAX_TAGS << _TAG))
    return F.shiftright(key.bitwiseAND(F.lit(mask(order))), 8).bitwiseOR(tag)


def by_order(top: DataFrame, order: int, distinct: bool) -> dict[int, DataFrame]:
    """(key, r, n) for each order: r occurrences; n is the same, or the number of different symbols before the gram."""
    levels = {order: top.select("key", F.col("n").alias("r"), "n")}
    for o in range(order - 1, 0, -1):
        add = F.count("*") if distinct else F.sum("r")
        levels[o] = cut(levels[o + 1].groupBy(shorter(F.col("key"), o).alias("key")).agg(F.sum("r").alias("r"), add.alias("n")), "grams")
    return levels


def threshold(level: DataFrame, order: int, limit: int) -> int:
    """The least power of two such that contexts seen so often have `limit` grams at most; 1 if all fit."""
    sizes = level.groupBy(context(F.col("key"), order).alias("ctx")).agg(F.sum("r").alias("t"), F.count("*").alias("d"))
    found = sizes.groupBy(F.floor(F.log2("t")).cast("int").alias("b")).agg(F.sum("d").alias("d")).collect()  # 64 rows at most
    total, least = 0, 62
    for row in sorted(found, key=lambda r: -r["b"]):
        total += row["d"]
        if total > limit:
            return 1 << least
        least = row["b"]
    return 1


def thresholds(levels: dict[int, DataFrame], order: int, limit: int) -> dict[int, int]:
    """The cut-off of each order; none is below a shorter order's, so that a kept context's suffixes are kept too."""
    out = {1: 1}
    for o in range(2, order + 1):
        out[o] = max(out[o - 1], threshold(levels[o], o, limit))
    return out


def columns(rows: DataFrame) -> tuple[np.ndarray, ...]:
    table = rows.toArrow()
    return tuple(table.column(c).to_numpy() for c in table.column_names)


def ppm(top: DataFrame, order: int, limit: int | None = None) -> Table:
    """Prediction by partial matching, escapes by method C, with symbol exclusion.

    A context with total t and d symbols gives a seen symbol n / (t + d) and the escape d / (t + d). After an escape the
    shorter context leaves out the symbols seen in the longer one, which scales all that it gives by the same factor,
    so escape times factor is a back-off weight. With a `limit`, contexts rarer than their order's threshold, chosen so
    that no order has more than `limit` grams, are no nodes of the trie.
    """
    least, short = dict.fromkeys(range(1, order + 1), 1), {}
    if limit is None:
        short[2] = cut(top.groupBy(shorter(F.col("key"), 2).alias("key")).agg(F.sum("n").alias("r"), F.sum("n").alias("n")), "grams")
        short[1] = by_order(short[2], 2, distinct=False)[1]
    else:
        short = by_order(top, order, distinct=False)
        least = thresholds(short, order, limit)

    def solve(o, key, r, n, lower):
        ctx, firsts, runs = _runs(key, o)
        total = np.add.reduceat(n, firsts).astype(float) if len(n) else np.zeros(0)
        keep = np.repeat(total >= least[o], runs)
        key, n, t, d = key[keep], n[keep], np.repeat(total, runs)[keep], np.repeat(runs, runs)[keep].astype(float)
        ctx, firsts, runs = _runs(key, o)
        escape = d[firsts] / (t[firsts] + d[firsts])
        if o == 1:
            weight = escape * 256 / np.maximum(256 - d[firsts], 1e-9)
        else:
            place = np.searchsorted(lower[0], _shorter(key, o - 1))
            seen = np.add.reduceat(lower[1][place].astype(float), firsts) if len(firsts) else np.zeros(0)
            tl, dl = lower[2][place[firsts]], lower[3][place[firsts]]
            weight = escape * (tl + dl) / (tl - seen + dl)
        return (o, key, np.log10(n / (t + d)), ctx[firsts], np.log10(np.maximum(weight, 1e-12))), (key, n, t, d)

    return _model(top, order, {1: short[1], 2: short[2]}, solve, distinct=False)


def kneser_ney(top: DataFrame, order: int, limit: int | None = None) -> Table:
    """Interpolated modified Kneser-Ney, each tag with discounts of its own; with a `limit`, contexts rarer than their order's
    threshold (see `ppm`) are left out.

    Lower orders count the different symbols before a gram, totals are counted by context.
    """
    levels = by_order(top, order, distinct=True)
    least = dict.fromkeys(range(1, order + 1), 1) if limit is None else thresholds(levels, order, limit)
    discounts = {}  # by order: a row for each tag
    tag = F.shiftright("key", _TAG).bitwiseAND(F.lit(MAX_TAGS)).cast("int")
    for o in range(1, order + 1):
        found = levels[o].where("n <= 4").groupBy(tag.alias("tag"), "n").agg(F.count("*").alias("m")).collect()  # four rows a tag at most
        r = np.zeros((max([x["tag"] for x in found], default=0) + 1, 5))
        for x in found:
            r[x["tag"], x["n"]] = x["m"]
        y = r[:, 1] / np.maximum(1, r[:, 1] + 2 * r[:, 2])
        each = np.zeros((len(r), 4))
        for k in (1, 2, 3):
            each[:, k] = np.where(r[:, k] > 0, np.clip(k - (k + 1) * y * r[:, k + 1] / np.maximum(1, r[:, k]), 0, k), 0.5 * k)
        discounts[o] = each

    def solve(o, key, r, n, lower):
        ctx, firsts, runs = _runs(key, o)
        keep = np.repeat(np.add.reduceat(r, firsts) >= least[o], runs) if len(n) else np.zeros(0, bool)
        key, n = key[keep], n[keep]
        ctx, firsts, runs = _runs(key, o)
        tags = np.minimum((key >> np.uint64(_TAG)).astype(np.int64) & MAX_TAGS, len(discounts[o]) - 1)
        each = discounts[o][tags, np.minimum(n, 3)]
        t, gamma = (np.add.reduceat(x.astype(float), firsts) if len(n) else np.zeros(0) for x in (n, each))
        gamma = gamma / t
        before = 1 / 256 if o == 1 else lower[1][np.searchsorted(lower[0], _shorter(key, o - 1))]
        p = (n - each) / np.repeat(t, runs) + np.repeat(gamma, runs) * before
        return (o, key, np.log10(p), ctx[firsts], np.log10(np.maximum(gamma, 1e-12))), (key, p)

    return _model(top, order, {1: levels[1], 2: levels[2]}, solve, distinct=True)


def _runs(key, order):
    """Contexts of sorted grams, the first place of each context, and its number of grams."""
    ctx = _context(key, order)
    firsts = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, int)
    return ctx, firsts, np.diff(np.append(firsts, len(ctx)))


def _model(top: DataFrame, order: int, short: dict[int, DataFrame], solve, distinct: bool) -> Table:
    """The model's table, made in shards and joined in files of the shared folder.

    All that a gram of three symbols or more needs has the same tag and the same two symbols before its last one: its
    context, the grams of that, and their shorter forms. So grams are dealt by these; those of orders 1 and 2, which the
    alphabet bounds, are solved first and sent along. solve(o, key, r, n, lower) gives an order's grams and contexts,
    and what the next order needs as lower.
    """
    spark = top.sparkSession
    parts, lower = [], None
    for o in (1, 2):
        key, r, n = columns(short[o].select("key", "r", "n"))
        by = np.argsort(key.view(np.uint64))
        part, lower = solve(o, key.view(np.uint64)[by], r[by], n[by], lower)
        parts.append(part)
    lower_two = spark.sparkContext.broadcast(lower)
    total = top.count() * (order - 2)
    # twice to four times as many slots as grams if each order had as many as the highest; about 2 ** 19 slots a shard
    bits = max(4, total.bit_length() + 1)
    wide = max(0, bits - 19)

    def rows(found):
        keys = np.concatenate([k | np.uint64(o << _ORDER) for o, k, *_ in found] + [c | np.uint64((o - 1) << _ORDER) for o, _, _, c, _ in found])
        size = sum(len(x[1]) for x in found)
        logp, weight = np.full(len(keys), -np.inf, np.float32), np.zeros(len(keys), np.float32)
        logp[:size] = np.concatenate([x[2] for x in found])
        weight[size:] = np.concatenate([x[4] for x in found])
        shard = ((keys * _SCATTER) >> np.uint64(64 - wide)).astype(np.int32) if wide else np.zeros(len(keys), np.int32)
        for at in range(0, len(keys), 1 << 16):
            mine = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(shard[mine]), pa.array(keys[mine].view(np.int64)), pa.array(logp[mine]), pa.array(weight[mine])], names=["shard", "key", "logp", "weight"])

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        key, r = np.concatenate([k for k, _ in held]).view(np.uint64), np.concatenate([n for _, n in held])
        by = np.argsort(key)
        levels = {order: (key[by], r[by], r[by])}
        for o in range(order - 1, 2, -1):
            key, r, _ = levels[o + 1]
            key, where, n = np.unique(_shorter(key, o), return_inverse=True, return_counts=True)
            r = np.bincount(where, r).astype(np.int64)
            levels[o] = (key, r, n if distinct else r)
        found, low = [], lower_two.value
        for o in range(3, order + 1):
            part, low = solve(o, *levels[o], low)
            found.append(part)
        yield from rows(found)

    schema = "shard int, key long, logp float, weight float"
    two = F.col("key").bitwiseAND(F.lit(0xFFFF00 | MAX_TAGS << _TAG))  # and the model
    entries = top.select("key", "n").repartition(two).mapInArrow(run, schema)
    entries = entries.union(spark.createDataFrame(pa.Table.from_batches(list(rows(parts)), pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("logp", pa.float32()), ("weight", pa.float32())]))).select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")))))
    path = shared_path(spark, "model")

    def write(batches):
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        shard, key, logp, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        key = key.view(np.uint64)
        del held
        for k in np.unique(shard):
            mine = shard == k
            every, where = np.unique(key[mine], return_inverse=True)
            lp, w = np.full(len(every), -np.inf, np.float32), np.zeros(len(every), np.float32)
            np.maximum.at(lp, where, logp[mine])
            np.add.at(w, where, weight[mine])  # one row of a key has its weight, the other 0
            slot = ((every * _SCATTER) >> np.uint64(64 - bits)).astype(np.int64)
            by = np.argsort(slot, kind="stable")
            sizes = np.bincount(slot - (int(k) << (bits - wide)), minlength=1 << (bits - wide)).astype(np.int32)
            name = f"{path}/shard-{k}-{uuid.uuid4().hex}.npz"
            np.savez(name, keys=every[by], logp=lp[by], weight=w[by], sizes=sizes)
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([len(every)]), pa.array([name])], names=["shard", "n", "name"])

    done = entries.repartition(max(2, 1 << wide), "shard").mapInArrow(write, "shard long, n long, name string").collect()  # one row a shard
    return Table.joined(order, path, bits, wide, {r["shard"]: (r["n"], r["name"]) for r in done})


def _tag(key):
    return key & np.uint64(MAX_TAGS << _TAG)


def _context(key, order):
    return (key & np.uint64(mask(order))) >> np.uint64(8) | _tag(key)


def _shorter(key, order):
    return key & np.uint64(mask(order)) | _tag(key)


class Table:
    """Grams of all orders in one static hash table: those of a slot stand together, `start` tells where.

    Its arrays are files of the shared folder, mapped and not loaded: processes of a machine share what they read.
    """

    NAMES = ("keys", "logp", "weight", "start")

    def __init__(self, order: int, path: str):
        self.order, self.path = order, path
        # plain views: fancy indices of a memmap are slower
        self.keys, self.logp, self.weight, self.start = (np.asarray(np.load(f"{path}/{x}.npy", mmap_mode="r")) for x in self.NAMES)
        self.shift = np.uint64(65 - len(self.start).bit_length())

    @classmethod
    def joined(cls, order: int, path: str, bits: int, wide: int, shards: dict[int, tuple[int, str]]) -> Table:
        """Shards, {number: (grams, file)}, joined one at a time."""
        size = sum(n for n, _ in shards.values())
        kinds = (np.uint64, np.float32, np.float32, np.int32 if size < 1 << 31 else np.int64)
        sizes = (max(size, 1), max(size, 1), max(size, 1), (1 << bits) + 1)
        keys, logp, weight, start = (np.lib.format.open_memmap(f"{path}/{x}.npy", "w+", kind, (n,)) for x, kind, n in zip(cls.NAMES, kinds, sizes, strict=True))
        if not size:  # one gram that no text has
            keys[0], logp[0] = ~np.uint64(0), -np.inf
        at, each = 0, 1 << (bits - wide)
        for k in range(1 << wide):
            mine = slice(1 + k * each, 1 + (k + 1) * each)
            if k not in shards:
                start[mine] = at
                continue
            n, name = shards[k]
            with np.load(name) as shard:
                keys[at : at + n], logp[at : at + n], weight[at : at + n] = shard["keys"], shard["logp"], shard["weight"]
                start[mine] = at + np.cumsum(shard["sizes"])
            os.remove(name)
            at += n
        for x in (keys, logp, weight, start):
            x.flush()
        return cls(order, path)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where there is none."""
        slot = ((keys * _SCATTER) >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out = np.full(len(keys), -1, self.start.dtype)
        left = np.flatnonzero(at < end)
        at = at[left]
        while len(left):
            hit = self.keys[at] == keys[left]
            out[left[hit]] = at[hit]
            at += 1
            go = ~hit & (at < end[left])
            left, at = left[go], at[go]
        return out

    def score(self, flat: np.ndarray, offsets: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """log10 probability of each text, its end included."""
        sizes = np.diff(offsets) + 1
        return np.add.reduceat(self.each(flat, offsets, tags), np.cumsum(sizes) - sizes)

    def each(self, flat: np.ndarray, offsets: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol of the texts, the end symbol last in each."""
        sizes = np.diff(offsets) + 1
        keys = grams(flat, offsets, self.order) | np.repeat(tags.astype(np.uint64) << np.uint64(_TAG), sizes)
        total, left = np.zeros(len(keys)), np.arange(len(keys))
        for o in range(self.order, 0, -1):
            place = self.find(_shorter(keys[left], o) | np.uint64(o << _ORDER))
            value = np.where(place >= 0, self.logp[place], -np.inf)
            hit = value > -np.inf
            total[left[hit]] += value[hit]
            left = left[~hit]
            if not len(left):
                break
            place = self.find(_context(keys[left], o) | np.uint64((o - 1) << _ORDER))
            total[left] += np.where(place >= 0, self.weight[place], 0)
        total[left] -= np.log10(256)
        return total


@functools.lru_cache(2)
def _opened(order: int, path: str) -> Table:
    return Table(order, path)


def shipped(spark, table: Table):
    """A function that gives workers the table, from the shared folder."""
    order, path = table.order, table.path
    return lambda: _opened(order, path)


def scores(texts: DataFrame, table: Table, lower: bool = False) -> DataFrame:
    """texts, which has text and tag, with n_bytes and log10_prob in place of these."""
    get = shipped(texts.sparkSession, table)
    others = [(c, t) for c, t in texts.dtypes if c not in ("text", "tag")]
    names = [c for c, _ in others]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in others), "n_bytes long, log10_prob double"])

    def run(batches):
        for batch in slices(batches, 1 << 20, column="text"):
            flat, offsets = raw(batch.column(batch.schema.get_field_index("text")))
            tags = batch.column(batch.schema.get_field_index("tag")).to_numpy()
            got = get().score(LOWER[flat] if lower else flat, offsets, tags)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(offsets)), pa.array(got)], names=[*names, "n_bytes", "log10_prob"])

    return texts.mapInArrow(run, schema)
