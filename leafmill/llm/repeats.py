"""Long strings of symbols that start in several places of a corpus, found exactly and without one row per place.

Triggers of a rolling hash cut every text into phrases: a place is a trigger if, among the k-symbol strings of some
window of `length` symbols, its string has the least hash (the leftmost on ties). A window's trigger depends on the
window's content alone, so equal windows have equal triggers at equal distances. The windows in a row that share a
trigger, with all symbols they cover, are one phrase; `phrases` gives a row for each, about 2 / (length - k) of the
symbols. Phrases make up the dictionary (trigger string, content), their places the parse.

* A phrase that occurs twice repeats all its windows.
* Two different phrases around the same trigger string may share some. `shared` puts the dictionary's phrases of a
  trigger string together and ranks their suffixes to the depth of a window by prefix doubling (a suffix array cut at
  that depth), which tells just which windows they share.

No step brings the places of one string together: counts are map-side combined, and places meet their verdict in a
join. A trigger string with more than `WIDE` different phrases is compared by rows of window hashes instead, with the
same result.

Defined cases: a null text is an empty one, without phrases; a null doc_id is the smallest; rows equal in doc_id and text
are told apart where they count as other places (`ordered` is False), and are one where they do not; an empty table gives
empty ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, merged, raw, released

#: Multipliers of the rolling hashes, any odd numbers.
BASE, FOLD, MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))
#: Symbols handled at once, and windows of one text that are searched together.
STEP = 1 << 20
#: Phrases of one trigger string that are compared in one place; more of them are compared by rows, see `shared_wide`.
WIDE = 16_384
#: A null doc_id comes first.
NO_ID = -(1 << 63)

PLACE = ["id", "th"]


@dataclass(frozen=True)
class Kind:
    """How a text is cut into symbols. symbols(list of UTF-8 texts): 64-bit symbols and their offsets by text."""

    symbols: Callable
    length: int
    k: int
    #: True: a window counts if it starts in a text of a smaller doc_id. False: if it starts anywhere else.
    ordered: bool


def rolling(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each place; k is a power of two."""
    h, m, base = symbols, 1, int(BASE)
    while m < k:
        h = h[:-m] * np.uint64(base) + h[m:]
        m, base = 2 * m, base * base % (1 << 64)
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    m = 1
    while 2 * m <= width:
        values, m = np.minimum(values[:-m], values[m:]), 2 * m
    return np.minimum(values[: len(values) - (width - m)], values[width - m :]) if width > m else values


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FOLD ** i and its inverse, i < n."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(FOLD), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, STEP) + 1, x)]), dtype=np.uint64) for x in (FOLD, inverse)]
    return _powers[0], _powers[1]


def _phrases(symbols: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(text, start, windows, trigger's distance from start, trigger hash, content hash) arrays."""
    total = len(symbols)
    if total < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    h = rolling(symbols, k)
    low = np.uint64((1 << 24) - 1)
    trigger = (least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - k + 1) & low).astype(np.int64)
    new = np.empty(len(trigger), bool)
    new[0] = True
    np.not_equal(trigger[1:], trigger[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < len(trigger)]] = True
    starts = np.flatnonzero(new)
    text = np.searchsorted(offsets, starts, "right") - 1
    last = offsets[text + 1] - length
    windows = np.minimum(np.append(starts[1:], len(trigger)), last + 1) - starts
    keep = windows > 0
    starts, text, windows = starts[keep], text[keep], windows[keep]
    at = trigger[starts]
    up, down = powers(total)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(symbols * up[:total], dtype=np.uint64)])
    content = (sums[starts + windows - 1 + length] - sums[starts]) * down[starts]
    return text, starts - offsets[text], windows, at - starts, h[at], content


def chunks(symbols: np.ndarray, offsets: np.ndarray, length: int):
    """(symbols, offsets, first text, start in it): several texts together, long ones in overlapping parts."""
    text, count = 0, len(offsets) - 1
    while text < count:
        size = offsets[text + 1] - offsets[text]
        if size > STEP + length:
            for s in range(0, size - length + 1, STEP):
                part = symbols[offsets[text] + s : min(offsets[text] + s + STEP + length - 1, offsets[text + 1])]
                yield part, np.array([0, len(part)]), text, s
            text += 1
            continue
        end = max(text + 1, int(np.searchsorted(offsets, offsets[text] + STEP + length, "right")) - 1)
        yield symbols[offsets[text] : offsets[end]], offsets[text : end + 1] - offsets[text], text, 0
        text = end


def phrases(texts: DataFrame, kind: Kind) -> DataFrame:
    """(id, th, s, n, o, kmer, content) of all phrases: n windows from place s on, the trigger o after s."""
    symbols, length, k = kind.symbols, kind.length, kind.k

    def run(batches):
        for batch in merged(batches, STEP):
            flat, offsets = symbols(batch.column(2))
            for part, offs, first, shift in chunks(flat, offsets, length):
                text, s, n, o, kmer, content = _phrases(part, offs, length, k)
                rows = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows)] + [pa.array(x.astype(np.int32)) for x in (s + shift, n, o)] + [pa.array(x.view(np.int64)) for x in (kmer, content)],
                    names=["id", "th", "s", "n", "o", "kmer", "content"],
                )

    return texts.mapInArrow(run, "id long, th long, s int, n int, o int, kmer long, content long")


def _suffix_ranks(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Ranks of all places by their next m symbols, and m, the largest power of two up to depth."""
    m = 1
    if symbols.dtype == np.uint8:
        wide = symbols.astype(np.uint64)
        while m < 8:
            wide, m = wide[:-m] << np.uint64(8 * m) | wide[m:], 2 * m
        symbols = wide
    rank = np.unique(symbols, return_inverse=True)[1]
    while 2 * m <= depth:
        pair = rank[:-m].astype(np.uint64) << np.uint64(32) | rank[m:].astype(np.uint64)
        rank, m = np.unique(pair, return_inverse=True)[1], 2 * m
    return rank, m


def common_windows(spans: list[np.ndarray], windows: np.ndarray, first_id: np.ndarray, kind: Kind) -> list[list[tuple[int, int]]]:
    """For each phrase the runs [from, to) of its windows that count against the other phrases."""
    length = kind.length
    flat = np.concatenate(spans)
    begins = np.cumsum([0, *(len(x) for x in spans)])[:-1]
    owner = np.repeat(np.arange(len(spans)), windows)
    bounds = np.cumsum([0, *windows])
    places = begins[owner] + np.arange(bounds[-1]) - bounds[owner]
    rank, m = _suffix_ranks(flat, length)
    group = np.unique(rank[places].astype(np.uint64) << np.uint64(32) | rank[places + length - m].astype(np.uint64), return_inverse=True)[1]
    if kind.ordered:
        smallest = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, first_id[owner])
        counts = smallest[group] < first_id[owner]
    else:
        counts = np.bincount(group)[group] > 1
    edge = np.diff(np.concatenate([[0], counts.astype(np.int8), [0]]))
    out: list[list[tuple[int, int]]] = [[] for _ in spans]
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        while a < b:  # a run may go on in the next phrase
            k = owner[a]
            end = min(b, int(bounds[k + 1]))
            out[k].append((int(a - bounds[k]), int(end - bounds[k])))
            a = end
    return out


SHARED = "kmer long, content long, parts array<struct<a: int, b: int>>"


def shared(spans: DataFrame, kind: Kind) -> DataFrame:
    """(kmer, content, parts): the windows [a, b) of a phrase that it shares with others of its trigger string.

    spans has kmer, content, n, first_id and span (its symbols, 8 bytes each, or its bytes); a phrase that comes twice
    counts once.
    """
    dtype = np.uint64 if kind.ordered else np.uint8

    def pack(rows, parts):
        keep = [(r[0], r[1], [{"a": a, "b": b} for a, b in p]) for r, p in zip(rows, parts, strict=True) if p]
        cols = list(zip(*keep, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["kmer", "content", "parts"])

    def solve(rows):
        arrays = [np.frombuffer(r[4], dtype) for r in rows]
        return pack(rows, common_windows(arrays, np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.int64), kind))

    def run(batches):
        done, group, size = [], [], 0
        for batch in released(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][:2] == row[:2]:
                    continue  # a phrase counts once
                if group and group[-1][0] != row[0]:
                    done.extend(group)
                    group = []
                    if size > STEP // 2:
                        yield solve(done)
                        done, size = [], 0
                group.append(row)
                size += len(row[4]) // arr_size
        if done or group:
            yield solve(done + group)

    arr_size = np.dtype(dtype).itemsize
    chosen = spans.select("kmer", "content", "n", "first_id", "span")
    return chosen.repartition(partitions(spans), "kmer").sortWithinPartitions("kmer", "content").mapInArrow(run, SHARED)


def partitions(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_wide(spans: DataFrame, kind: Kind) -> DataFrame:
    """As `shared`, by one row for each window: for trigger strings with too many phrases for one place."""
    dtype, length, ordered = (np.uint64 if kind.ordered else np.uint8), kind.length, kind.ordered

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in released(batches):
            rows = []
            for kmer, content, n, first, span in zip(*(batch.column(c).to_pylist() for c in ("kmer", "content", "n", "first_id", "span")), strict=True):
                step = np.dtype(dtype).itemsize
                rows += [(kmer, content, first, w, xxh3_128_digest(span[w * step : (w + length) * step])) for w in range(n)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["kmer", "content", "first_id", "w", "hash"])

    rows = cut(spans.mapInArrow(run, "kmer long, content long, first_id long, w int, hash binary"), "windows")
    groups = rows.groupBy(F.col("hash").alias("h")).agg(F.count("*").alias("c"), F.min("first_id").alias("least"))
    counts = (F.col("least") < F.col("first_id")) if ordered else F.lit(True)
    hits = rows.join(groups.where("c > 1"), (F.col("hash") == F.col("h")) & counts, "left_semi")
    parts = F.transform(F.array_sort(F.collect_list("w")), lambda w: F.struct(w.alias("a"), (w + 1).alias("b")))
    return hits.groupBy("kmer", "content").agg(parts.alias("parts"))


def keyed(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(id, th, text): what tells a row from others, and its text (null: empty); and more columns in a struct."""
    text = F.coalesce("text", F.lit(""))
    kept = [F.struct(*more).alias("more")] if more else []
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), *kept)


def packed(texts: DataFrame) -> DataFrame:
    """texts with z, their UTF-8 compressed for shuffles, in place of text."""
    more = [f"more {t}" for c, t in texts.dtypes if c == "more"]

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in merged(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary()), *batch.columns[3:]], names=["id", "th", "z", *batch.schema.names[3:]])

    return texts.mapInArrow(run, ", ".join(["id long, th long, z binary", *more]))


def spans_of(wanted: DataFrame, texts: DataFrame, kind: Kind) -> DataFrame:
    """wanted, which has (kmer, content, n, first_id, m) and a place (id, th, s), with the place's symbols in a span instead.

    Where m is 0 the span is a digest of the text itself from there on, `n` windows far.
    """
    by_text = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("kmer", "content", "n", "first_id", "m", "s")).alias("want"))
    symbols, length = kind.symbols, kind.length

    def run(batches):
        import zstandard

        expand, last = zstandard.ZstdDecompressor().decompress, None
        for batch in released(batches):
            for k in range(0, batch.num_rows, 256):
                part, rows = batch.slice(k, 256), []
                for i, th, z, want in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (i, th) == last:
                        continue  # rows equal in id and text would give the same phrases again, and all to one place
                    last = (i, th)
                    flat, step = expand(z), 1
                    words = flat.split() if kind.ordered else None
                    if kind.ordered:
                        flat, step = symbols(pa.array([flat], pa.binary()))[0].tobytes(), 8
                    for w in want:
                        a, b = w["s"], w["s"] + w["n"] - 1 + length
                        rows.append((w["kmer"], w["content"], w["n"], w["first_id"], w["m"], flat[a * step : b * step] if w["m"] else words_digest(words[a:b])))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kmer", "content", "n", "first_id", "m", "span"])

    # a merge join leaves rows in the order of their keys
    joined = packed(texts).join(by_text.hint("merge"), PLACE).select("id", "th", "z", "want")
    return joined.mapInArrow(run, "kmer long, content long, n int, first_id long, m long, span binary")


def words_digest(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def verdicts(found: DataFrame, texts: DataFrame, kind: Kind, wide: int = WIDE, *, also: Callable | None = None):
    """(repeated phrases' places, their dictionary, digests).

    The dictionary has c places, first_id, and parts, the windows shared with rivals, phrases of the same trigger string,
    for each phrase. also(places, phrases without rivals) names further places, (kmer, content, n, first_id, id, th, s),
    whose digests are taken in the same pass over the texts.
    """
    often = found.groupBy("kmer").agg(F.count("*").alias("c")).where("c > 1").select("kmer")
    # written, so that both sides of the join are plain shuffles and a trigger string's many places can be split
    again = found.join(cut(often, "often"), "kmer")
    if kind.ordered:
        again = again.dropDuplicates(["id", "th", "s"])
    again = cut(again, "again")
    place = F.struct("id", "th", "s", "n")
    classes = again.groupBy("kmer", "content").agg(F.count("*").alias("c"), F.min(place).alias("first"))
    classes = cut(classes.select("kmer", "content", "c", F.col("first.id").alias("first_id"), "first.*"), "dictionary")
    several = classes.groupBy("kmer").agg(F.count("*").alias("m"))
    named = ["kmer", "content", "n", "first_id", "id", "th", "s", "m"]
    wanted = classes.join(several.where("m > 1"), "kmer").select(*named)
    if also:
        alone = classes.join(several.where("m = 1"), "kmer", "left_semi")
        wanted = wanted.union(also(again, alone).withColumn("m", F.lit(0).cast("long")).select(*named))
    spans = cut(spans_of(wanted, texts, kind), "spans")
    parts = shared(spans.where(f"m between 1 and {wide}"), kind)
    broad = spans.where(f"m > {wide}")
    if not broad.isEmpty():
        parts = parts.union(shared_wide(broad.dropDuplicates(["kmer", "content"]), kind))
    dictionary = classes.select("kmer", "content", "c", "first_id").join(parts, ["kmer", "content"], "left")
    return again, cut(dictionary, "verdicts"), spans.where("m = 0").select("kmer", "content", "first_id", F.col("span").alias("digest")).distinct()


def covered(again: DataFrame, dictionary: DataFrame, kind: Kind) -> DataFrame:
    """(id, th, spans): the places [a, b) of each text that windows which count cover, not yet joined up."""
    rows = again.select("id", "th", "s", "n", "kmer", "content").join(dictionary, ["kmer", "content"])
    parts = F.when(F.col("c") > 1, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))).otherwise(F.col("parts"))
    rows = rows.select("id", "th", "s", F.explode(parts).alias("p"))
    span = F.struct((F.col("s") + F.col("p.a")).alias("a"), (F.col("s") + F.col("p.b") - 1 + kind.length).alias("b"))
    return rows.select("id", "th", span.alias("span")).distinct().groupBy("id", "th").agg(F.collect_list("span").alias("spans"))


def union(spans) -> list[tuple[int, int]]:
    """Places [a, b) joined up where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, kind: Kind) -> DataFrame:
    """(id, th, spans) for the texts of docs that have repeated windows."""
    texts = keyed(docs)
    again, dictionary, _ = verdicts(cut(phrases(texts, kind), "phrases"), texts, kind)
    return covered(again, dictionary, kind)


_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def byte_symbols(column) -> tuple[np.ndarray, np.ndarray]:
    flat, offsets = raw(column)
    return _TABLE[flat], offsets


def word_symbols(column) -> tuple[np.ndarray, np.ndarray]:
    from xxhash import xxh3_64_intdigest

    words = [t.split() for t in column.cast(pa.binary()).to_pylist()]
    offsets = np.cumsum([0, *map(len, words)])
    return np.array([xxh3_64_intdigest(w) for ws in words for w in ws], np.uint64), offsets
