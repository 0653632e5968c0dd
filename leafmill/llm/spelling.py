"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped under their frequent form.

Near words are found by two-dimensional range reporting. Words stand in forward order and in the order of their reversed
spelling, so a word is a point (forward rank, reverse rank). An edit at position i leaves the prefix before it, an
interval of forward ranks, and the suffix behind it, an interval of reverse ranks; a wavelet tree over the reverse ranks
in forward order reports the points that lie in both.

What goes into one tree: an edit leaves the first or the second half of a word, so words meet in groups of one length and
one half, and are asked for edits in the other half only. A group of over GROUP words is cut in the same way again, at
the middle of the part that may be edited, until that part is one position, where a group is bounded by the alphabet. So
each pair is found in one group, and no group is larger than a task can hold. A deletion is an insertion seen from the
longer word.

Defined cases: a null or empty text has no words; a null doc_id is an empty string to the checksum; repeated rows count
again; of near words with equal n the least in code-point order is the form; an empty table gives an empty one. The trees
take the characters that words may have, up to U+00FF, as bytes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, key_text, slices

RUN = re.compile("[a-zÀ-ÿ]+")
#: A run loses a character where this divides its checksum with the document's id.
TYPO = 199
LEAST_CHARS, LEAST_N, RATIO = 6, 5, 5
#: Words that a task counts before it hands the counts on; words of a group; characters of a block's words.
HELD, GROUP, CELLS = 200_000, 4096, 1 << 20
#: Queries that go through a tree together.
ASKED = 1 << 17


def counts(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(word, n) of words of at least `least` characters, counted by task."""

    def table(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                start = crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
                for word, n in Counter(RUN.findall(text.lower().decode())).items():  # bytes: A-Z only
                    if len(word) < least:
                        continue
                    h = crc32(word.encode(), start)
                    if h % TYPO == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield table(held)
                    held = Counter()
        yield table(held)

    return key_text(docs).mapInArrow(run, "word string, n long")


def words(docs: DataFrame, least: int = LEAST_N) -> DataFrame:
    """(word, n) of the words that occur `least` times or more."""
    return counts(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _key(low: Column, high: Column, size: Column, longer: Column) -> Column:
    """A group: words of `size` characters (or one more: `longer`) that agree before `low` and from `high` on."""
    head, tail = F.substring(F.col("word"), F.lit(1), low), F.substring(F.col("word"), high + longer.cast("int") + 1, F.length("word"))
    return F.xxhash64(size, low, high, head, tail)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.select("word", "n", "size", "longer", "low", "high", _key(F.col("low"), F.col("high"), F.col("size"), F.col("longer")).alias("key"))


def dealt(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """(word, n, size, longer, low, high, key): each word in its groups."""
    rows = words.select("word", "n", F.explode(F.array(*(F.struct((F.length("word") - x).alias("size"), F.lit(bool(x)).alias("longer")) for x in (0, 1)))).alias("g")).select("word", "n", "g.*")
    half = F.floor(F.col("size") / 2).cast("int")
    sides = F.array(F.struct(half.alias("low"), F.col("size").alias("high")), F.struct(F.lit(0).alias("low"), half.alias("high")))
    rows = cut(_grouped(rows.withColumn("s", F.explode(sides)).select("word", "n", "size", "longer", "s.*")), "spelling-groups")
    done = None
    while True:
        hot = cut(rows.groupBy("key").count().where((F.col("count") > limit)).select("key"), "hot-groups")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        divisible = F.col("high") - F.col("low") > 1
        small = rows.join(hot, "key", "left_anti")
        large = rows.join(hot, "key", "left_semi")
        kept = small.unionByName(large.where(~divisible))
        done = kept if done is None else done.unionByName(kept)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        sides = F.array(F.struct(middle.alias("low"), F.col("high")), F.struct(F.col("low"), middle.alias("high")))
        parts = large.where(divisible).withColumn("s", F.explode(sides)).select("word", "n", "size", "longer", "s.*")
        rows = cut(_grouped(parts), "spelling-groups")


class Wavelet:
    """A permutation as a wavelet tree: each level parts the values by one bit, and counts the zeros before each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.levels = []
        for b in reversed(range(self.bits)):
            one = (values >> b & 1).astype(bool)
            self.levels.append(np.concatenate([[0], np.cumsum(~one, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def report(self, low, high, first, last) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of the values in [first, last) at the places [low, high) of each query."""
        query, value = np.arange(len(low), dtype=np.int64), np.zeros(len(low), np.int64)
        if not self.bits:
            return query[:0], value[:0]
        for b, zeros in zip(reversed(range(self.bits)), self.levels, strict=True):
            a, z = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            low = np.concatenate([a, zeros[-1] + low - a])
            high = np.concatenate([z, zeros[-1] + high - z])
            query, value = np.concatenate([query, query]), np.concatenate([value << 1, value << 1 | 1])
            live = (low < high) & ((value + 1) << b > first[query]) & (value << b < last[query])
            low, high, query, value = low[live], high[live], query[live], value[live]
        return query, value


def _order(group: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows by group and characters, and how many characters each shares with the row before it; -1 for another group."""
    full = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), chars], axis=1)
    order = np.argsort(np.ascontiguousarray(full).view(f"S{full.shape[1]}").ravel(), kind="stable")
    full = full[order]
    differ = full[1:] != full[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), full.shape[1]) - 4
    return order, np.concatenate([[-1], np.maximum(common, -1)])


def _intervals(common: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The interval [low, high) of rows that share their first `length` characters with each row."""
    n = len(common)
    begins = np.flatnonzero(common < length)
    which = np.searchsorted(begins, np.arange(n), "right") - 1
    return begins[which], np.concatenate([begins[1:], [n]])[which]


def near_in_block(spelled: list[bytes], size: int, group: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, near word) of rows: each pair of one length from both sides, each of two lengths from the shorter word."""
    n = len(spelled)
    chars = np.frombuffer(b"".join(w.ljust(size + 1, b"\0") for w in spelled), np.uint8).reshape(n, size + 1)
    back = np.where(longer[:, None], chars[:, ::-1], np.roll(chars, 1, axis=1)[:, ::-1])  # a shorter word's padding stays last
    forward, f_common = _order(group, chars)
    reverse, r_common = _order(group, back)
    f_rank, r_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    f_rank[forward], r_rank[reverse] = np.arange(n), np.arange(n)
    members = np.flatnonzero(~longer)
    trees, asked = {}, {False: [], True: []}
    for kind in (False, True):
        f_count, r_count = (np.concatenate([[0], np.cumsum(longer[o] == kind)]) for o in (forward, reverse))
        rows = forward[longer[forward] == kind]  # this kind's rows in forward order
        by_reverse = reverse[longer[reverse] == kind]
        trees[kind] = Wavelet(r_count[r_rank[rows]]), by_reverse, f_count, r_count
    for i in range(int(low[members].min()), int(high[members].max()) + 1):
        f_low, f_high = _intervals(f_common, i)
        for kind in (False, True):
            left = size - i - (not kind)  # characters behind the edit
            here = members[(low[members] <= i) & (i < high[members] + (kind & (high[members] == size)))]
            if left < 0 or not len(here):
                continue
            r_low, r_high = _intervals(r_common, left)
            _, _, f_count, r_count = trees[kind]
            a, b, c, d = f_count[f_low[f_rank[here]]], f_count[f_high[f_rank[here]]], r_count[r_low[r_rank[here]]], r_count[r_high[r_rank[here]]]
            some = (b - a > (not kind)) & (d - c > (not kind))  # others than the word itself
            asked[kind].append((here[some], np.full(int(some.sum()), i), a[some], b[some], c[some], d[some]))
    pairs = []
    for kind, found in asked.items():
        if not found:
            continue
        word, at, a, b, c, d = (np.concatenate(x) for x in zip(*found, strict=True))
        tree, by_reverse, _, _ = trees[kind]
        for k in range(0, len(word), ASKED):
            part = slice(k, k + ASKED)
            query, value = tree.report(a[part], b[part], c[part], d[part])
            u, v, i = word[part][query], by_reverse[value], at[part][query]
            # an inserted character that equals the next one is the same edit one place later
            new = chars[v, i] != chars[u, i] if kind else u != v
            pairs.append((u[new], v[new]))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def neighbours(words: DataFrame, limit: int = GROUP, cells: int = CELLS) -> DataFrame:
    """(word, near, near_n): the near words of each word, once."""

    def answers(rows):
        spelled, n, size, longer, low, high, key = rows
        # groups with one word alone, or without a shorter word, have no pair
        _, group, total = np.unique(key, return_inverse=True, return_counts=True)
        short = np.bincount(group[~longer], minlength=len(total))
        keep = (total[group] > 1) & (short[group] > 0)
        if keep.any():
            kept = [w for w, k in zip(spelled, keep, strict=True) if k]
            n, longer, low, high, group = n[keep], longer[keep], low[keep], high[keep], group[keep]
            u, v = near_in_block([w.encode("latin-1") for w in kept], int(size[0]), group, longer, low, high)
            u, v = np.concatenate([u, v[longer[v]]]), np.concatenate([v, u[longer[v]]])
            names = pa.array(kept, pa.string())
            for k in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(u[k : k + (1 << 16)])), names.take(pa.array(v[k : k + (1 << 16)])), pa.array(n[v[k : k + (1 << 16)]], pa.int64())], names=["word", "near", "near_n"])

    def run(batches):
        """Rows come by size and key; a block is some whole groups of one size."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(0).to_pylist(), *(batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7))]
            held = cols if held is None else [held[0] + cols[0], *(np.concatenate([x, y]) for x, y in zip(held[1:], cols[1:], strict=True))]
            start = 0
            edges = np.flatnonzero((np.diff(held[6]) != 0) | (np.diff(held[2]) != 0)) + 1  # where a group begins
            changes = np.flatnonzero(np.diff(held[2])) + 1
            for end in [*changes.tolist(), None]:
                while True:  # blocks of one size
                    stop = end if end is not None else (int(edges[-1]) if len(edges) else 0)
                    fits = start + max(1, cells // (int(held[2][start]) + 1))
                    if end is None and fits > stop:
                        break  # more of this size may follow
                    if fits < stop:
                        k = int(np.searchsorted(edges, fits, "right")) - 1
                        stop = int(edges[k]) if k >= 0 and edges[k] > start else int(edges[k + 1])
                    if stop <= start:
                        break
                    yield from answers([c[start:stop] for c in held])
                    start = stop
                    if end is not None and start >= end:
                        break
            held = [c[start:] for c in held]
        if held is not None and len(held[0]):
            yield from answers(held)

    rows = dealt(words, limit)
    spark = words.sparkSession
    # a number of its own: groups are dealt by count, and small rows must not end in few tasks
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.select("word", "n", "size", "longer", "low", "high", "key").repartition(count, "key").sortWithinPartitions("size", "key")
    return rows.mapInArrow(run, "word string, near string, near_n long")


def roots(links: DataFrame, highest: int | None, ratio: int = RATIO, least: int = LEAST_N) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to, by pointer doubling.

    Each form has `ratio` times its word's n at least, so the highest n bounds the number of steps.
    """
    steps = int(math.log(max((highest or 1) / least, 1), ratio)) + 1
    found = cut(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(steps + 1))):
        further = found.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        found = cut(found.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return found


def variants(docs: DataFrame, ratio: int = RATIO, least: int = LEAST_N, limit: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word."""
    found = cut(words(docs, least), "words")
    near = neighbours(found, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = found.join(near, "word", "left")
    form = -F.col("best.less") >= ratio * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(rows.where("form is not null"), found.agg(F.max("n")).head()[0], ratio, least)
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
    g AS (SELECT doc_id, w, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS hx FROM r WHERE length(w) >= 6 GROUP BY doc_id, w),
    c AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)), lambda a, b: xor(a >> 8, t.t[xor(a & 255, b) + 1])), 4294967295) AS h FROM g, t),
    e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM c),
    w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    m AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
    p AS (SELECT x.word, y.word AS near, y.n AS near_n FROM m x JOIN m y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word UNION SELECT w.word, m.word, m.n FROM w JOIN m ON w.word = m.a || m.b UNION SELECT m.word, w.word, w.n FROM w JOIN m ON w.word = m.a || m.b),
    f AS MATERIALIZED (SELECT w.word, w.n, count(near) AS n_near, min(struct_pack(l := -near_n, near := near)) AS best FROM w LEFT JOIN p USING (word) GROUP BY w.word, w.n),
    q AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN -best.l >= 5 * n THEN best.near END AS form, CASE WHEN -best.l >= 5 * n THEN -best.l END AS form_n FROM f),
    z AS (SELECT word, word AS root, 0 AS d FROM q UNION ALL SELECT z.word, q.form, d + 1 FROM z JOIN q ON z.root = q.word WHERE q.form IS NOT NULL)
    SELECT q.word, form, root, n, n_near, form_n FROM q JOIN (SELECT word, arg_max(root, d) AS root FROM z GROUP BY word) USING (word)"""
