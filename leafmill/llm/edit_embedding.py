"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text: at step j the character under the pointer is put out, and a random function of
(j, character), the same for all texts, tells whether the pointer moves on. Texts at a small edit distance soon walk
together again, so their outputs are at a small Hamming distance. A fingerprint is `SLOTS` samples of the output: each
slot takes the step whose random number is the least among those that the text's length has, so texts of like lengths
take like steps, and puts the outputs up to that step into one hexadecimal digit.

A walk starts anew every `PART` characters, which bounds its length and lets all parts of all texts walk side by side. It
goes on until its pointer has left the part, so every character is put out: about two steps a character, `STEPS` at most
(should so few be left that the pointer has to move at each of them, it does). A slot whose step lies past the end of a
full part's walk takes that walk's last step.

`candidates` compares fingerprints: bands of sampled slots give pairs of fingerprint classes, each verified in full.

Defined cases: a null or empty text has the fingerprint of no characters, all 0; equal texts have equal fingerprints;
repeated rows are kept, rows of equal doc_id stand in order of their texts, a null doc_id comes first; the next document
of the only one is itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, released, slices

SLOTS, PART, STEPS, REACH = 256, 4096, 9216, 8
#: Characters walked side by side, and rows handled at once: a task holds some 50 MB meanwhile.
STEP, ROWS = 2 << 20, 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64)


_COINS = (_random(STEPS * 256, 11) & np.uint64(1)).astype(np.uint8).reshape(STEPS, 256)
_LETTERS = _random(256, 12)


def _records(slot: int, most: float = 2.0**45) -> np.ndarray:
    """Steps at which a sequence of random numbers, one per step, reaches a new least; drawn by their gaps."""
    rng = np.random.default_rng((13, slot))
    at, least, out = 0, rng.random(), [0]
    while True:
        at += int(rng.geometric(max(least, 1e-15)))
        if at > most:
            return np.array(out, np.int64)
        out.append(at)
        least *= rng.random()


_RECORDS = [_records(k) for k in range(SLOTS)]


def letters(text: str) -> np.ndarray:
    """Characters as numbers from 1 to 255 (code points folded)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (points % 255 + 1).astype(np.uint8)


def fingerprints(texts: list[np.ndarray]) -> list[str]:
    """The fingerprint of each text, a string of SLOTS hexadecimal digits."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    sizes = np.array([len(t) for t in texts])
    parts = -(-sizes // PART)
    last = sizes - (parts - 1) * PART
    begins = np.cumsum([0, *parts])[:-1]
    lanes = [t[a : a + PART] for t in texts for a in range(0, len(t), PART)]
    owner = np.repeat(np.arange(len(texts)), parts)
    order = np.argsort([-len(x) for x in lanes], kind="stable")
    place = np.empty(len(lanes), int)
    place[order] = np.arange(len(lanes))
    groups = range(0, len(lanes), 2048)
    walked = [_walk([lanes[i] for i in order[at : at + 2048]]) for at in groups]
    length = np.zeros(len(lanes), np.int64)  # steps of each lane's walk
    for at, walks in zip(groups, walked, strict=True):
        length[order[at : at + 2048]] = np.count_nonzero(walks, axis=0)
    full = sizes > 0
    # steps that a text has: STEPS for each part but the last, and the walk of the last
    steps = np.ones(len(texts), np.int64)
    steps[full] = (parts[full] - 1) * STEPS + length[begins[full] + parts[full] - 1]
    chosen = np.stack([r[np.searchsorted(r, steps, "left") - 1] for r in _RECORDS], axis=1)
    lane_of, step_of = begins[:, None] + chosen // STEPS, chosen % STEPS
    for at, walks in zip(groups, walked, strict=True):
        docs = np.unique(owner[order[at : at + 2048]])
        rank = place[lane_of[docs]] - at
        d, s = np.nonzero((rank >= 0) & (rank < walks.shape[1]))
        lane = rank[d, s]
        step = np.minimum(step_of[docs][d, s], length[order[at + lane]] - 1)
        digit = np.zeros(len(d), np.uint64)
        for t in range(REACH):
            digit = (digit ^ _LETTERS[walks[np.maximum(step - t, 0), lane]]) * _MIX
        out[docs[d], s] = digit >> np.uint64(60)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[out]
    return [row.tobytes().decode() for row in digits]


def _walk(lanes: list[np.ndarray]) -> np.ndarray:
    """Outputs by (step, lane); lanes from long to short, 0 where a walk has left its text."""
    longest, n = len(lanes[0]), len(lanes)
    flat = np.zeros((n, longest + 1), np.uint8)
    for k, lane in enumerate(lanes):
        flat[k, : len(lane)] = lane
    flat = flat.ravel()
    pointer = np.arange(n) * (longest + 1)
    limit = pointer + np.array([len(x) for x in lanes])
    walks, m = [], n  # the first m lanes have all that are not at their end
    for j in range(STEPS):
        if j % 64 == 0:
            there = np.flatnonzero(pointer[:m] < limit[:m])
            if not len(there):
                break
            m = int(there[-1]) + 1
        here = pointer[:m]
        letter = flat[here]
        walks.append(letter)
        move = _COINS[j][letter]
        if STEPS - j <= longest:
            move = move | (limit[:m] - here >= STEPS - j)
        here += move
        np.minimum(here, limit[:m], out=here)
    out = np.zeros((len(walks), n), np.uint8)
    for j, letter in enumerate(walks):
        out[j, : len(letter)] = letter
    return out


def likeness(a: str, b: str) -> float:
    """Share of slots that agree beyond chance, 0 to 1."""
    if a == b:
        return 1.0
    same = np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8)
    return max(0.0, (float(same.mean()) - 1 / 16) / (15 / 16))


def _marks_up_to(value: Column, marks: list[int]) -> Column:
    """How many of the sorted marks are no more than value: first how many blocks of them, then how many of one block."""
    size = max(1, math.isqrt(len(marks)))
    count = lambda array: F.size(F.filter(array, lambda m: m <= value))
    whole = count(F.array(*map(F.lit, marks[size - 1 :: size])).cast("array<bigint>"))
    return whole * size + count(F.slice(F.array(*map(F.lit, marks)).cast("array<bigint>"), whole * size + 1, F.lit(size)))


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, place, doc_id, text): documents in ranges of doc_id, each range followed by the first of the next one.

    place tells such a guest (1, or 2 for the first document of all, which follows the last) from the range's own rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # as many ranges as partitions: the marks' error is a quarter of a range, at any number of them
    marks = sorted({int(x) for x in rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)})
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_marks_up_to(F.col("doc_id"), marks))
    ranged = rows.withColumn("bucket", bucket.cast("int"))
    firsts = ranged.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("bucket").collect()  # one row a range
    if not firsts:
        return ranged.select("bucket", F.lit(0).alias("place"), "doc_id", "text")
    before = {}
    for k, r in enumerate(firsts):
        before[r["bucket"]] = (firsts[k - 1]["bucket"], 1 if k else 2, None if r["nulls"] else r["least"])
    # by range, so that a row looks at its own alone; ranges without rows are never looked at
    places = [before.get(b, (0, 1, None)) for b in range(len(marks) + 1)]
    guest = F.get(F.array(*[F.struct(F.lit(t).cast("int").alias("bucket"), F.lit(p).alias("place"), F.lit(i).cast("long").alias("least")) for t, p, i in places]), F.col("bucket"))
    stays, goes = F.struct(F.col("bucket"), F.lit(0).alias("place")), F.struct(guest["bucket"].alias("bucket"), guest["place"].alias("place"))
    to = F.when(guest["least"].eqNullSafe(F.col("doc_id")), F.array(stays, goes)).otherwise(F.array(stays))
    dealt = ranged.select(F.explode(to).alias("to"), "doc_id", "text").select("to.*", "doc_id", "text")
    dealt = dealt.repartitionById(len(marks) + 1, "bucket")
    return dealt.sortWithinPartitions("bucket", "place", F.asc_nulls_first("doc_id"), "text")


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _solve(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text) in order, the last only as the next of the one before it."""
    half = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), (_, n) in zip(rows, rows[1:], strict=False)]
    prints = fingerprints([letters(t) for t in (*(t for _, t in rows), *half)])
    own, new = prints[: len(rows)], prints[len(rows) :]
    out = [
        (i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), a, b, likeness(a, b), likeness(a, c))
        for (i, t), e, a, b, c in zip(rows, half, own, new, own[1:], strict=False)
    ]
    cols = list(zip(*out, strict=True)) or [[]] * 7
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[n.split()[0] for n in _EDITED.split(", ")])


def _edit(batches):
    """Results of batches of `in_order`, for about STEP characters and ROWS rows at a time."""
    held, size, bucket, closed = [], 0, None, False
    for batch in slices(batches, STEP, ROWS):
        for b, place, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                if len(held) > 1:
                    yield _solve(held)
                held, size, bucket, closed = [], 0, b, False
            if closed:
                continue  # the next range's first document is enough
            closed = place > 0
            held.append((i, text))
            size += len(text)
            if len(held) > 1 and (size > STEP or len(held) > ROWS):
                yield _solve(held)
                held, size = held[-1:], len(text)
    if len(held) > 1:
        yield _solve(held)


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has the last half of a text's characters replaced by the first as many of the next document.
    """
    return in_order(docs).mapInArrow(lambda batches: released(_edit(batches)), _EDITED)


#: Bands of slots, slots in a band: texts whose slots agree in 0.8 meet in 32 bands of 8 with probability 0.997.
BANDS, WIDTH, NEAR = 32, 8, 0.8
#: Fingerprints of a band that are compared in one place; a larger band is cut into blocks and each pair of blocks compared.
BLOCK = 2048


def _forest(prints: list[str], near: float, split: int | None = None) -> list[tuple[str, str, float]]:
    """Spanning forest of the pairs (a < b) with likeness near or more, the most alike first; with split, of the pairs
    between the first split and the others."""
    rows = np.frombuffer("".join(prints).encode(), np.uint8).reshape(len(prints), SLOTS)
    found = []
    for k in range(len(prints) if split is None else split):
        start = k + 1 if split is None else split
        same = (rows[start:] == rows[k]).mean(axis=1)
        alike = np.maximum(0.0, (same - 1 / 16) / (15 / 16))
        found += [(float(alike[i]), k, start + int(i)) for i in np.flatnonzero(alike >= near)]
        if len(found) > 1 << 20:
            found = _spanning(found, len(prints))
    return [(min(prints[i], prints[j]), max(prints[i], prints[j]), x) for x, i, j in _spanning(found, len(prints))]


def _spanning(edges: list[tuple[float, int, int]], n: int) -> list[tuple[float, int, int]]:
    parent, out = list(range(n)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, i, j in sorted(edges, key=lambda e: -e[0]):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            out.append((x, i, j))
    return out


def candidates(printed: DataFrame, near: float = NEAR, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes): verified pairs (a, b, likeness) of different fingerprints, and the rows with their class.

    printed has doc_id and fingerprint; a class is a fingerprint, so copies are one and give no pairs. All members of a
    band are compared, in pairs of blocks; each gives a spanning forest of its links, so a band of m alike members gives
    about m pairs, not m squared, and all that are linked in it stay linked, through chains too.
    """
    classes = printed.select("doc_id", "fingerprint")
    prints = cut(classes.select("fingerprint").distinct(), "prints")
    perm = np.random.default_rng(17).permutation(SLOTS)
    picks = [F.concat(F.lit(f"{k}:"), *[F.substring("fingerprint", int(i) + 1, 1) for i in perm[k * WIDTH : (k + 1) * WIDTH]]) for k in range(BANDS)]
    banded = prints.select("fingerprint", F.explode(F.array(*picks)).alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    # a block meets every block of its band once: (i, j) with i <= j
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = banded.join(sizes, "band").withColumn("own", own).select("fingerprint", "band", "own", F.explode(meets).alias("pair")).select("fingerprint", "band", "own", "pair.*")

    def run(batches):
        held, key = [], None

        def done():
            if key[1] == key[2]:
                edges = _forest([p for p, _ in held], near)
            else:
                held.sort(key=lambda x: x[1])
                edges = _forest([p for p, _ in held], near, sum(o == key[1] for _, o in held))
            cols = list(zip(*edges, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["a", "b", "likeness"])

        for batch in batches:
            for fingerprint, band, o, i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, i, j) != key:
                    if held:
                        yield done()
                    held, key = [], (band, i, j)
                held.append((fingerprint, o))
        if held:
            yield done()

    grouped = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return cut(grouped.mapInArrow(run, "a string, b string, likeness double").distinct(), "pairs"), classes
