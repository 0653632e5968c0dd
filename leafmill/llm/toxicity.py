"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window of `WINDOW` words is compressed
with both; the bytes that the toxic one saves are the window's distance. Windows at or above calibrated thresholds, those
that few ordinary windows reach, and the mean distance go through a logistic curve to the text's score.

What makes short windows comparable:

* Both dictionaries end with the same base, trained on ordinary text, and begin with the same entropy tables. What any
  text has is then as cheap with either, and they differ in the part of `OWN` bytes that each class trains for itself.
* Most windows of a toxic text are ordinary. After the first training the own parts are trained again, `ROUNDS` times in
  all, on the windows that the last dictionaries told apart. A text is always measured by dictionaries trained without
  it (`PARTS` parts), so that they do not find what they hold by heart; the round that explains the labels best is kept.

Fitting is bounded by three parameters of `score`: `most` different labelled texts of each class, those with the least
hash; of each `each` windows, evenly spread over the whole text; and `train` windows that one training of a dictionary
reads, drawn at random. Scoring uses every window of every text.

Defined cases: a null or empty text is one empty window; repeated rows score alike; of an id's rows the text with the
least hash is learnt from; with fewer than `LEAST` texts of a class to learn from, or too little text to train on, every
score is 0; labels, lang, source and doc_id never enter a score; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import key_text, slices

FOLDS, HELD_OUT = 3, 1
#: Texts of a class that are learnt from, windows of each, and texts below which nothing is learnt.
SAMPLE, SPREAD, LEAST = 2000, 256, 20
#: Words of a window; bytes of the dictionaries' common base and of their own parts, and of their segments.
WINDOW, BASE, OWN, BASE_SEGMENT, SEGMENT = 6, 200_000, 4096, 24, 10
#: Windows that one training of a dictionary reads, at most.
TRAIN = 40_000
PARTS, ROUNDS = 4, 2
#: Shares of ordinary windows below the thresholds, and below what makes a window worth training on again.
QUANTILES, TOLD_TOXIC, TOLD_ORDINARY = (0.98, 0.995, 0.999), 0.98, 0.8
PREDICT = 0.7


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    w = text.split()
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(0, len(w), size)] or [b""]


def spread(found: list, most: int = SPREAD) -> list:
    return found if len(found) <= most else [found[i * len(found) // most] for i in range(most)]


# The offsets that end the entropy tables of a trained dictionary.
TABLES_END = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def trained(samples: list[bytes], size: int, segment: int, seed: int, most: int = TRAIN) -> tuple[bytes, bytes] | None:
    """(entropy tables, content) of a dictionary trained on samples; None where there is too little of them."""
    import zstandard as z

    if len(samples) > most:
        samples = [samples[i] for i in np.sort(np.random.default_rng(seed).choice(len(samples), most, replace=False))]
    try:
        whole = z.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except z.ZstdError:
        return None
    at = whole.find(TABLES_END) + len(TABLES_END)
    return whole[:at], whole[at:]


def compressor(content: bytes):
    import zstandard as z

    how = z.ZstdCompressionParameters(
        window_log=17, chain_log=17, hash_log=16, search_log=4, min_match=3, target_length=32, strategy=z.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    words = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_FULLDICT)
    words.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=words, compression_params=how).compress


class Distance:
    """Windows' distances by two dictionaries, (tables, base, toxic part, ordinary part)."""

    def __init__(self, tables: bytes, base: bytes, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = (compressor(tables + own + base) for own in (toxic, ordinary))

    def of(self, found: list[bytes]) -> np.ndarray:
        toxic, ordinary = self.toxic, self.ordinary
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in found])


def features(s: np.ndarray, thresholds: list[int]) -> list[float]:
    over = [(s >= t).sum() for t in thresholds]
    return [s.mean(), np.log(len(s)), *(min(30 * x / len(s), 4) for x in over), *(x**0.5 for x in over), min(s.max(), 2 * thresholds[-1])]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights, the constant first; Newton's method."""
    x, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
    return w


def probability(x: np.ndarray, mean, scale, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - mean) / scale] @ weights, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, each: int = SPREAD) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(windows of each text, labels, how many labelled texts each stands for), in the order of the texts' hashes."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    texts = rows.groupBy("doc_id").agg(F.min("th").alias("th")).join(known, "doc_id").groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}  # one row a class
    order, windows_each = F.xxhash64("th", F.lit(4)), each
    chosen = texts.where("toxic = 1").orderBy(order, "th").limit(most).union(texts.where("toxic = 0").orderBy(order, "th").limit(most))

    def run(batches):
        for batch in slices(batches, column="text"):
            found = [spread(windows(t), windows_each) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["th", "toxic", "found"])

    text = F.coalesce("text", F.lit(""))
    # 2 * most rows at most: each has one id and one text, and repeated rows fall to one
    wanted = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th")).join(F.broadcast(chosen), ["doc_id", "th"]).dropDuplicates(["th"])
    got = wanted.select("th", "toxic", "text").mapInArrow(run, "th long, toxic int, found array<binary>").toArrow().sort_by("th")
    y = np.array(got.column("toxic").to_pylist(), int)
    stands_for = {c: sizes[c] / max(1, (y == c).sum()) for c in sizes}
    return got.column("found").to_pylist(), y, np.array([stands_for[c] for c in y])


def fit(found: list[list[bytes]], y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, parts: int = PARTS, train: int = TRAIN):
    """(dictionaries, thresholds, curve), or None without enough to learn from."""
    if min((y == 1).sum(), (y == 0).sum()) < LEAST:
        return None
    part = np.zeros(len(y), int)
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % parts
    base = trained([w for f, c in zip(found, y, strict=True) if not c for w in f], BASE, BASE_SEGMENT, 1, train)
    if base is None:
        return None
    tell: list[list[bytes]] = list(found)  # the windows of each text that are trained on
    best, least = None, np.inf
    for _ in range(rounds):
        own = []
        for p in range(parts + 1):  # the last has all parts
            both = [trained([w for i in np.flatnonzero((y == c) & (part != p)) for w in tell[i]], OWN, SEGMENT, 2 + c, train) for c in (1, 0)]
            own.append(None if None in both else (*base, both[0][1], both[1][1]))
        if None in own:
            break
        distances = [Distance(*x) for x in own[:parts]]
        s = [distances[p].of(f) for f, p in zip(found, part, strict=True)]
        plain = np.concatenate([x for x, c in zip(s, y, strict=True) if not c])
        thresholds = [max(1, int(np.quantile(plain, QUANTILES[0])))]
        for q in QUANTILES[1:]:
            thresholds.append(max(thresholds[-1] + 1, int(np.quantile(plain, q))))
        x = np.array([features(a, thresholds) for a in s])
        fitted = curve(x, y, weight)
        p = np.clip(probability(x, *fitted), 1e-6, 1 - 1e-6)
        loss = -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum()
        if loss < least:
            best, least = (own[parts], thresholds, fitted), loss
        low = (max(1, np.quantile(plain, TOLD_TOXIC)), np.quantile(plain, TOLD_ORDINARY))
        tell = [[w for w, d in zip(f, a, strict=True) if d >= low[1 - c]] for f, a, c in zip(found, s, y, strict=True)]
    return best


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return mean, scale, logistic((x - mean) / scale, y, weight)


_distances: dict[tuple, Distance] = {}


def shared_distance(dictionaries: tuple[bytes, ...]) -> Distance:
    """One for each worker, so that later tasks find it made."""
    if dictionaries not in _distances:
        _distances.clear()
        _distances[dictionaries] = Distance(*dictionaries)
    return _distances[dictionaries]


def scores(texts: list[bytes], model) -> np.ndarray:
    distance = shared_distance(model[0])
    return probability(np.array([features(distance.of(windows(t)), model[1]) for t in texts]), *model[2])


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, each: int = SPREAD, train: int = TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; the three bounds of what is learnt from are told above."""
    model = fit(*sample(docs, labels, most, each), train=train)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in slices(batches):
            got = scores(batch.column(1).cast(pa.binary()).to_pylist(), model) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "score"])

    scored = key_text(docs).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
