"""Reading aloud: pronunciations, voices, tones, positions among segments, dialogue and sound."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leafmill.functions import text as tx

# Rate, pitch and gain (dB) of a tone at full strength.
TONES = {
    "NEUTRAL": (1.0, 1.0, 0.0), "EXCLAIM": (1.05, 1.04, 2.0), "ANGRY": (1.1, 1.07, 5.0), "COLD": (0.9, 0.94, -1.0), "UNSURE": (0.87, 0.98, -2.0), "QUIET": (0.95, 0.98, -3.0),
    "WHISPER": (0.92, 0.96, -6.0), "SAD": (0.87, 0.94, -2.5), "JOY": (1.07, 1.07, 1.5), "FEAR": (1.1, 1.08, -1.0), "TENDER": (0.92, 1.03, -2.0), "SURPRISE": (1.0, 1.09, 1.5),
}
DASHES, QUICK = "—–", (100, 30, 120, 25)


def tone_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in TONES.items()], "tone string, rate double, pitch double, db double")


def prosody(lines: DataFrame, strength: float) -> DataFrame:
    """V7: lines with rate, pitch and gain of their tone; the table has twelve rows."""
    at = lambda c: 1 + (F.col(c) - 1) * strength
    gain = F.pow(F.lit(10.0), F.col("db") * strength / 20)
    joined = lines.join(F.broadcast(tone_table(lines.sparkSession)), "tone", "left")
    return joined.select(*lines.columns, F.coalesce(at("rate"), F.lit(1.0)).alias("rate"), F.coalesce(at("pitch"), F.lit(1.0)).alias("pitch"), F.coalesce(gain, F.lit(1.0)).alias("gain"))


def pronounced(words: DataFrame, own: DataFrame, shared: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each word with how it is said: the book's entry over the shared one over the lexicon's; null for none."""
    keyed = words.withColumn("key", tx.word_key(F.col("word")))
    for name, entries in (("own", own), ("shared", shared), ("lexicon", lexicon)):
        table = entries.groupBy(tx.word_key(F.col("word")).alias("key")).agg(F.max("spoken").alias(name))
        keyed = keyed.join(table, "key", "left")
    return keyed.select(*words.columns, F.coalesce("own", "shared", "lexicon").alias("spoken"))


def segment_at(segments: DataFrame, chapter: int, paragraph: int, offset: int) -> DataFrame:
    """The first segment at or after a place."""
    c, p = F.col("chapter"), F.col("paragraph")
    after = (c > chapter) | ((c == chapter) & ((p > paragraph) | ((p == paragraph) & (F.col("end") > offset))))
    return segments.where(after).agg(F.min("index").alias("index"))


def merged_positions(books: DataFrame, positions: DataFrame) -> DataFrame:
    """Books with their stored positions; chapters clamped, the later of two opening times."""
    joined = books.join(positions, "book", "left")
    chapter = F.greatest(F.lit(0), F.least(F.coalesce("chapter", "current_chapter"), F.col("chapters") - 1))
    return joined.select("book", chapter.alias("chapter"), F.coalesce("progress", F.lit(0.0)).alias("progress"), F.greatest("last_opened", F.coalesce("opened", F.lit(0))).alias("opened"))


def version_key(version: Column) -> Column:
    """A dotted version as numbers that sort."""
    return F.transform(F.split(version, "\\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def backward_fill(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row with the first value at or after it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("ahead", F.first(value, ignorenulls=True).over(w))


def is_speech(text: str, a: int, b: int) -> bool:
    inner = text[a + 1 : b].strip()
    if not any(c.isalpha() for c in inner):
        return False
    before, after = text[:a].rstrip(), text[b + 1 :].lstrip()
    return inner[-1] in ".!?…,—–" or not before or before[-1] in ":" + DASHES or bool(regex.match(r"[,!?…]+\s*[—–-]", after))


def trimmed(text: str, a: int, b: int) -> tuple[int, int] | None:
    part = text[a:b]
    a += len(part) - len(regex.sub(r"^[\s—–\-,.;:!?…]+", "", part))
    b -= len(part) - len(regex.sub(r"[\s—–\-]+$", "", part))
    return (a, b) if a < b and any(c.isalnum() for c in text[a:b]) else None


def quoted_parts(text: str, language: str = "en") -> list[tuple[int, int, bool]] | None:
    """Q1, Q2 for quotes: (start, end, speech) of what is said and what is told; None without speech."""
    pairs: list[tuple[int, int]] = []
    for opening, closing in (("«", "»"), ("“", "”")):
        pairs = pairs or [(m.start(), m.end() - 1) for m in regex.finditer(f"{opening}[^{closing}]*{closing}", text)]
    if not pairs and language == "en":
        marks = [i for i, c in enumerate(text) if c == '"']
        pairs = list(zip(marks[::2], marks[1::2], strict=False))
        if len(marks) % 2 and not text[: marks[0]].strip():
            pairs.append((marks[-1], len(text)))
    out, at = [], 0
    for a, b in pairs:
        if b == len(text) or is_speech(text, a, b):
            out += [(at, a, False), (a + 1, b, True)]
            at = b + 1
    out = [(*place, said) for x, y, said in [*out, (at, len(text), False)] if (place := trimmed(text, x, y))]
    return out if any(said for *_, said in out) else None


def quick_start(text: str) -> list[str]:
    """K9: a long first sentence as its first clause and the rest."""
    least, low, high, tail = QUICK
    if len(text) < least:
        return [text]
    cut = next((i for i in range(low, min(high, len(text) - tail) + 1) if text[i] == " " and text[i - 1] in ",;:—–)"), None)
    return [text] if cut is None else [text[:cut], text[cut + 1 :]]


def loudness(samples: np.ndarray, rate: int, floor: float = 0.01) -> float:
    """Root mean square of the 20 ms frames that are louder than `floor`, the last one as long as it is; 0 in silence."""
    size = max(1, rate // 50)
    starts = np.arange(0, len(samples), size)
    if not len(starts):
        return 0.0
    energy = np.add.reduceat(samples.astype(np.float64) ** 2, starts)
    counts = np.minimum(size, len(samples) - starts)
    voiced = np.sqrt(energy / counts) > floor
    return float(np.sqrt(energy[voiced].sum() / counts[voiced].sum())) if voiced.any() else 0.0


@F.pandas_udf(T.DoubleType())
def speech_level(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([loudness(np.asarray(s, np.float32), int(r)) for s, r in zip(samples, rate, strict=True)])
