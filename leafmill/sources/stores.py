"""Small stores as tables: a library of JSON documents, annotations, choices, release feeds, wiki markup and sound files."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAPTER = "struct<title: string, paragraphs: array<string>, source_url: string, next_url: string>"
LIBRARY = f"book_id string, title string, author string, format string, source string, added_at long, last_opened_at long, current_chapter int, chapter_progress float, warnings array<string>, chapters array<{CHAPTER}>, _corrupt_record string"
ANNOTATIONS = "array<struct<id: string, kind: string, chapter: int, paragraph: int, start: int, end: int, text: string, note: string, created_at: long>>"


def library(spark: SparkSession, path: str, positions: DataFrame | None = None) -> DataFrame:
    """The documents below a path, latest first; a file that is no such document is skipped."""
    rows = spark.read.schema(LIBRARY).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    rows = rows.where("_corrupt_record is null and size(chapters) > 0").drop("_corrupt_record")
    if positions is not None:
        newer = positions.groupBy("book_id").agg(F.max_by(F.struct("chapter", "progress", "opened_at"), "opened_at").alias("p"))
        last = F.size("chapters") - 1
        rows = rows.join(newer, "book_id", "left").withColumns(
            {
                "current_chapter": F.greatest(F.lit(0), F.least(F.coalesce("p.chapter", "current_chapter", F.lit(0)), last)),
                "chapter_progress": F.coalesce("p.progress", "chapter_progress"),
                "last_opened_at": F.greatest("last_opened_at", F.coalesce("p.opened_at", F.lit(0))),
            }
        )
        rows = rows.drop("p")
    return rows.orderBy(F.greatest(F.coalesce("last_opened_at", F.lit(0)), F.coalesce("added_at", F.lit(0))).desc(), "book_id")


def save(books: DataFrame, path: str) -> None:
    """Documents, each in the folder of its id; saving again replaces those and no others."""
    stored = books.where(F.size("chapters") > 0).withColumn("id", F.col("book_id"))
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").json(path)


def annotations(rows: DataFrame) -> DataFrame:
    """(book_id, annotation fields) of JSON arrays, in reading order; kinds that are not known go."""
    marks = rows.select("book_id", F.explode(F.from_json("json", ANNOTATIONS)).alias("a")).select("book_id", "a.*")
    return marks.where(F.col("kind").isin("BOOKMARK", "HIGHLIGHT")).orderBy("book_id", "chapter", "paragraph", "start")


def choices(json: Column) -> Column:
    """A map of names to f or m; other values go."""
    return F.map_filter(F.from_json(json, "map<string, string>"), lambda k, v: v.isin("f", "m"))


RELEASES = "array<struct<draft: boolean, prerelease: boolean, assets: array<struct<name: string, size: long, digest: string, browser_download_url: string>>>>"


def newest_release(feeds: DataFrame, name_pattern: str) -> DataFrame:
    """The asset with the largest number in its name, of releases that are out; https only, digest valid or none."""
    release = feeds.select(F.explode(F.from_json("json", RELEASES)).alias("r")).where("not coalesce(r.draft, false) and not coalesce(r.prerelease, false)")
    asset = release.select(F.explode("r.assets").alias("a")).select("a.*", F.regexp_extract("a.name", name_pattern, 1).try_cast("long").alias("version"))
    fits = asset.where("version is not null and browser_download_url like 'https://%' and (digest is null or digest rlike '^sha256:[0-9a-f]{64}$')")
    return fits.orderBy(F.desc("version"), "name").limit(1)


_WIKI = [
    (regex.compile(r"(?s)<!--.*?-->|<ref[^>]*/>|<ref.*?</ref>|<(?:gallery|math|timeline).*?</(?:gallery|math|timeline)>"), ""),
    (regex.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (regex.compile(r"\[https?://\S+\s*([^\]]*)\]"), r"\1"),
    (regex.compile(r"'{2,}|<[^>]+>|^=+.*=+$|^[*#:;]+", regex.MULTILINE), ""),
]
_TEMPLATE = regex.compile(r"\{\{[^{}]*\}\}|\{\|[^{}]*\|\}")


def wiki_paragraphs(text: str) -> list[str]:
    """Markup gone, templates from the innermost on; paragraphs with a word of three letters."""
    while (less := _TEMPLATE.sub("", text)) != text:
        text = less
    for pattern, by in _WIKI:
        text = pattern.sub(by, text)
    lines = (regex.sub(r"\s+", " ", x).strip() for x in text.split("\n"))
    return [x for x in lines if regex.search(r"\p{L}{3}", x)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def wiki_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: wiki_paragraphs(t or ""))


def wav(content: bytes) -> tuple[int, np.ndarray] | None:
    """Rate and samples of a RIFF file, channels averaged; None for what is none."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, kind, data = 12, None, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind = [int.from_bytes(body[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16))]
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if kind is None:
        return None
    code, channels, rate, bits = kind
    step = bits // 8 * channels
    data = data[: len(data) // step * step]
    if code == 3:
        samples = np.frombuffer(data, "<f4")
    elif bits == 8:
        samples = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        samples = wide.view("<i4").ravel() / np.float32(1 << 31)
    else:
        samples = np.frombuffer(data, f"<i{bits // 8}") / np.float32(1 << (bits - 1))
    return rate, samples.reshape(-1, channels).mean(axis=1).astype(np.float32)


_SOUND = T.StructType().add("rate", T.IntegerType()).add("samples", T.ArrayType(T.FloatType()))


@F.pandas_udf(_SOUND)
def read_wav(content: pd.Series) -> pd.DataFrame:
    found = [wav(bytes(c)) if c is not None else None for c in content]
    return pd.DataFrame({"rate": pd.Series([f and f[0] for f in found], dtype="Int32"), "samples": [None if f is None else f[1] for f in found]})


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A corpus manifest, tabs between columns and their names in the first line; blank lines say nothing."""
    return spark.read.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
