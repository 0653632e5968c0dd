"""Text into paragraphs, chapters and spoken chunks; folds whose state is one text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import CHAPTER, HEADING_CHARS

# Sizes and marks of the segmentation rules.
CHAPTER_CHARS, FLUSH_CHARS, INDENT_CHARS, SHORT_LINE = 30_000, 1500, 80, 120
CHUNK_CHARS, CLAUSE, BULLETS, ENDS = 260, ",;:—–)", "•◦▪■●", ".!?…"
ABBREVIATIONS = set("г гг в вв д е к н п т см ср стр рис ул им проф акад тов др пр тыс руб коп млн млрд напр ок".split())
SPACE = regex.compile("[\\t\\n\\r  -​ ]+")
HEADING = regex.compile(CHAPTER)
TURN = regex.compile(r"(?<=[.!?…][»”\"]?)\s+(?=[—–]\s*\p{Lu})")
SENTENCE = regex.compile(r"(?:[.!?…]+[»”\"’')\]]*)(\s+)(?=[^\p{Ll}\s,;:—–-])|\n+")


def tidy(text: str) -> str:
    return SPACE.sub(" ", text.replace("­", "")).strip(" ")


def _begins(line: str, raw: str, held: int, before: str) -> bool:
    """Whether a line starts a paragraph of its own."""
    indented = raw.startswith(("    ", "\t")) and held > INDENT_CHARS
    after_end = 0 < len(before) < SHORT_LINE and before[-1] in ENDS and line[0].isupper()
    return line[0] in "—–" or indented or after_end


def paragraphs(text: str) -> list[str]:
    """K1: lines joined into paragraphs; hyphens at line ends are undone, chapter headings stand alone."""
    out, held, before = [], "", ""

    def close():
        nonlocal held
        if value := tidy(held):
            out.append(value)
        held = ""

    for raw in regex.split("\r\n|\r|\n", text):
        line = raw.strip()
        if not line or HEADING.fullmatch(line):
            close()
            out += [line] if line else []
            before = ""
            continue
        if held and _begins(line, raw, len(held), before):
            close()
        if held.endswith("-") and line[0].islower():
            held = held[:-1] + line
        else:
            held = f"{held} {line}" if held else line
        if len(held) > FLUSH_CHARS and line[-1] in ENDS:
            close()
        before = line
    close()
    return out


def chapters(title: str, texts: list[str], most: int = CHAPTER_CHARS) -> list[tuple[str, list[str]]]:
    """K3: headings part chapters; before the first one, so does size."""
    done: list[tuple[str, list[str]]] = []
    name, held, size, headed = title, [], 0, False
    for text in filter(None, map(tidy, texts)):
        heading = len(text) <= HEADING_CHARS and HEADING.fullmatch(text.strip())
        if heading or (not headed and size >= most):
            if held:
                done.append((name, held))
            name = text if heading else f"Часть {len(done) + 1}"
            held, size, headed = [], 0, headed or bool(heading)
        if not heading:
            held.append(text)
            size += len(text)
    return [*done, (name, held)] if held else done


def parts(title: str, texts: list[str], most: int = CHAPTER_CHARS) -> list[tuple[str, list[str]]]:
    """K4: a chapter cut at the paragraph that follows `most` characters."""
    if sum(map(len, texts)) <= most:
        return [(title, texts)]
    done: list[list[str]] = [[]]
    size = 0
    for text in texts:
        if done[-1] and size >= most:
            done.append([])
            size = 0
        done[-1].append(text)
        size += len(text)
    return [(title if k == 1 else f"Часть {k}", held) for k, held in enumerate(done, 1)]


def _abbreviated(text: str, at: int) -> bool:
    """K7: whether the dot before a boundary belongs to an initial, an abbreviation or a number."""
    look = 16
    head, tail = text[max(0, at - look) : at].rstrip(), text[at : at + look].lstrip()
    while (not head and at > look) or (not tail and at + look < len(text)):  # a long stretch of white space
        look *= 4
        head, tail = text[max(0, at - look) : at].rstrip(), text[at : at + look].lstrip()
    if not tail or not head.endswith(".") or len(head) < 2:
        return False
    word = regex.search(r"\p{L}{0,4}$", head[-5:-1])[0]
    return tail[0].isdigit() or (0 < len(word) <= 3 and (word.isupper() or word.lower() in ABBREVIATIONS))


def chunks(text: str, most: int = CHUNK_CHARS) -> list[tuple[int, int, str]]:
    """K6: (start, end, spoken) of sentences, long ones cut after a clause mark, else between words, else hard."""
    bounds = {0, len(text)} | {m.end() for m in SENTENCE.finditer(text)} | {m.end() for m in TURN.finditer(text)}
    marks = sorted(b for b in bounds if not _abbreviated(text, b))
    out = []

    def add(a: int, b: int):
        inner = text[a:b]
        a += len(inner) - len(inner.lstrip(" \t\n\r\f\v " + BULLETS))
        b -= len(inner) - len(inner.rstrip())
        if a < b:
            out.append((a, b, regex.sub(r"[\s\p{Z}]+", " ", text[a:b])))

    for a, b in zip(marks, marks[1:], strict=False):
        a += len(text[a:b]) - len(text[a:b].lstrip())
        while b - a > most:
            span = range(a + most, a + most // 2 - 1, -1)
            clause = (i for i in span if i < b and text[i].isspace() and text[i - 1] in CLAUSE)
            between = (i for i in span if text[i - 1].isspace())
            cut = next(clause, None) or next(between, None) or a + most
            add(a, cut)
            a = cut + len(text[cut:b]) - len(text[cut:b].lstrip())
        add(a, b)
    return out


#: Characters of texts whose results are held at once; a longer text goes alone.
HELD = 1 << 20


def in_parts(batches: Iterator, size, most: int = HELD) -> Iterator[list[tuple]]:
    """The rows of batches of columns, in order, in parts of at most so many characters by size(row), one row at least."""
    for columns in batches:
        part, held = [], 0
        for row in zip(*columns, strict=True):
            n = size(row)
            if part and held + n > most:
                yield part
                part, held = [], 0
            part.append(row)
            held += n
        yield part


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_paragraphs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: paragraphs(t or ""))


@F.pandas_udf(T.ArrayType(T.StructType().add("title", T.StringType()).add("paragraphs", T.ArrayType(T.StringType()))))
def plain_chapters(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for part in in_parts(batches, lambda row: len(row[1] or "")):
        yield pd.Series([[{"title": n, "paragraphs": p} for n, p in chapters(t or "", paragraphs(x or ""))] for t, x in part], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("text", T.StringType())))
def spoken_chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in in_parts(((texts,) for texts in batches), lambda row: len(row[0] or "")):
        yield pd.Series([[{"start": a, "end": b, "text": x} for a, b, x in chunks(t or "")] for (t,) in part], dtype=object)
