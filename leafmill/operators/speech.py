"""Paragraphs as what voices read: words, turns of dialogue, respelled words, and a chapter's segments with their pauses.

Each function takes one text and is linear in it; `F.pandas_udf`s at the end run them over columns.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators import reading, segment

# Marks of turns, openers of sentences, the stress mark, ends of sentences, styles of stress.
DASH, SENTENCE_OPENERS, ACUTE, SENTENCE_END = "—–―", ".!?…:«“„\"—–(", "́", ".!?…»\"”"
VOWELS = "аеёиоуыэюяАЕЁИОУЫЭЮЯaeiouyAEIOUY"
WORD = regex.compile(rf"\p{{L}}(?:[\p{{L}}{ACUTE}]|[-'’](?=\p{{L}}))*")
#: A dash between white space after punctuation: speech and the author's words take turns there.
TURN = regex.compile(rf"(?<=[,.!?…:;]\s+)[{DASH}-](?=\s)")
OPENING = regex.compile(rf"\s*(?:[{DASH}]|-(?= ))")
AFTER_NARRATION = regex.compile(rf"(?<=[.:]\s+)[{DASH}](?=\s+[\p{{Lu}}«“\"])")
QUOTED_START = regex.compile(r"\s*[«“„\"]")
ENTRY = regex.compile(r"\p{L}+(?:[-'’]\p{L}+)*")
STUTTER = regex.compile(r"(?i)(?<![\p{L}-])([бвгджзйклмнпрстфхцчшщbcdfghjklmnpqrstvwxz]{1,2})-\1")
FILLER = regex.compile(r"(?i)(?<![\p{L}-])(?:я-я|i-i|э-э+|э{2,}|эм+|хм+|um+|uh+|erm?)(?!\p{L})")
BROKEN, TRAILING = regex.compile(r"\p{L}\s*(?:…|\.{3})\s*\p{L}"), regex.compile(r"\p{L}\s*(?:…|\.{2,})[»”\"]?$")
SHOUT, CAPS, STARTLE = regex.compile(r"!\s*!"), regex.compile(r"(?<![\p{L}-])\p{Lu}{3,}(?![\p{L}-])"), regex.compile(r"\?\s*!|!\s*\?")


def words(text: str) -> list[tuple[str, int, str, bool]]:
    """(word, start, what stands before it, whether it opens a sentence)."""
    out, at = [], 0
    for m in WORD.finditer(text):
        gap = text[at : m.start()]
        out.append((m[0].replace(ACUTE, ""), m.start(), gap, not out or any(c in SENTENCE_OPENERS for c in gap)))
        at = m.end()
    return out


def in_turn(text: str, a: int, b: int) -> list[tuple[int, int, bool]]:
    """Speech from a on, then the author's words and speech by turns, up to b."""
    marks = [a - 1, *(m.start() for m in TURN.finditer(text) if a <= m.start() < b), b]
    return [(x + 1, y, k % 2 == 0) for k, (x, y) in enumerate(pairwise(marks))]


def _dashes(text: str) -> list[tuple[int, int, bool]] | None:
    if m := OPENING.match(text):
        return in_turn(text, m.end(), len(text))
    if not QUOTED_START.match(text) and (m := AFTER_NARRATION.search(text)):
        return [(0, m.start(), False), *in_turn(text, m.end(), len(text))]
    return None


def _quotes(text: str, opening: str, closing: str) -> list[tuple[int, int, bool]] | None:
    """Speech in quotes, with turns inside; a first quote without an end is speech to the end."""
    out, at, last = [], 0, 0
    for m in regex.finditer(f"{opening}[^{closing}]*{closing}", text):
        last = m.end()
        if reading.is_speech(text, m.start(), m.end() - 1):
            out += [(at, m.start(), False), *in_turn(text, m.start() + 1, m.end() - 1)]
            at = m.end()
    open_at = text.find(opening, last)
    if open_at >= 0 and not text[:open_at].strip():
        out += in_turn(text, open_at + 1, len(text))
        at = len(text)
    return [*out, (at, len(text), False)] if out else None


def dialogue_parts(text: str, language: str) -> list[tuple[int, int, bool]] | None:
    """Q1, Q2: (start, end, speech) of characters' lines and the author's words; None for plain narration."""
    found = _dashes(text) or _quotes(text, "«", "»") or _quotes(text, "“", "”")
    if found is None:
        return reading.quoted_parts(text, language) if language == "en" and '"' in text else None
    parts = [(*place, said) for a, b, said in found if (place := reading.trimmed(text, a, b))]
    return parts if any(said for *_, said in parts) else None


def attributes(text: str, line: tuple, author: tuple) -> bool:
    """Q14: whether the author's words go on the sentence of the line before them."""
    return text[author[0]].islower() or "," in text[max(0, line[1] - 1) : author[0]]


def leaves_quote_open(text: str) -> bool:
    """Q14: whether a paragraph opens a quote that the next one goes on with."""
    first = text.lstrip()[:1]
    if first == '"':
        return text.count('"') % 2 == 1
    return first in ("«", "“") and text.rfind(first) > text.rfind({"«": "»", "“": "”"}[first])


def sentence_tone(sentence: str, goes_on: bool) -> str | None:
    """Q13: the tone that a sentence shows by itself."""
    text = sentence.strip()
    if "!" in text:
        return "ANGRY" if SHOUT.search(text) or CAPS.search(text) else "SURPRISE" if STARTLE.search(text) else "EXCLAIM"
    unsure = [STUTTER, FILLER, BROKEN, *([TRAILING] if goes_on else [])]
    return "UNSURE" if any(p.search(text) for p in unsure) else None


def language_of(text: str, fallback: str) -> str:
    """The fallback unless the other script has four letters and more than twice as many."""
    cyrillic, latin = len(regex.findall("[Ѐ-ӿ]", text)), len(regex.findall("[A-Za-z]", text))
    other, own, name = (latin, cyrillic, "en") if fallback == "ru" else (cyrillic, latin, "ru")
    return name if other >= 4 and other > 2 * own else fallback


def main_language(paragraphs: list[str], fallback: str = "ru") -> str:
    """A7 for one chapter."""
    seen, cyrillic, latin = 0, 0, 0
    for p in paragraphs:
        cyrillic, latin, seen = cyrillic + len(regex.findall("[Ѐ-ӿ]", p)), latin + len(regex.findall("[A-Za-z]", p)), seen + len(p)
        if seen > 6000:
            break
    return fallback if not cyrillic + latin else "ru" if cyrillic >= latin else "en"


def _key(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


#: The pause after a chunk: (last of its part, last of the paragraph) and what else holds; the first that fits.
def _pause(chunk: str, last: bool, last_part: bool, heading: bool, author_next: bool) -> str:
    cases = [
        (last and last_part and heading, "TITLE"), (last and last_part, "PARAGRAPH"), (last and author_next, "TURN"),
        (chunk.rstrip()[-1:] in SENTENCE_END and chunk.strip() != "", "SENTENCE"), (last, "TURN"),
    ]
    return next((pause for holds, pause in cases if holds), "CLAUSE")


def chapter_segments(title: str | None, paragraphs: list[str], headings: set[int] = frozenset(), dialogue: bool = True, most: int = segment.CHUNK_CHARS) -> list[dict]:
    """K8: what is read of a chapter, in order: (paragraph, start, end, text, language, pause, role, tone).

    The title comes first unless the text begins with it; a table row is read by cells; characters' lines are segments of
    their own, of role SPEECH (who speaks is not told here), with the tone that each sentence shows.
    """
    main, out = main_language(paragraphs), []

    def add(paragraph, start, end, text, language, pause, role="NARRATOR", tone="NEUTRAL"):
        out.append({"paragraph": paragraph, "start": start, "end": end, "text": text, "language": language_of(text, language), "pause": pause, "role": role, "tone": tone})

    name, first = (title or "").strip(), next((p.strip() for p in paragraphs if p.strip()), "")
    if name and _key(name) != _key(first):
        add(-1, 0, len(name), name, main, "TITLE")
    for k, text in enumerate(paragraphs):
        if not text.strip():
            continue
        language, heading = language_of(text, main), k in headings
        if "\t" in text:
            cells, at = text.split("\t"), 0
            for c, cell in enumerate(cells):
                found = segment.chunks(cell, most)
                for j, (a, b, said) in enumerate(found):
                    add(k, at + a, at + b, said, language, "PARAGRAPH" if c == len(cells) - 1 and j == len(found) - 1 else "TURN")
                at += len(cell) + 1
            continue
        parts = dialogue_parts(text, language) if dialogue and not heading else None
        parts = parts or [(0, len(text), False)]
        for p, (x, y, speech) in enumerate(parts):
            found = segment.chunks(text[x:y], most)
            author_next = speech and p + 1 < len(parts) and not parts[p + 1][2] and text[parts[p + 1][0]].islower()
            for j, (a, b, said) in enumerate(found):
                last = j == len(found) - 1
                tone = (sentence_tone(said, not last) if speech else None) or "NEUTRAL"
                add(k, x + a, x + b, said, language, _pause(said, last, p == len(parts) - 1, heading, author_next), "SPEECH" if speech else "NARRATOR", tone)
    if out:
        out[-1]["pause"] = "CHAPTER_END"
    return out


def as_written(spoken: str, original: str) -> str:
    """Capitals as the book has them."""
    letters = [c for c in original if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return spoken.upper()
    return regex.sub(r"\p{L}", lambda m: m[0].upper(), spoken, count=1) if original[0].isupper() else spoken


def respelled(text: str, entries: dict[str, str], style: str = "plus") -> tuple[str, list[int]]:
    """Text with the entries' words as they are spoken, and for each character its place in the original."""
    shown = {"acute": rf"\1{ACUTE}", "none": r"\1", "plus": r"+\1"}[style]
    out, index, at = [], [], 0
    for m in ENTRY.finditer(text):
        spoken = entries.get(m[0].lower().replace("ё", "е").replace("+", ""))
        if spoken is None:
            continue
        new = regex.sub(rf"\+([{VOWELS}])", shown, as_written(spoken, m[0]))
        out += [text[at : m.start()], new]
        index += [*range(at, m.start()), *(m.start() + i * len(m[0]) // len(new) for i in range(len(new)))]
        at = m.end()
    return "".join([*out, text[at:]]), [*index, *range(at, len(text) + 1)]


def original_range(index: list[int], start: int, end: int) -> tuple[int, int]:
    """The first and last original place of a range of a respelled text."""
    inside = lambda i: index[min(max(i, 0), len(index) - 1)]
    return inside(start), max(inside(start), inside(end - 1))


def original_offset(source: str, a: int, b: int, spoken: int) -> int:
    """Where a place of the spoken text, its white space collapsed, is in source[a:b]."""
    units = [m.start() for m in regex.finditer(r"\s+|\S", source[a:b])] + [min(b, len(source)) - a]
    at = a + units[min(spoken, len(units) - 1)]
    return at + len(source[at:b]) - len(source[at:b].lstrip())


def placed_words(marks: list[tuple[int, int, int]], trimmed: int, rates: tuple[int, int], length: int, source: str, start: int, end: int, spoken: str) -> list[tuple[int, int, int]]:
    """An engine's word marks (frame, start, end) as frames of the output and places of the source, in order."""
    out = []
    for frame, a, b in marks:
        if 0 <= a < b <= len(spoken):
            x, y = original_offset(source, start, end, a), original_offset(source, start, end, b - 1) + 1
            if y > x:
                out.append((min(max(frame - trimmed, 0) * rates[1] // rates[0], length), x, y))
    return sorted(out, key=lambda m: m[0])


def word_target(text: str, offset: int) -> tuple[str, int, int, str] | None:
    """The word at a place, where it is, and its sentence."""
    if not text:
        return None
    inside = [m.span() for m in regex.finditer(r"(?:[\p{L}\p{N}]|(?<=\p{L})[-'’](?=\p{L}))+", text)]
    at = min(max(offset, 0), len(text) - 1)
    k = bisect_right([a for a, _ in inside], at) - 1
    a, b = next(((a, b) for a, b in inside[max(k, 0) : k + 1] if a <= at <= b), (at, at))
    found = segment.chunks(text)
    if not found:
        return None
    place = a if b == at and a < b else at
    chunk = next((c for c in found if c[0] <= place < c[1]), None) or min(found, key=lambda c: abs(c[0] - place))
    return text[a:b], a, b, chunk[2]


_SEGMENT = T.StructType([T.StructField(n, T.IntegerType() if n in ("paragraph", "start", "end") else T.StringType()) for n in ("paragraph", "start", "end", "text", "language", "pause", "role", "tone")])
_PART = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("speech", T.BooleanType())
_TOKEN = T.StructType().add("word", T.StringType()).add("start", T.IntegerType()).add("gap", T.StringType()).add("opens", T.BooleanType())


@F.pandas_udf(T.ArrayType(_SEGMENT))
def spoken_segments(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for part in segment.in_parts(batches, lambda row: 0 if row[1] is None else sum(len(x or "") for x in row[1])):
        yield pd.Series([chapter_segments(t, [] if p is None else [x or "" for x in p]) for t, p in part], dtype=object)


@F.pandas_udf(T.ArrayType(_PART))
def dialogue(texts: pd.Series, language: pd.Series) -> pd.Series:
    rows = [dialogue_parts(t or "", x or "") for t, x in zip(texts, language, strict=True)]
    return pd.Series([None if r is None else [{"start": a, "end": b, "speech": s} for a, b, s in r] for r in rows])


#: Characters of the texts whose words are held at once; a longer text goes alone.
WORDS_OF = 1 << 20


def _parts(texts: pd.Series, most: int) -> Iterator[pd.Series]:
    """The series cut into parts of at most so many characters, one text at least."""
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t or "") > most:
            yield texts.iloc[at:k]
            at, size = k, 0
        size += len(t or "")
    yield texts.iloc[at:]


@F.pandas_udf(T.ArrayType(_TOKEN))
def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        for part in _parts(texts, WORDS_OF):
            yield part.map(lambda t: [dict(zip(("word", "start", "gap", "opens"), w, strict=True)) for w in words(t or "")])
