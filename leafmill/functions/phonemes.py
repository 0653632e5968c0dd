"""Russian letters to phonemes, and words to the pieces of a vocabulary."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are not known, plain forms of signs, marks that part words, sounds of letters.
# A class of several ranges took Java 75 ns a character on one thread and 533 on each of six (Latin text), a list of single
# letters and a look behind what it leaves took 10 on both.
UNKNOWN = f"[^{ascii_letters}ÄÖäö'+ ,.?!;:\"()\\-](?<![А-я]|Ё|ё)"
PLAIN = dict.fromkeys("«»„“”", '"') | dict.fromkeys("–—‒", "-") | dict.fromkeys("’`", "'") | {"…": "..."}
SEPARATORS = regex.compile(r'(\.\.\.|- |[ ,.?!;:"()])')
HARD = dict(zip("бвгГдзклмнпрстфх", "b v g g d z k l m n p r s t f h".split(), strict=True))
CONSONANTS = {"ж": "zh", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sch", "й": "j"}
SOUNDS = {"а": "a", "я": "a", "у": "u", "ю": "u", "о": "o", "ё": "o", "э": "e", "е": "e", "и": "i", "ы": "y"}
SOFTENING, IOTATED, AFTER = set("яёюиье"), set("яюеё"), set("#ъьаяоёуюэеиы-")
SILENT = set("#+-ьъ$")


def sanitize(text: Column) -> Column:
    """Only characters that the letter rules and the marks know."""
    for sign, plain in PLAIN.items():
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(text, UNKNOWN, " "), "  +", " "))


def pieces_of(text: str) -> list[str]:
    """The text between marks, and the marks."""
    return SEPARATORS.split(text)


def phonemes(word: str) -> str:
    """Z3: the phonemes of a word, the stressed vowel marked 1; a plus stands before it."""
    letters = [(m[2], int(bool(m[1]))) for m in regex.finditer(r"(\+?)([^+])", f"#{word}#")]
    out = []
    for (before, _), (letter, stress), (after, _) in zip([("", 0), *letters], letters, [*letters[1:], ("", 0)], strict=False):
        if letter in HARD:
            out.append(HARD[letter] + ("j" if after in SOFTENING else ""))
        elif letter in CONSONANTS:
            out.append(CONSONANTS[letter])
        elif letter in SOUNDS:
            out += ["j"] * (letter in IOTATED and before in AFTER) + [f"{SOUNDS[letter]}{stress}"]
        elif letter not in SILENT:
            out.append(letter)
    return " ".join(out)


def spoken_word(word: str, dictionary: Callable[[str], str | None], stress: Callable[[str], str | None]) -> str:
    """A word's phonemes from the dictionary; else by the reader's stress, else by the lexicon's."""
    known = dictionary(word)
    if known is not None:
        return known
    return phonemes(word if "+" in word else stress(word) or word)


class WordPieces:
    """Words as the longest pieces of a vocabulary, later ones marked ##."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    @classmethod
    def load(cls, lines: list[str]) -> WordPieces:
        return cls({line.rstrip(): k for k, line in enumerate(lines)})

    @staticmethod
    def words(text: str) -> list[str]:
        """Spaces part words; a punctuation mark is a word; control characters are dropped."""
        text = regex.sub(r"[\t\n\r\p{Zs}]", " ", text.replace("\0", "").replace("�", ""))
        return regex.findall(r"[!-/:-@\[-`{-~\p{P}]|[^ !-/:-@\[-`{-~\p{P}]+", regex.sub(r"\p{C}", "", text))

    def pieces(self, word: str) -> list[str]:
        if len(word) > 100:
            return ["[UNK]"]
        out, at = [], 0
        while at < len(word):
            ends = range(len(word), at, -1)
            end = next((e for e in ends if ("##" if at else "") + word[at:e] in self.vocabulary), None)
            if end is None:
                return ["[UNK]"]
            out.append(("##" if at else "") + word[at:end])
            at = end
        return out

    def encode(self, text: str) -> list[tuple[str, int]]:
        found = ["[CLS]", *(p for w in self.words(text) for p in self.pieces(w)), "[SEP]"]
        return [(p, self.vocabulary[p]) for p in found]



@F.pandas_udf(T.StringType())
def phonemes_of(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else phonemes(w))
