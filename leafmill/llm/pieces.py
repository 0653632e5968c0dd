"""Subword pieces of a merge-type (BPE) sentencepiece model, found in one pass over a word's prefixes.

For every prefix of a word the encoding's last piece is unique. An automaton lists the pieces that end at a place,
longest first; the piece is the prefix's last one if it stands at the start or may follow the last piece of what comes
before it (`compatible`). The ids are then read backwards from the whole word's last piece.

Defined cases: a null or empty text has the end id alone; characters without a piece become byte pieces; bytes that are
no UTF-8 decode to U+FFFD; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import codecs
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import key_text, slices

codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
SPACE = "▁"
#: Words whose ids a worker keeps, their bytes, and pairs of pieces whose verdict it keeps.
CACHE_WORDS, CACHE_BYTES, CACHE_PAIRS = 700_000, 64 << 20, 700_000
#: What a normalizer would change: a ligature, an enclosed and a wide letter, two spaces, a tab.
PROBE = "ﬁ ①  x\tＡ é"
_UNITS = re.compile(" +[^ \n]*|\n[^ \n]*")


class Pieces:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("the model's normalizer changes texts, which is not known here")
        n = model.get_piece_size()
        self.end = model.eos_id()
        self.byte = [0] * 256
        self.surface = [b""] * n
        self.ids, self.rank, self.size = {}, {}, [0] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value], self.surface[i] = i, bytes([value])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not (model.is_control(i) or model.is_unused(i)):
                self.ids[piece], self.rank[i], self.size[i] = i, -model.get_score(i), len(piece)
                self.surface[i] = piece.replace(SPACE, " ").encode()
        self.known = {p for p in self.ids if len(p) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self._halve(piece, i):
                automaton.add_word(piece, (i, len(piece)))
        automaton.make_automaton()
        self.automaton = automaton
        self.pairs: dict[int, bool] = {}
        self.joined = {(a, b): self.ids[p] for p in self.ids for k in range(1, len(p)) if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None}
        #: Words' ids, in two generations: when the younger one is full it becomes the older, and words in use come back.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        #: Two characters that stand together in some piece; where two others meet, no piece goes over the seam.
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.single = {c: array("I", [self.ids[c]]).tobytes() for c in self.known}
        self.end_bytes = array("I", [self.end]).tobytes()
        self.strange = re.compile(f"[^{re.escape(''.join(self.known))}]").search

    def _halve(self, piece: str, i: int) -> bool:
        """Notes the two pieces whose merge makes `piece`; False if merging its characters never makes it."""
        parts = list(piece)
        while len(parts) > 1:
            best = min(((self.rank[m], k) for k in range(len(parts) - 1) if (m := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return False
            k = best[1]
            if len(parts) == 2:
                self.halves[i] = (self.ids[parts[0]], self.ids[parts[1]])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of piece a, then b, is encoded as just these two.

        While their characters merge, what borders the seam is always a right end of a and a left end of b. They would
        merge with each other if that came before the merge that takes either into its own larger piece; of equal
        merges the left one comes first.
        """
        x, y, x_goes, y_goes = a, b, np.inf, np.inf
        rank, halves = self.rank, self.halves
        while True:
            both = self.joined.get((x, y))
            if both is not None and rank[both] < x_goes and rank[both] <= y_goes:
                return False
            over_x, over_y = halves.get(x), halves.get(y)
            if over_x is None and over_y is None:
                return True
            # the seam's neighbours just before the later of the two was made
            if over_y is None or (over_x is not None and rank[x] > rank[y]):
                x, x_goes = over_x[1], rank[x]
            else:
                y, y_goes = over_y[0], rank[y]

    def _merge(self, word: str) -> list[int]:
        n = len(word)
        last, pairs, get = [-1] * (n + 1), self.pairs, self.pairs.get
        for end, (i, length) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            if start := end - length:
                pair = last[start] << 20 | i
                fits = get(pair)
                if fits is None:
                    fits = pairs[pair] = self.compatible(last[start], i)
                if not fits:
                    continue
            last[end] = i
        out, size = [], self.size
        while n:
            out.append(last[n])
            n -= size[last[n]]
        out.reverse()
        return out

    def word(self, word: str) -> bytes:
        """Ids (native 32-bit numbers) of a word, spaces before it included as SPACE."""
        if self.strange(word):
            ids, at = [], 0
            for k, c in enumerate(word):
                if c not in self.known:
                    ids += self._merge(word[at:k]) + [self.byte[x] for x in c.encode()]
                    at = k + 1
            ids += self._merge(word[at:])
        else:
            ids = self._merge(word)
        return array("I", ids).tobytes()

    def _new(self, w: str) -> bytes:
        """Ids of a word that the younger generation hasn't, by those of the word before its last mark if that stands alone."""
        found = self.older.get(w)
        if found is not None:
            return found
        if w[-2:] not in self.inside and len(w) > 1 and (last := self.single.get(w[-1])) is not None:
            base = self.kept.get(w[:-1]) or self.older.get(w[:-1])
            if base is not None:
                return base + last
        return self.word(w if w[:1] in ("\n", SPACE) else SPACE + w)

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers, the end id included. No piece joins a word to the next."""
        if not text:
            return self.end_bytes
        text = text.replace(SPACE, " ")
        # a word has one space before it, unless it begins with a line feed; more spaces stand as SPACE
        if "  " in text or text[0] == " " or " \n" in text:
            words = [u[1:] if u[0] == " " and u[1:2] != " " else u.replace(" ", SPACE) for u in _UNITS.findall(" " + text)]
        else:
            words = text.replace("\n", " \n").split(" ")
        if len(self.kept) > CACHE_WORDS // 2 or self.held > CACHE_BYTES // 2:
            self.older, self.kept, self.held = self.kept, {}, 0
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        kept = self.kept
        for w in set(words).difference(kept):
            kept[w] = self._new(w)
            self.held += len(w) + len(kept[w])
        found = list(map(kept.__getitem__, words))
        found.append(self.end_bytes)
        return b"".join(found)

    def decode(self, ids) -> bytes:
        """UTF-8 text of ids: byte pieces joined, one leading space (the encoder's own) dropped."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids])
        if self.rank.get(next((i for i in ids if surface[i]), -1)) is not None:
            out = out.removeprefix(b" ")
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode(errors="each-byte").encode()
        return out


_models: dict[str, Pieces] = {}


def _model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, the end id last."""

    def run(batches):
        for batch in slices(batches, 4 << 20):
            parts = [_model(model).encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return key_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded, which has ids, with the text that they stand for."""
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    at = encoded.columns.index("ids")

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                texts = _texts(_model(model), batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, f"{schema}, text string")


def _texts(model: Pieces, lists) -> list[bytes]:
    values = lists.flatten().to_pylist()
    sizes = np.diff(np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1 + lists.offset)[lists.offset :])
    ends = np.cumsum(sizes)
    return [model.decode(values[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows with ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
