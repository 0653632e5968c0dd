"""Best-fit packing planned on a histogram of lengths.

`pieces` turns each document into token pieces; `plan` places *counts* of equal lengths by best fit, largest first;
`pack` gives each piece the slot with its rank among the pieces of its length. The driver sees one count per length
(at most `capacity` numbers) and the plan's slot ranges, whose number depends on `capacity` alone.

Defined cases: a null or empty text is the end id alone; repeated rows are packed once per row; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.common import cut, key_text, slices

CAPACITY, END_ID = 1024, 2
#: Words whose ids a worker keeps, and their bytes.
CACHE_WORDS, CACHE_BYTES = 800_000, 64 << 20


def _tangled(text: str, words: list[str]) -> bool:
    """Whether text has white space besides lone spaces and line feeds between words."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or len(text.split()) != len(words)


class WordIds:
    """ids of whole texts by a byte-level BPE file of `tokenizers`, with the ids of words kept.

    The vocabulary's pattern never joins a word to what precedes a lone space or line feed, so a text without other
    white space is the sequence of its words; any other text, and one with a special token, goes through the library
    whole. New words are encoded
    from the same file's vocabulary by tiktoken, which has less to do for each.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # byte-level vocabularies write a byte as itself where printable, else as the next letter from U+0100
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = tuple(special)
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.word = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kept: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        kept, out = self.kept, []
        for text in texts:
            # a kept word has a space before it unless it begins with a line feed
            words = text.replace("\n", " \n").split(" ")
            if _tangled(text, words) or any(token in text for token in self.special):
                out.append(self._whole(text))
                continue
            first = array("I", self.word(words[0])).tobytes()
            try:
                out.append(first + b"".join([kept[w] for w in words[1:]]))
            except KeyError:
                if len(kept) > CACHE_WORDS or self.held > CACHE_BYTES:
                    kept.clear()
                    self.held = 0
                for w in words[1:]:
                    if w not in kept:
                        kept[w] = array("I", self.word(w if w[0] == "\n" else " " + w)).tobytes()
                        self.held += len(w) + len(kept[w])
                out.append(first + b"".join([kept[w] for w in words[1:]]))
        return out


_encoders: dict[str, WordIds] = {}


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, and before them the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), and the piece's ids if asked for."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordIds(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 4 << 20):
            ids = _encoders[tokenizer].encode(batch.column(1).to_pylist())
            rows, content = [], []
            for k, part in enumerate(ids):
                part += end
                for j, (s, n) in enumerate(cut_pieces(len(part) // 4, capacity)):
                    piece = part[4 * s : 4 * (s + n)]
                    rows.append((k, j, s, n, zlib.crc32(piece)))
                    if with_ids:
                        content.append(np.frombuffer(piece, "<u4"))
            k, *cols = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            got = [batch.column(0).take(pa.array(k)), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])]
            if with_ids:
                got.append(pa.array(content, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(got, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return key_text(docs).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts. Rows (length, first, last, sequence, each, offset).

    The pieces of `length` with ranks first..last-1 go to sequences from `sequence` on, `each` to a sequence, the first
    of them at `offset`. Groups of sequences filled alike are kept as one (room, first sequence, number).
    """
    rows, groups, sequences = [], {}, 0  # groups: room -> [(first sequence, number)]
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = next((r for r in range(length, capacity + 1) if groups.get(r)), None)
            if room is None:
                each = capacity // length
                groups.setdefault(capacity, []).append((sequences, number := -(-left // each)))
                sequences += number
                continue
            each, (first, number) = room // length, groups[room].pop()
            full = min(number, left // each)
            for k, here, base in ((full, each, first), (int(number > full and 0 < left - full * each), left - full * each, first + full)):
                if k and here:
                    here = min(here, each)
                    rows.append((length, rank, rank + k * here, base, here, capacity - room))
                    groups.setdefault(room - here * length, []).append((base, k))
                    rank, left = rank + k * here, left - k * here
                    number, first = number - k, base + k
            if number:
                groups.setdefault(room, []).append((first, number))
    return rows


def numbered(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts with _task and _rank: a piece's place among those of its length in its task.

    A length's pieces are thus ranked where they are made, however many they are, and whatever rows are alike.
    """
    names, at = parts.columns, parts.columns.index("length")

    def run(batches):
        from pyspark import TaskContext

        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column(at).to_numpy()
            order = np.argsort(length, kind="stable")
            sizes = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(seen, sizes)
            seen += sizes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), task, np.int32)), pa.array(rank)], names=[*names, "_task", "_rank"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in parts.dtypes), "_task int, _rank long"])
    return parts.mapInArrow(run, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts, which has `length`, with sequence_id and offset."""
    spark = parts.sparkSession
    ranked = cut(numbered(parts, capacity), "pieces")
    by_task = ranked.groupBy("length", "_task").agg(F.count("*").alias("n"))
    base = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each length and task: small, but it grows with the tasks, so the engine chooses how to join it
    before = by_task.withColumn("_before", F.coalesce(F.sum("n").over(base), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = plan(counts, capacity)
    slots = spark.createDataFrame(
        [(length, [(a, b, s, e, o) for x, a, b, s, e, o in ranges if x == length]) for length in sorted(counts)],
        "length long, _slots array<struct<first: long, last: long, sequence: long, each: long, offset: long>>",
    )
    ranked = ranked.join(before, ["length", "_task"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.join(F.broadcast(slots), "length")  # capacity rows at most
    slot = F.filter("_slots", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["last"]))[0]
    at = F.col("_rank") - F.col("_slot.first")
    return (
        ranked.withColumn("_slot", slot)
        .withColumn("sequence_id", F.col("_slot.sequence") + F.floor(at / F.col("_slot.each")))
        .withColumn("offset", F.col("_slot.offset") + at % F.col("_slot.each") * F.col("length"))
        .select(*parts.columns, "sequence_id", "offset")
    )
