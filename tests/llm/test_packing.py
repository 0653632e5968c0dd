import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pack_whole_table(make_docs, sample):
    docs = make_docs(sample)
    out = packing.pack(packing.pieces(docs, PATH)).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(sample)))
    for k, text in enumerate(sample):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        rows = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        at = 0
        for r in rows:
            assert r.start == at
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
        assert all(r.length == 1024 for r in rows[1:])
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_seq) <= 1.02 * -(-sum(r.length for r in out) // 1024) + 1


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([8, 50, 1024]))
    counts = {int(rng.integers(1, capacity + 1)): int(rng.integers(1, 40)) for _ in range(30)}
    rows = packing.plan(counts, capacity)
    filled, ranks = {}, set()
    for length, a, b, sequence, each, offset in rows:
        for r in range(a, b):
            ranks.add((length, r))
            filled.setdefault(sequence + (r - a) // each, []).append((offset + (r - a) % each * length, length))
    assert ranks == {(k, r) for k, n in counts.items() for r in range(n)}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    rooms = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= length
        else:
            rooms.append(capacity - length)
    assert len(filled) <= len(rooms) + 1


def test_special_tokens_are_as_the_library_has_them(make_docs):
    """The file as loaded, no flag set: a special token in a text is its id, wherever it stands."""
    texts = ["hello <|endoftext|> there", "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|>\n y", "<|endoftext", "plain words"]
    t = Tokenizer.from_file(PATH)
    want = {k: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, x in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in packing.pieces(make_docs(texts), PATH).collect()} == want
    assert 50256 in t.encode(texts[1], add_special_tokens=False).ids


def test_equal_rows_and_lengths(make_docs):
    """Rows equal in all columns, ties of length, null ids and clashing names of columns; one very long text."""
    rows = [(7, "same words here")] * 900 + [(None, None)] * 50 + [(1, "long text " * 120_000)] + [(k, f"tie {k % 9}") for k in range(300)]
    docs = make_docs(rows).withColumnsRenamed({"lang": "piece", "source": "sequence_id"}).withColumn("_rank", F.lit("x")).repartition(5)
    out = packing.pack(packing.pieces(docs, PATH)).collect()
    places = {(r.sequence_id, r.offset) for r in out}
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(places) == len(out) and sum(r.piece == 0 for r in out) == len(rows)
    for parts in by_seq.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(by_seq) <= -(-sum(r.length for r in out) // 1024) + 2


def test_empty_table(make_docs):
    assert packing.pack(packing.pieces(make_docs([]), PATH)).count() == 0
