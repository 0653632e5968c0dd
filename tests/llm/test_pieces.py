import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from leafmill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_as_library(lib):
    model, rnd = pieces.Pieces(PATH), random.Random(1)
    vocabulary = [lib.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    letters = "abc aaa\n▁  thereingXYZ.,é漢😀\t\x00#*&-=_0123456789 "
    texts = ["", " ", "\n", "a", " a", "a ", " " * 40 + "a" + " " * 33, "x \n y", "�", "a" * 300, "----====----"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 8))) for _ in range(5000)]
    for text, ids in zip(texts, lib.encode(texts, add_eos=True), strict=True):
        assert np.frombuffer(model.encode(text), "<u4").tolist() == ids
        assert model.decode(ids).decode() == lib.decode(ids)
    mixed = [[rnd.randrange(300) if rnd.random() < 0.5 else rnd.randrange(32000) for _ in range(rnd.randint(0, 12))] for _ in range(2000)]
    assert [model.decode(x).decode() for x in mixed] == lib.decode(mixed)


def test_query_columns(make_docs, sample, lib):
    docs = make_docs(sample).withColumnRenamed("lang", "ids")
    rows = pieces.digests(pieces.decode(pieces.encode(docs, PATH), PATH)).collect()
    assert len(rows) == len(sample)
    for r in rows:
        ids = lib.encode(sample[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_empty_table(make_docs):
    assert pieces.digests(pieces.decode(pieces.encode(make_docs([]), PATH), PATH)).count() == 0


def test_kept_words_are_bounded_by_bytes(monkeypatch, lib):
    monkeypatch.setattr(pieces, "CACHE_BYTES", 1000)
    model = pieces.Pieces(PATH)
    for k in range(50):
        text = f"word{k} " + "z" * 400
        assert np.frombuffer(model.encode(text), "<u4").tolist() == lib.encode(text, add_eos=True)
        assert model.held < 4000


def test_other_normalizers_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, text: "changed", raising=False)
    with pytest.raises(ValueError, match="normalizer"):
        pieces.Pieces(PATH)
