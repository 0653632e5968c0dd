"""Functions over batches of texts hold the results of a part of a batch at once."""

import pandas as pd

from leafmill.operators import html, segment, speech

TEXTS = ["А вот. И ещё одно предложение, подлиннее.\n" * 4000, None, "", "Кратко."] * 8


def _batches(f, *columns):
    return list(f.func(iter([columns if len(columns) > 1 else columns[0]])))


def test_results_come_in_parts():
    texts, names = pd.Series(TEXTS), pd.Series(["t"] * len(TEXTS))
    for got in (_batches(segment.spoken_chunks, texts), _batches(segment.plain_chapters, names, texts), _batches(html.read_page, texts.fillna(""), names), _batches(speech.spoken_segments, names, texts.map(lambda t: [t]))):
        assert len(got) > 1 and sum(map(len, got)) == len(TEXTS)


def test_parts_keep_rows_in_order():
    parts = list(segment.in_parts([(["ab", "c", "defg", "h"],)], lambda row: len(row[0]), 3))
    assert parts == [[("ab",), ("c",)], [("defg",)], [("h",)]]
    assert list(segment.in_parts([([],)], lambda row: 1)) == [[]]
