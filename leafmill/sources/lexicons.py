"""Word lists as sorted files with a table of their first words, so that a lookup opens one file.

`written` sorts a table by range and writes it; the data source `leafmill_lexicon` reads it: filters on the word are
pushed to it and choose the files, and in a file the block of rows, by a sparse table of first words. The folder has to
be on a file system that Arrow opens by its address (file, hdfs, s3, gs). A list that is not sorted is refused.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

NAME = "leafmill_lexicon"
#: Rows of a block, which has one entry in its file's table of first words.
BLOCK = 4096
TABLE = "first-words.json"


class _Written(WriterCommitMessage):
    def __init__(self, file: str, blocks: list[str], last: str, rows: int):
        self.file, self.blocks, self.last, self.rows = file, blocks, last, rows


class _Part(InputPartition):
    def __init__(self, file: str, first: int, past: int):
        super().__init__((file, first, past))
        self.file, self.first, self.past = file, first, past


def _opened(path: str):
    """(file system, path) of an address."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _key(word: str) -> bytes:
    return word.encode()


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        file, sink, blocks, last, held, rows = f"part-{uuid.uuid4().hex}.arrow", None, [], None, [], 0

        def put(batches):
            nonlocal sink
            table = pa.Table.from_batches(batches).combine_chunks()
            if sink is None:
                sink = pa.ipc.new_file(fs.open_output_stream(f"{root}/{file}"), table.schema)
            block = table.to_batches()[0]
            blocks.append(block.column(0)[0].as_py())
            sink.write_batch(block)

        for batch in iterator:
            words = batch.column(0).to_pylist()
            for word in words:
                if word is None or (last is not None and _key(word) < _key(last)):
                    raise ValueError(f"{self.path}: words are not sorted: {word!r} after {last!r}")
                last = word
            rows += len(words)
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                table = pa.Table.from_batches(held)
                put(table.slice(0, BLOCK).to_batches())
                held = table.slice(BLOCK).to_batches()
        if held and any(b.num_rows for b in held):
            put(held)
        if sink is not None:
            sink.close()
        return _Written(file, blocks, last, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _opened(self.path)
        files = sorted((m for m in messages if m is not None and m.rows), key=lambda m: _key(m.blocks[0]))
        for a, b in zip(files, files[1:], strict=False):
            if _key(a.last) > _key(b.blocks[0]):
                raise ValueError(f"{self.path}: the ranges of {a.file} and {b.file} overlap")
        with fs.open_output_stream(f"{root}/{TABLE}") as out:
            out.write(json.dumps([{"file": m.file, "blocks": m.blocks, "last": m.last, "rows": m.rows} for m in files]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _opened(self.path)
        for m in messages:
            if m is not None and m.rows:
                fs.delete_file(f"{root}/{m.file}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        #: Ranges [low, high] of words that are asked for; None without a filter.
        self.ranges: list[tuple[str | None, str | None]] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the word choose files and blocks; Spark checks all of them again on the rows."""
        low, high, some = None, None, None
        for f in filters:
            yield f
            if getattr(f, "attribute", None) != ("word",):
                continue
            if isinstance(f, (EqualTo, In)):
                words = {f.value} if isinstance(f, EqualTo) else set(f.value)
                some = words if some is None else some & words
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = f.value if low is None else max(low, f.value, key=_key)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                high = f.value if high is None else min(high, f.value, key=_key)
            elif isinstance(f, StringStartsWith):
                low = f.value if low is None else max(low, f.value, key=_key)
                past = f.value + "\U0010ffff"
                high = past if high is None else min(high, past, key=_key)
        if some is not None:
            self.ranges = [(w, w) for w in sorted((w for w in some if w is not None), key=_key)]
        elif low is not None or high is not None:
            self.ranges = [(low, high)]

    def partitions(self) -> list[InputPartition]:
        fs, root = _opened(self.path)
        with fs.open_input_stream(f"{root}/{TABLE}") as f:
            table = json.loads(f.read())
        parts = []
        for entry in table:
            blocks, last = [_key(w) for w in entry["blocks"]], _key(entry["last"])
            wanted: set[int] = set()
            for low, high in [(None, None)] if self.ranges is None else self.ranges:
                if (low is not None and _key(low) > last) or (high is not None and _key(high) < blocks[0]):
                    continue
                # the block before the first that begins at or after a word may end with it
                first = 0 if low is None else max(0, bisect.bisect_left(blocks, _key(low)) - 1)
                past = len(blocks) if high is None else bisect.bisect_right(blocks, _key(high))
                wanted |= set(range(first, past))
            runs: list[list[int]] = []
            for k in sorted(wanted):
                if runs and runs[-1][1] == k:
                    runs[-1][1] = k + 1
                else:
                    runs.append([k, k + 1])
            parts += [_Part(entry["file"], a, b) for a, b in runs]
        return parts or [_Part("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, root = _opened(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            reader = pa.ipc.open_file(f)
            for k in range(partition.first, partition.past):
                yield reader.get_batch(k)


class Lexicon(DataSource):
    """Rows (word, ...) in ascending order of their word's bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        fs, root = _opened(self.options["path"])
        with fs.open_input_stream(f"{root}/{TABLE}") as f:
            table = json.loads(f.read())
        if not table:
            return "word string"
        with fs.open_input_file(f"{root}/{table[0]['file']}") as f:
            from pyspark.sql.pandas.types import from_arrow_schema

            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Lexicon)


def written(words: DataFrame, path: str, files: int) -> None:
    """Words (word, ...), without null words, written as at most `files` sorted files; a repeated word keeps its rows."""
    registered(words.sparkSession)
    rest = [c for c in words.columns if c != "word"]
    rows = words.select("word", *rest).where("word is not null").repartitionByRange(files, "word").sortWithinPartitions("word", *rest)
    rows.write.format(NAME).mode("append").save(path)


def found(spark: SparkSession, path: str) -> DataFrame:
    """The word list at path; a filter on word opens only the files that may have it."""
    registered(spark)
    return spark.read.format(NAME).load(path)


def chosen(variants: DataFrame) -> DataFrame:
    """(word, value) of the variant with the greatest prob of each word, the first line on ties; variants has line too."""
    return variants.groupBy("word").agg(F.max_by("value", F.struct("prob", -F.col("line"))).alias("value"))
