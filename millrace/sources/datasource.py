"""A data source of corpus shards: spark.read.format("corpus_shards").load(glob), lines of JSON or of text, plain or gzip.

Each file is a partition, read a line at a time. Rows are (doc_id, text, source, split, path, line); a row without an id gets
file name and line. Other kinds of shards are added by a function that makes (id, text, source, split) tuples of a file.
"""

from __future__ import annotations

import glob
import gzip
import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id string, text string, source string, split string, path string, line long"

Row = tuple[str | None, str, str, str]


def json_lines(lines: Iterator[str], options: dict[str, str]) -> Iterator[tuple[int, Row]]:
    """Blank lines are skipped; a malformed one, or one without the text field, is an error that names the line."""
    field = options.get("text_field", "text")
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        try:
            row = json.loads(line)
        except ValueError as e:
            raise ValueError(f"line {k + 1}: {e}") from e
        if not isinstance(row, dict) or field not in row:
            raise ValueError(f"line {k + 1}: no field {field}")
        key = row.get("doc_id", row.get("id"))
        yield k, (None if key is None else str(key), str(row[field] or ""), str(row.get("source") or options.get("source", "")), str(row.get("split") or options.get("split", "train")))


def text_lines(lines: Iterator[str], options: dict[str, str]) -> Iterator[tuple[int, Row]]:
    for k, line in enumerate(lines):
        if line.strip():
            yield k, (None, line.rstrip("\n"), options.get("source", ""), options.get("split", "train"))


KINDS: dict[str, Callable[[Iterator[str], dict[str, str]], Iterator[tuple[int, Row]]]] = {"json": json_lines, "text": text_lines}


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], kind: Callable) -> None:
        self.options, self.kind = options, kind

    def partitions(self) -> list[InputPartition]:
        pattern = self.options["path"]
        found = sorted(glob.glob(os.path.join(pattern, "*") if os.path.isdir(pattern) else pattern))
        if not found:
            raise FileNotFoundError(f"no shards at {pattern}")
        return [_File(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.path
        with gzip.open(path, "rt", encoding="utf-8") if path.endswith(".gz") else open(path, encoding="utf-8") as f:
            for k, (key, text, source, split) in self.kind(f, self.options):
                yield key or f"{os.path.basename(path)}:{k + 1}", text, source, split, path, k + 1


class CorpusShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        kind = self.options.get("kind", "json")
        if kind not in KINDS:
            raise ValueError(f"unknown kind of shards: {kind}")
        return _Reader(dict(self.options), KINDS[kind])


def register(spark: SparkSession, **kinds: Callable) -> None:
    """Make the source known to the session, with more kinds of shards if given. Paths must be ones that all executors see."""
    KINDS.update(kinds)
    spark.dataSource.register(CorpusShards)
