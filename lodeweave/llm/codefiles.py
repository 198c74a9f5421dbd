"""Source files held in chunks: put together as a sorted stream, parsed, and mined for documented functions.

Nulls: chunks without id, document_id or text are left out, files without a source_documents row
too.  Repeated chunk rows count once.  A file is one shuffle key; its chunks arrive sorted and the
parsers of ``lexing.py`` take them one by one, so the memory of a task is that of one chunk (of one
file, where functions are wanted).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .docpairs import functions_of
from .lexing import language, parser

_PREFIX = re.compile(r"(?m)^\d+: ?")
_EXTENSION = r"(?i)\.(c|h|cc|cpp|hpp|py|json)$"

FILES = "document_id bigint, path string, language string, valid boolean, error_line int, error string"
FUNCTIONS = (
    "document_id bigint, path string, language string, name string, line_start int, line_end int, "
    "class_name string, bases array<string>, description string, words int, inherits boolean, code string"
)


def stored_lines(text: str) -> list[str]:
    """The lines of a chunk without their `N: ` prefix and trailing carriage return."""
    text = _PREFIX.sub("", text)
    if "\r" in text:
        text = re.sub(r"\r(?=\n|\Z)", "", text)
    return text.split("\n")


def sorted_pieces(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (document_id, kind, line_start, id, text): per file its path first, then its chunks in order.

    One shuffle on document_id and no join: the paths travel as rows of their own.
    """
    paths = documents.where(F.col("id").isNotNull() & F.col("path").rlike(_EXTENSION)).select(
        F.col("id").alias("document_id"), F.lit(0).alias("kind"), F.lit(0).alias("line_start"), F.lit(0).cast("bigint").alias("id"), F.col("path").alias("text")
    )
    pieces = chunks.where(F.col("id").isNotNull() & F.col("document_id").isNotNull() & F.col("text").isNotNull() & _coded(F.col("page"))).select(
        "document_id", F.lit(1).alias("kind"), F.coalesce("line_start", F.lit(0)).alias("line_start"), "id", "text"
    )
    return paths.unionByName(pieces).repartition("document_id").sortWithinPartitions("document_id", "kind", "line_start", "id")


def _coded(page: Column) -> Column:
    """Pieces of paged documents hold no source lines."""
    return page.isNull() | (page <= 0)


class _File:
    def __init__(self, document_id: int) -> None:
        self.document_id, self.path, self.parser, self.lines, self.last = document_id, None, None, None, None

    def start(self, path: str, keep: bool) -> None:
        if self.path is None:
            self.path = path
            self.parser = parser(language(path))
            self.lines = [] if keep and language(path) != "json" else None


def _scan(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[tuple[_File, tuple[int, str] | None]]:
    file: _File | None = None
    for batch in batches:
        cols = [batch.column(i) for i in range(5)]
        ids, kinds, chunk_ids = cols[0].to_pylist(), cols[1].to_pylist(), cols[3].to_pylist()
        texts = cols[4]
        for k, (document_id, kind, chunk_id) in enumerate(zip(ids, kinds, chunk_ids)):
            if file is None or file.document_id != document_id:
                if file is not None and file.parser is not None and file.last is not None:
                    yield file, file.parser.finish()
                file = _File(document_id)
            if kind == 0:
                file.start(texts[k].as_py(), keep)
            elif file.parser is not None and chunk_id != file.last:
                file.last = chunk_id
                lines = stored_lines(texts[k].as_py())
                if file.parser.error is None:
                    file.parser.feed(lines)
                if file.lines is not None:
                    file.lines += lines
    if file is not None and file.parser is not None and file.last is not None:
        yield file, file.parser.finish()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_FILES_SCHEMA = pa.schema(
    [("document_id", pa.int64()), ("path", pa.string()), ("language", pa.string()), ("valid", pa.bool_()), ("error_line", pa.int32()), ("error", pa.string())]
)
_FUNCTIONS_SCHEMA = pa.schema(
    [
        ("document_id", pa.int64()), ("path", pa.string()), ("language", pa.string()), ("name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()),
        ("class_name", pa.string()), ("bases", pa.list_(pa.string())), ("description", pa.string()), ("words", pa.int32()), ("inherits", pa.bool_()), ("code", pa.string()),
    ]
)


def parse_files(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per source file: whether it is valid in the language of its extension, and its first unrecoverable error.

    Each file's whole token stream runs through the table-driven recogniser of its grammar.
    Empty files follow the grammar: valid but for JSON.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for f, error in _scan(batches, False):
                yield f.document_id, f.path, language(f.path), error is None, error and error[0], error and error[1]

        yield from _batches(rows(), _FILES_SCHEMA)

    return sorted_pieces(chunks, documents).mapInArrow(run, FILES)


def file_functions(chunks: DataFrame, documents: DataFrame, with_code: bool = True, hierarchy: bool = False) -> DataFrame:
    """Functions and methods with a body in the valid C, C++ and Python files, with their own description (null if trivial).

    With ``hierarchy`` also classes and documented declarations, see functions_of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for f, error in _scan(batches, True):
                if error is None and f.lines:
                    lang = language(f.path)
                    for x in functions_of(f.lines, lang, hierarchy):
                        yield (f.document_id, f.path, lang, *x[:-1], x[-1] if with_code else None)

        yield from _batches(rows(), _FUNCTIONS_SCHEMA)

    return sorted_pieces(chunks, documents).mapInArrow(run, FUNCTIONS)


def repository(col: Column) -> Column:
    """Name without `.git`; null and blank become `unknown`."""
    name = F.regexp_replace(F.trim(col), r"\.git/?$", "")
    return F.when(F.length(name) > 0, name).otherwise(F.lit("unknown"))


def parse_rates(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files, invalid files and their share per repository and language."""
    repos = documents.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("document_id")).agg(repository(F.max("repo")).alias("repo"))
    return (
        files.join(repos, "document_id")
        .groupBy("repo", "language")
        .agg(F.count("*").alias("files"), F.sum((~F.col("valid")).cast("bigint")).alias("invalid"))
        .withColumn("rate", F.col("invalid") / F.col("files"))
    )
