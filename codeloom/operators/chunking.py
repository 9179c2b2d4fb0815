"""Files to syntax chunks (D1): path filters, chunking in Arrow batches, hashes, one error row per file that does not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.chunker import chunk_source, read_source
from codeloom.functions.text import content_hash, embedding_text, indexable, stem, suffix
from codeloom.session import spread

_FIELDS = (
    "rel_path string, chunk_type string, name string, parent_class string, language string, content string, line_start int, line_end int,"
    " docstring string, calls array<string>, error string"
)


def _chunker(calls_kept: int):
    names = ["rel_path", "chunk_type", "name", "parent_class", "language", "content", "line_start", "line_end", "docstring", "calls", "error"]
    types = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(*(batch.column(c).to_pylist() for c in ("rel_path", "suffix", "content"))):
                language = kind.lstrip(".")
                try:
                    chunks, error = chunk_source(read_source(content or b""), language, calls_kept)
                except Exception as problem:  # one file never stops the others
                    chunks, error = [], f"{type(problem).__name__}: {problem}"
                rows += [(path, c.chunk_type, c.name, c.parent_class, language, c.content, c.line_start, c.line_end, c.docstring, c.calls, None) for c in chunks]
                if error is not None:
                    rows.append((path, None, None, None, language, None, None, None, None, None, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


def chunk_files(files: DataFrame, *, max_lines: int = 80, calls_kept: int = 20, with_errors: bool = False) -> DataFrame:
    """Chunks of (rel_path, content binary): file_path, chunk_type, name, parent_class, language, content, content_hash, line_start, line_end, metadata.

    Skipped directories, files and suffixes give none, nor do blank files. A file that does not parse is one module chunk and, if
    ``with_errors``, a row with ``error`` besides. Several functions of one text each give a row.
    """
    scanned = files.where(indexable(F.col("rel_path"))).select("rel_path", suffix(F.col("rel_path")).alias("suffix"), "content")
    rows = spread(scanned).mapInArrow(_chunker(calls_kept), _FIELDS)
    name = F.when(F.col("chunk_type") == "module", stem(F.col("rel_path"))).otherwise(F.col("name"))
    lines = F.col("line_end") - F.col("line_start") + 1
    metadata = F.struct(lines.alias("line_count"), (lines > max_lines).alias("oversized"), "docstring", "calls")
    shaped = rows.select(
        F.col("rel_path").alias("file_path"), "chunk_type", name.alias("name"), "parent_class", "language", "content",
        content_hash(F.col("content"), F.col("rel_path")).alias("content_hash"), "line_start", "line_end", metadata.alias("metadata"), "error",
    )
    return shaped if with_errors else shaped.where(F.col("error").isNull()).drop("error")


def with_embedding_text(chunks: DataFrame, calls_embedded: int = 10) -> DataFrame:
    """Adds ``embedding_text``."""
    c = F.col
    return chunks.withColumn(
        "embedding_text",
        embedding_text(c("file_path"), c("chunk_type"), c("name"), c("parent_class"), c("metadata.docstring"), c("metadata.calls"), c("content"), calls_embedded),
    )
