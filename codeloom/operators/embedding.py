"""Batched embedding with errors per row (D3) through a pluggable provider."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """A provider of vectors; it is sent to the executors with the job."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


_WORD = re.compile(r"[A-Za-z0-9_]+")


class HashEmbedder:
    """Deterministic offline provider: words are hashed to signed dimensions, vectors have length 1; a text without words raises."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        found = []
        for text in texts:
            counts = Counter(w.lower() for w in _WORD.findall(text or ""))
            if not counts:
                raise ValueError("empty text")
            vector = [0.0] * self.dimension
            for word, n in counts.items():
                digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
                vector[int(digest[:7], 16) % self.dimension] += n if int(digest[-1], 16) % 2 else -n
            length = sum(x * x for x in vector) ** 0.5 or 1.0
            found.append([x / length for x in vector])
        return found


def _embed_batch(embedder: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """The whole batch at once; one by one where that fails or the provider answers with another number of vectors."""
    try:
        vectors = embedder.embed(texts)
        if len(vectors) == len(texts):
            return [(v, None) for v in vectors]
    except Exception:
        pass
    found: list[tuple[list[float] | None, str | None]] = []
    for text in texts:
        try:
            found.append((embedder.embed([text])[0], None))
        except Exception as problem:
            found.append((None, f"{type(problem).__name__}: {problem}"))
    return found


def embed(df: DataFrame, text: str, embedder: Embedder, *, batch: int = 32, dimension: int | None = None, fail_fast: bool = False) -> DataFrame:
    """Adds ``embedding`` and ``embed_error``; a vector of another length than ``dimension`` is an error.

    ``fail_fast`` raises instead (queries). An empty frame stays empty. Columns of these two names are replaced.
    """
    kept = df.drop("embedding", "embed_error")
    schema = T.StructType([*kept.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(rows.schema.get_field_index(text)).to_pylist()
            found: list[tuple[list[float] | None, str | None]] = []
            for start in range(0, len(texts), batch):
                part = texts[start : start + batch]
                if fail_fast:
                    vectors = embedder.embed(part)
                    if len(vectors) != len(part):
                        raise ValueError("the provider answered with another number of vectors")
                    found += [(v, None) for v in vectors]
                else:
                    found += _embed_batch(embedder, part)
            if dimension is not None:
                found = [(v, e) if v is None or len(v) == dimension else (None, f"dimension {len(v)}, expected {dimension}") for v, e in found]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())],
                names=[*rows.schema.names, "embedding", "embed_error"],
            )

    return kept.mapInArrow(run, schema)


def embed_counts(embedded: DataFrame) -> DataFrame:
    """Rows with a vector and rows without."""
    return embedded.agg(F.count_if(F.col("embedding").isNotNull()).alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("failed"))
