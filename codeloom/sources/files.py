"""File and archive sources."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("py", "js", "ts", "tsx", "jsx")) -> DataFrame:
    """(rel_path, content) of the files below a directory; the suffixes are filtered while listing."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(base)
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    inside = F.expr(f"substring({'_plain'}, instr(_plain, '{base}') + {len(base) + 1})")
    return files.withColumn("_plain", plain).select(inside.alias("rel_path"), "content")


def unsafe_member(name: str) -> bool:
    """Members that would leave the directory they are extracted to."""
    return name.startswith("/") or ".." in name.split("/")


def expand_archives(archives: DataFrame) -> DataFrame:
    """(archive, rel_path, content, error) of the files in tar archives given as (archive, content).

    The single directory at an archive's top is no part of a path; an archive with several or with none gives an error row, and so does a
    broken one. Unsafe members and what is no file are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content or b""), mode="r:*") as tar:
                        members = [m for m in tar.getmembers() if not unsafe_member(m.name)]
                        tops = {m.name.split("/")[0] for m in members if m.isdir() or "/" in m.name} - {"__MACOSX"}
                        if len(tops) != 1:
                            raise ValueError(f"expected 1 directory at the top, found {len(tops)}")
                        top = tops.pop()
                        rows = [(name, m.name[len(top) + 1 :], tar.extractfile(m).read(), None) for m in members if m.isfile() and m.name.startswith(top + "/")]
                except (tarfile.TarError, ValueError, EOFError, OSError) as problem:
                    rows = [(name, None, None, f"{type(problem).__name__}: {problem}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["archive", "rel_path", "content", "error"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, rel_path string, content binary, error string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Tar archives at a path, expanded."""
    return expand_archives(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"))


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """Raw diffs from files ``owner/repo/number/sha.diff`` below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.diff").load(path)
    parts = F.split("path", "/")
    at = lambda k: F.element_at(parts, k)
    return files.select(
        F.concat(at(-4), F.lit("/"), at(-3)).alias("full_name"), at(-2).cast("int").alias("pr_number"), F.regexp_replace(at(-1), r"\.diff$", "").alias("commit_sha"),
        F.col("content").cast("string").alias("raw_diff"),
    )
