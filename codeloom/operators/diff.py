"""Unified diffs as files and hunks, in array expressions over each diff.

A diff is split into lines once; the places of its headers cut the lines into blocks and a block into hunks. A diff stays in its row until
its files are exploded, so nothing is shuffled but for finding diffs that occur twice. Blocks before the first header are dropped.
Quoted paths match no header, so their lines fold into the block before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import split_lines

_KEYS = ["full_name", "pr_number", "commit_sha"]
_GIT = r"^diff --git a/(.+) b/(.+)$"
_HUNK = r"^@@.+@@"


def _cut_at(lines: Column, starts: Column) -> Column:
    """Slices of the lines from each start up to the next one."""
    after = lambda k: F.coalesce(F.get(starts, k + 1), F.size(lines) + 1)
    return F.transform(starts, lambda i, k: F.slice(lines, i, after(k) - i))


def _places(lines: Column, pattern: str) -> Column:
    """Numbers, from 1, of the lines that match."""
    marked = F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def _last(lines: Column) -> Column:
    return F.try_element_at(lines, F.lit(-1))


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """One row per changed file: the diff's key, file_idx from 0, names, status, counts and hunks in order.

    Null and blank diffs give no rows. Lines that begin with ``+++`` or ``---`` within a hunk are content but not counted. Of several diffs
    under one key the greatest by text is taken.
    """
    single = diffs.where(F.trim("raw_diff") != "").groupBy(*_KEYS).agg(F.max("raw_diff").alias("_raw"))
    lines = F.col("_lines")
    blocks = single.select(*_KEYS, split_lines(F.col("_raw")).alias("_lines")).select(*_KEYS, lines, _places(lines, _GIT).alias("_at"))
    files = blocks.select(*_KEYS, F.posexplode(_cut_at(lines, F.col("_at"))).alias("file_idx", "_block"))
    block = F.col("_block")
    found = files.withColumn("_starts", _places(block, _HUNK)).select(
        *_KEYS, "file_idx",
        _last(F.filter(block, lambda x: x.rlike(_GIT) | x.rlike("^rename to (.+)$"))).alias("_name"),
        _last(F.filter(block, lambda x: x.rlike("^rename from (.+)$"))).alias("_from"),
        _last(F.filter(block, lambda x: x.startswith("new file mode") | x.startswith("deleted file mode") | x.rlike("^rename from (.+)$"))).alias("_status"),
        _cut_at(block, F.col("_starts")).alias("_hunks"),
    )
    name, status = F.col("_name"), F.col("_status")
    content = F.flatten(F.transform("_hunks", lambda h: F.slice(h, 2, F.size(h))))
    count = lambda pattern: F.size(F.filter(content, lambda x: x.rlike(pattern)))
    return found.select(
        *_KEYS, "file_idx",
        F.when(name.startswith("rename to "), F.substring(name, 11, 2**30)).otherwise(F.regexp_extract(name, _GIT, 2)).alias("filename"),
        F.coalesce(F.regexp_extract("_from", "^rename from (.+)$", 1), F.lit("")).alias("old_filename"),
        F.when(status.startswith("new"), "added").when(status.startswith("deleted"), "removed").when(status.isNotNull(), "renamed").otherwise("modified").alias("status"),
        count(r"^\+(?!\+\+)").alias("additions"),
        count(r"^-(?!--)").alias("deletions"),
        F.transform(
            F.filter("_hunks", lambda h: F.size(h) > 1),
            lambda h: F.struct(F.get(h, F.lit(0)).alias("header"), F.concat(F.array_join(F.slice(h, 2, F.size(h)), "\n"), F.lit("\n")).alias("content")),
        ).alias("hunks"),
    )


def diff_totals(files: DataFrame) -> DataFrame:
    """Totals and changed names of each diff (A4, A5)."""
    return files.groupBy(*_KEYS).agg(
        F.sum("additions").alias("total_additions"), F.sum("deletions").alias("total_deletions"), F.array_sort(F.collect_set("filename")).alias("changed_filenames")
    )
