"""What changed between consecutive full snapshots of a stream of snapshots.

Keys are mapped to ordinals that persist over all snapshots of a stream. A snapshot is then a compressed
bitmap over ordinals plus a vector of value fingerprints aligned to them: AND-NOT of neighbouring bitmaps
gives additions and removals, and the aligned vectors show the changes among the common keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.bitmap import Bitmap
from codeloom.session import broadcast_if_small, plain_path

#: Rows of one stream that share a block. A larger stream is spread by the hash of its keys.
BLOCK_ROWS = 50_000
#: Snapshot lists up to this length may be broadcast.
SNAPSHOT_BROADCAST_ROWS = 100_000


def _widths(rows_of_stream: DataFrame, streams: list[str], dictionary: DataFrame | None, block_rows: int) -> DataFrame:
    """(streams, _blocks): blocks of each stream, a power of two for its rows, never fewer than its dictionary has."""
    power = F.ceil(F.log2(F.greatest(F.col("_rows") / block_rows, F.lit(1.0))))
    widths = rows_of_stream.select(*streams, F.pow(F.lit(2.0), power).cast("int").alias("_blocks"))
    if dictionary is not None:
        widths = widths.unionByName(dictionary.select(*streams, "_blocks")).groupBy(*streams).agg(F.max("_blocks").alias("_blocks"))
    return widths


def _with_width(rows: DataFrame, widths: DataFrame, streams: list[str]) -> DataFrame:
    """Adds ``_blocks`` of the stream; null parts of a stream equal each other."""
    renamed = widths.withColumnsRenamed({c: f"{c}_" for c in streams})
    return rows.join(broadcast_if_small(renamed, SNAPSHOT_BROADCAST_ROWS), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in streams]).drop(*[f"{c}_" for c in streams])


def _named_dictionary(dictionary: DataFrame | None, stream: Sequence[str], key: Sequence[str]) -> DataFrame | None:
    if dictionary is None:
        return None
    named = [F.col(c).cast("string").alias(f"_s{i}") for i, c in enumerate(stream)] + [F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(key)]
    return dictionary.select(*named, F.col("blocks").alias("_blocks"), F.col("ordinal").alias("_known"))


def _with_ordinals(records: DataFrame, known: DataFrame | None, streams: list[str], keys: list[str]) -> DataFrame:
    """Adds ``_block`` and ``_ord``, the persistent ordinal of the key, to rows with streams, keys and ``_blocks``.

    All rows of a key meet in its block, where known ordinals stay and new keys get the following ones in key order: one shuffle,
    which whatever groups by stream and block goes on using. Known keys without a row are left out again.
    """
    group = [*streams, "_block"]
    # A null key part and an empty one hash alike, which only places them in one block.
    block = F.pmod(F.xxhash64(*keys), F.col("_blocks")).cast("int")
    if known is None:
        placed = records.withColumn("_block", block).repartition(*group)
        return placed.withColumn("_ord", F.dense_rank().over(Window.partitionBy(*group).orderBy(*keys)).cast("long") - 1)
    widths = records.select(*streams, "_blocks").dropDuplicates()
    old = _with_width(known.drop("_blocks"), widths, streams).withColumn("_row", F.lit(False))
    both = records.withColumns({"_known": F.lit(None).cast("long"), "_row": F.lit(True)}).unionByName(old, allowMissingColumns=True)
    placed = both.withColumn("_block", block).repartition(*group)
    placed = placed.withColumn("_known", F.max("_known").over(Window.partitionBy(*group, *keys)))
    rank = F.dense_rank().over(Window.partitionBy(*group).orderBy(F.col("_known").isNotNull(), *keys))
    top = F.coalesce(F.max("_known").over(Window.partitionBy(*group)), F.lit(-1))
    return placed.withColumn("_ord", F.coalesce("_known", top + rank)).where("_row").drop("_known", "_row")


def key_ordinals(rows: DataFrame, *, stream: Sequence[str], key: Sequence[str], dictionary: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Dictionary (stream, key, blocks, ordinal): ordinals given before stay, new keys get the following ones of their block.

    The keys of a stream lie in ``blocks`` blocks by their hash, a power of two that only grows, so that no task holds a whole stream.
    Ordinals are dense and unique within a block; a block that splits in two leaves them as they are. Keys of the dictionary that
    ``rows`` lacks are kept. Repeated rows count once, null key parts equal each other.
    """
    stream, key = list(stream), list(key)
    streams, keys = [f"_s{i}" for i in range(len(stream))], [f"_k{i}" for i in range(len(key))]
    fresh = rows.select(*[F.col(c).cast("string").alias(a) for c, a in zip([*stream, *key], [*streams, *keys])])
    known = _named_dictionary(dictionary, stream, key)
    if known is not None:
        fresh = fresh.unionByName(known.select(*streams, *keys))
    fresh = fresh.dropDuplicates()
    widths = _widths(fresh.groupBy(*streams).agg(F.count(F.lit(1)).alias("_rows")), streams, known, block_rows)
    return _with_ordinals(_with_width(fresh, widths, streams), known, streams, keys).select(
        *[F.col(a).alias(c) for c, a in zip([*stream, *key], [*streams, *keys])], F.col("_blocks").alias("blocks"), F.col("_ord").alias("ordinal")
    )


def snapshot_changes(
    rows: DataFrame,
    snapshots: DataFrame,
    *,
    snapshot: str,
    stream: Sequence[str],
    order: Sequence[str],
    key: Sequence[str],
    value: str,
    dictionary: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Added, removed and changed keys of every snapshot against the one before it in its stream.

    ``rows``: one row per record with ``snapshot`` (id), the ``key`` columns and ``value``.
    ``snapshots``: one row per snapshot with ``snapshot``, ``stream`` and ``order`` columns; a snapshot
    without rows counts as empty. Result: ``stream`` columns, prev_snapshot, snapshot, ``key`` columns, change.

    Defined cases: repeated rows count once; a key with several values in one snapshot stands for the set of
    them and has changed when the set differs; null key parts equal each other, a null value is a value of its
    own; rows of snapshots that are not listed are left out; the first snapshot of a stream is compared with
    none and gives no rows; other columns of ``rows`` are ignored whatever their names.
    ``dictionary`` (stream columns, key columns, blocks, ordinal) holds ordinals given earlier; see ``key_ordinals``.
    """
    stream, key = list(stream), list(key)
    streams, keys = [f"_s{i}" for i in range(len(stream))], [f"_k{i}" for i in range(len(key))]
    known = _named_dictionary(dictionary, stream, key)
    sizes = rows.groupBy(F.col(snapshot).alias("_snap")).agg(F.count(F.lit(1)).alias("_n"))
    by_time = Window.partitionBy(*streams).orderBy(*[f"_o{i}" for i in range(len(order))], "_snap")
    listed = (
        snapshots.select(
            F.col(snapshot).alias("_snap"), *[F.col(c).cast("string").alias(a) for c, a in zip(stream, streams)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
        )
        .join(sizes, "_snap", "left")
        .withColumns({"_seq": F.row_number().over(by_time), "_prev": F.lag("_snap").over(by_time), "_next": F.lead("_snap").over(by_time)})
        .select("_snap", "_seq", "_prev", "_next", *streams, F.coalesce("_n", F.lit(0)).alias("_n"))
    )
    widths = _widths(listed.groupBy(*streams).agg(F.sum("_n").alias("_rows")), streams, known, block_rows)
    listed = _with_width(listed.drop("_n"), widths, streams)
    records = (
        rows.select(
            F.col(snapshot).alias("_snap"),
            *[F.col(c).cast("string").alias(a) for c, a in zip(key, keys)],
            F.xxhash64(F.coalesce(F.col(value).cast("string"), F.lit("\x00null"))).alias("_print"),
        )
        .join(broadcast_if_small(listed, SNAPSHOT_BROADCAST_ROWS), "_snap")
        .dropDuplicates()  # copies meet before anything is placed by key
    )
    placed = _with_ordinals(records, known, streams, keys)
    schema = ", ".join([*[f"{c} string" for c in streams], "_prev string", "_snap string", *[f"{c} string" for c in keys], "_change string"])
    found = placed.groupBy(*streams, "_block").applyInPandas(lambda pdf: _block_changes(pdf, streams, keys), schema)
    return found.select(
        *[F.col(a).alias(c) for c, a in zip(stream, streams)],
        F.col("_prev").alias("prev_snapshot"),
        F.col("_snap").alias("snapshot"),
        *[F.col(a).alias(c) for c, a in zip(key, keys)],
        F.col("_change").alias("change"),
    )


def _block_changes(pdf: pd.DataFrame, streams: list[str], keys: list[str]) -> pd.DataFrame:
    """Changes of one block: a bitmap over ordinals and a vector of fingerprints aligned to them for each snapshot."""
    names = [*streams, "_prev", "_snap", *keys, "_change"]
    if pdf.empty:
        return pd.DataFrame(columns=names)
    ordinal, seq, prints = (pdf[c].to_numpy() for c in ("_ord", "_seq", "_print"))
    size = int(ordinal.max()) + 1
    where = np.zeros(size, np.int64)
    where[ordinal] = np.arange(len(pdf))
    order = np.argsort(seq, kind="stable")
    steps, starts = np.unique(seq[order], return_index=True)
    bounds = [*starts.tolist(), len(order)]
    prev, snap, after = (pdf[c].to_numpy() for c in ("_prev", "_snap", "_next"))
    empty = (Bitmap({}), np.zeros(size, np.int64))
    parts: list[tuple[np.ndarray, str, str, str]] = []
    last, past = None, empty
    for j, step in enumerate(steps.tolist()):
        at = order[bounds[j] : bounds[j + 1]]
        column = np.zeros(size, np.int64)
        np.add.at(column, ordinal[at], prints[at])  # sets of values: the sum of their fingerprints
        bits = Bitmap.of(ordinal[at])
        here = at[0]
        before, old = past if last == step - 1 else empty
        if isinstance(prev[here], str):
            parts.append((bits.minus(before).ordinals(), "added", prev[here], snap[here]))
            common = bits.both(before).ordinals()
            parts.append((common[column[common] != old[common]], "changed", prev[here], snap[here]))
            parts.append((before.minus(bits).ordinals(), "removed", prev[here], snap[here]))
        following = steps[j + 1] if j + 1 < len(steps) else None
        if following != step + 1 and isinstance(after[here], str):  # the next snapshot has no row in this block
            parts.append((bits.ordinals(), "removed", snap[here], after[here]))
        last, past = step, (bits, column)
    picked = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    lengths = [len(p[0]) for p in parts]
    out = pdf[keys].take(where[picked]).reset_index(drop=True)
    for c in streams:
        out[c] = pdf[c].iloc[0]
    for c, k in (("_change", 1), ("_prev", 2), ("_snap", 3)):
        out[c] = np.repeat(np.array([p[k] for p in parts], object), lengths)
    return out[names]


_CHUNK_KEY = ["file_path", "parent_class", "name", "chunk_type"]


def _finished(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin("completed", "superseded")).select(F.col("id").alias("index_run_id"), "repo_id", "branch", "started_at")


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.select("index_run_id", plain_path(F.col("file_path")).alias("file_path"), *_CHUNK_KEY[1:], F.lower("content_hash").alias("content_hash"))


def chunk_ordinals(chunks: DataFrame, runs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Dictionary of the chunk keys of each (repo_id, branch) over its finished runs, to be kept and given to the next comparison."""
    rows = _keyed(chunks).join(broadcast_if_small(_finished(runs), SNAPSHOT_BROADCAST_ROWS), "index_run_id")
    return key_ordinals(rows, stream=["repo_id", "branch"], key=_CHUNK_KEY, dictionary=dictionary)


def chunk_changes(chunks: DataFrame, runs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Chunk changes between consecutive finished index runs of each (repo_id, branch)."""
    found = snapshot_changes(
        _keyed(chunks), _finished(runs), snapshot="index_run_id", stream=["repo_id", "branch"], order=["started_at"], key=_CHUNK_KEY, value="content_hash", dictionary=dictionary
    )
    return found.select("repo_id", F.col("prev_snapshot").alias("prev_run_id"), F.col("snapshot").alias("run_id"), *_CHUNK_KEY, "change")
