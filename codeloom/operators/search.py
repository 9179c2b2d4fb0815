"""Scoped cosine search for many queries in one job, merging and formatting.

Scoring runs as a vectorised kernel over Arrow batches. Up to ``QUERY_BLOCK`` queries without a scope of their own go to every task, and
the chunks stay where they are. Any other number of queries, and queries that search one repository each, meet the chunks by key: blocks
of queries with slices of the scope, each pair in a task of bounded size, and only the best of each pair travel on. ``score_pairs`` is the
same in plain expressions, for sets of queries whose size is checked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import chunk_header
from codeloom.functions.vector import cosine_similarity
from codeloom.session import broadcast_if_small, cut

#: Queries that one scan answers; their vectors are what each task holds.
QUERY_BLOCK = 2048
#: Chunks of a scope that one pair of a slice and a block of queries holds.
SLICE_ROWS = 100_000
HIT_COLUMNS = ("file_path", "chunk_type", "name", "parent_class", "language", "content", "line_start", "line_end")


def active_chunks(chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """Chunks of each repository's active run; a repository without one has none."""
    active = repositories.where(F.col("active_index_run_id").isNotNull()).select(F.col("active_index_run_id").alias("index_run_id")).distinct()
    return chunks.join(active, "index_run_id", "left_semi")


def filtered(chunks: DataFrame, language: str | None = None, chunk_type: str | None = None) -> DataFrame:
    """Optional equality filters; an empty value is no filter."""
    if language:
        chunks = chunks.where(F.col("language") == language)
    if chunk_type:
        chunks = chunks.where(F.col("chunk_type") == chunk_type)
    return chunks


class _Kernel:
    """Best rows of a block of queries in a batch of vectors, NaN after every number, ties at the border kept."""

    def __init__(self, numbers: np.ndarray, vectors: list[np.ndarray], top_k: int, min_score: float):
        self.numbers, self.top_k, self.min_score = numbers, top_k, min_score
        self.by_dimension: dict[int, np.ndarray] = {}
        lengths = np.array([len(v) for v in vectors])
        for d in np.unique(lengths):
            self.by_dimension[int(d)] = np.flatnonzero(lengths == d)
        self.vectors = vectors

    def best(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, row, cosine)."""
        lengths = np.asarray(column.value_lengths().fill_null(-1))
        parts = []
        for dimension, asks in self.by_dimension.items():
            rows = np.flatnonzero(lengths == dimension)
            if not len(rows) or not dimension:
                continue
            data = np.asarray(column.take(pa.array(rows)).flatten(), np.float64).reshape(-1, dimension)
            matrix = np.stack([self.vectors[k] for k in asks]).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.clip((matrix @ data.T) / (np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(data, axis=1)[None, :]), -1, 1)
            rank = np.where(np.isnan(cosine), -np.inf, cosine)
            passes = np.isnan(cosine) | (cosine >= self.min_score)
            if cosine.shape[1] > self.top_k:
                least = -np.partition(-np.where(passes, rank, -np.inf), self.top_k - 1, axis=1)[:, self.top_k - 1 : self.top_k]
                passes &= rank >= least
            q, r = np.nonzero(passes)
            parts.append((self.numbers[asks[q]], rows[r], cosine[q, r]))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*parts))


_BATCH = 4096


def top_k_per_query(
    chunks: DataFrame, queries: DataFrame, *, top_k: int = 5, min_score: float = 0.70, query_block: int = QUERY_BLOCK, slice_rows: int = SLICE_ROWS,
    vector: str = "embedding", exclude_self: bool = False, scope: str | None = None,
) -> DataFrame:
    """(scope, q_idx, id, similarity, rnk): each query's best rows by cosine distance, then id; tasks keep their own best before the shuffle.

    ``queries``: q_idx, vector, and the ``scope`` column if one is named (then a query sees the rows of its scope alone, q_idx being unique within
    it). ``min_score`` is inclusive and NaN passes it but ranks last. Vectors of another dimension or null are never
    hits. Without queries the result is empty. ``exclude_self`` leaves out the row whose id is the query's number.
    """
    spark = chunks.sparkSession
    in_scope = (F.lit("") if scope is None else F.col(scope).cast("string")).alias("_s")
    rows = chunks.select(in_scope, "id", F.col(vector).cast("array<float>").alias("_v")).where(F.col("_v").isNotNull() & F.col("_s").isNotNull())
    asked = queries.select(in_scope, F.col("q_idx").cast("long").alias("q_idx"), F.col("vector").cast("array<float>").alias("_q")).where(F.col("_q").isNotNull() & F.col("_s").isNotNull())
    kind = chunks.schema["id"].dataType
    id_type = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    fields = pa.schema([("_s", pa.string()), ("q_idx", pa.int64()), ("id", id_type), ("similarity", pa.float64())])
    schema = f"_s string, q_idx long, id {kind.simpleString()}, similarity double"
    keep = top_k + 1 if exclude_self else top_k

    def table(where: str, kernel: _Kernel, batch) -> pa.RecordBatch:
        q, r, cosine = kernel.best(batch.column("_v"))
        return pa.RecordBatch.from_arrays([pa.array([where] * len(q), pa.string()), pa.array(q), batch.column("id").take(pa.array(r)), pa.array(cosine)], schema=fields)

    few = scope is None and asked.limit(query_block + 1).count() <= query_block
    if few:
        held = sorted((r["q_idx"], r["_q"]) for r in asked.collect())  # at most query_block of them
        kernel = _Kernel(np.array([q for q, _ in held], np.int64), [np.array(v, np.float32) for _, v in held], keep, min_score)
        hits = rows.mapInArrow(lambda batches: (table("", kernel, batch) for batch in batches), schema)
    else:
        # Rows of a scope are cut into slices and its queries into blocks, by counts of both; queries may come from a model, so they are made once.
        asked = cut(asked)
        pieces = lambda frame, most, name: frame.groupBy("_s").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
        sizes = pieces(asked, query_block, "_blocks").join(pieces(rows, slice_rows, "_slices"), "_s")
        sizes = broadcast_if_small(sizes, 100_000)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        data = rows.join(sizes, "_s").withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int")).select("_s", "_slice", every("_blocks").alias("_block"), "id", "_v")
        asks = asked.join(sizes, "_s").withColumn("_block", F.pmod(F.xxhash64("q_idx"), F.col("_blocks")).cast("int")).select("_s", every("_slices").alias("_slice"), "_block", "q_idx", "_q")

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return fields.empty_table()
            vectors = [np.asarray(v.values, np.float32) for v in right.column("_q")]
            kernel = _Kernel(np.asarray(right.column("q_idx").combine_chunks()), vectors, keep, min_score)
            where = left.column("_s")[0].as_py()
            found = [table(where, kernel, batch) for batch in left.select(["id", "_v"]).combine_chunks().to_batches(max_chunksize=_BATCH)]
            best = pa.Table.from_batches(found, schema=fields)
            # The batches' best are ranked again, so that a pair sends on its own best alone.
            order = np.lexsort((-np.nan_to_num(np.asarray(best.column("similarity")), nan=-np.inf), np.asarray(best.column("q_idx"))))
            q, score = np.asarray(best.column("q_idx"))[order], np.nan_to_num(np.asarray(best.column("similarity")), nan=-np.inf)[order]
            starts = np.flatnonzero(np.r_[True, np.diff(q) != 0][: len(q)])
            lengths = np.diff(np.r_[starts, len(q)])
            least = np.repeat(score[starts + np.minimum(lengths, keep) - 1], lengths) if len(q) else score
            return best.take(pa.array(order[score >= least]))

        group = ["_s", "_slice", "_block"]
        hits = data.groupBy(*group).cogroup(asks.groupBy(*group)).applyInArrow(pair, schema)
    if exclude_self:
        hits = hits.where(F.col("id") != F.col("q_idx"))
    best = Window.partitionBy("_s", "q_idx").orderBy(F.when(F.isnan("similarity"), F.lit(float("inf"))).otherwise(1 - F.col("similarity")), "id")
    ranked = hits.withColumn("rnk", F.row_number().over(best)).where(F.col("rnk") <= top_k)
    return ranked.drop("_s") if scope is None else ranked.withColumnRenamed("_s", scope)


def score_pairs(chunks: DataFrame, queries: DataFrame, min_score: float, vector: str = "embedding", most_queries: int = 100_000) -> DataFrame:
    """All (q_idx, id, similarity) at or above a score, in expressions alone, for at most ``most_queries`` queries, which is checked."""
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries: use top_k_per_query")
    pairs = chunks.select("id", F.col(vector).alias("_v")).join(F.broadcast(queries.select("q_idx", F.col("vector").alias("_q"))), F.size("_v") == F.size("_q"))
    return pairs.select("q_idx", "id", cosine_similarity(F.col("_v"), F.col("_q")).alias("similarity")).where(F.col("similarity") >= min_score)


def merge_hits(hits: DataFrame, cap: int = 10, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row per id with its best score, capped; order of arrival decides ties and NaN ranks last.

    ``hits``: scope columns, q_idx, rnk, id, similarity. Result: scope columns, id, best_score, first_q, first_rnk, position from 1.
    """
    score = F.when(F.isnan("similarity"), F.lit(float("-inf"))).otherwise(F.col("similarity"))
    best = hits.groupBy(*scope, "id").agg(F.max(score).alias("_best"), F.min(F.struct("q_idx", "rnk")).alias("_first"))
    order = Window.partitionBy(*(scope or [F.lit(0)])).orderBy(F.desc("_best"), "_first")
    if not scope:  # a global cap needs no window over everything
        best = best.orderBy(F.desc("_best"), "_first").limit(cap)
    return (
        best.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= cap)
        .select(*scope, "id", F.when(F.col("_best") == float("-inf"), F.lit(float("nan"))).otherwise(F.col("_best")).alias("best_score"), F.col("_first.q_idx").alias("first_q"), F.col("_first.rnk").alias("first_rnk"), "position")
    )


def format_context(ranked: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Numbered chunks joined by empty lines, one text per scope; scores are not in it."""
    c = F.col
    text = F.concat(
        chunk_header(c("position"), c("parent_class"), c("name"), c("chunk_type"), c("file_path"), c("line_start"), c("line_end")), F.lit("\n"), c("content")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", text.alias("text")))), lambda x: x["text"]), "\n\n")
    return ranked.groupBy(*scope).agg(F.coalesce(joined, F.lit("")).alias("context"))


def search(
    chunks: DataFrame, repositories: DataFrame, queries: DataFrame, *, language: str | None = None, chunk_type: str | None = None,
    query_top_k: int = 5, top_k: int = 10, min_score: float = 0.70, by_repository: bool = False,
) -> DataFrame:
    """Active runs, filters, per-query top-k, merge and cap; the winning chunks with their position.

    With ``by_repository`` each query (repo_id, q_idx, vector) searches its repository alone and each repository gets its own list; else all
    active runs are one scope.
    """
    scope = filtered(active_chunks(chunks, repositories), language, chunk_type)
    keys = ("repo_id",) if by_repository else ()
    hits = top_k_per_query(scope, queries, top_k=query_top_k, min_score=min_score, scope="repo_id" if by_repository else None)
    merged = merge_hits(hits, top_k, keys)
    ranked = broadcast_if_small(cut(merged), 1_000_000) if by_repository else F.broadcast(merged)  # without scopes there are at most top_k rows
    return scope.select(*keys, "id", *HIT_COLUMNS).join(ranked, [*keys, "id"]).select(*keys, "position", "id", *HIT_COLUMNS)
