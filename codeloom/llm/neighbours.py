"""The k most similar vectors for every vector, within groups: random-projection forests and exact reranking.

A group is cut into shards of bounded size by the hash of its vectors. In each shard a forest of balanced random-projection trees is grown over
all its vectors, and each query of the group descends all trees at once through one priority queue over node margins: the best node is
popped, one path is followed down to a leaf, and the other side of every plane on the way is pushed. It ends when the leaves hold
``SEARCH_FACTOR`` times the square root of the shard's size in rows, the growth that half-spaces need for neighbours of cosine 0.6, or
later: how many leaves this shard needs is found from some of its queries, whose neighbours are known exactly. The
cosines with the rows of the leaves are exact. Work goes by pairs of a shard and a slice of queries, so that no task holds a group,
and recall depends on the shard's size alone. Copies of a vector are one class, searched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import broadcast_if_small, cut, plain_path, table

K = 5
DIM = 64
#: Trees of a forest, least rows aimed at in a leaf, and the factor of the square root of a shard's rows that a query sees, repeats included.
TREES = 32
LEAF_ROWS = 64
SEARCH_FACTOR = 40
#: Share of the neighbours of ``PROBES`` queries of each task that must lie in the leaves visited; the number of leaves follows from it.
RECALL = 0.95
PROBES = 128
#: Rows of a shard, and queries of a slice where a group is one shard.
SHARD_ROWS = 131_072
SLICE_ROWS = 32_768
#: Queries in memory at a time, and entries of their queues.
_BLOCK = 8192
_ENTRIES = 8_000_000


class Forest:
    """Balanced trees over the rows of ``unit``: a plane for each inner node, and the rows in order of leaves.

    A plane is midway between the halves of the node's vectors along the difference of two of them.
    """

    def __init__(self, unit: np.ndarray, trees: int, leaf_rows: int, seed: int):
        n, dim = unit.shape
        aim = max(leaf_rows, 0.8 * n**0.5)
        self.unit, self.trees = unit, trees
        self.depth = max(0, int(np.ceil(np.log2(max(1.0, n / aim)))))
        self.leaves = 1 << self.depth
        self.normals = np.zeros((trees, max(1, self.leaves - 1), dim), np.float32)
        self.offsets = np.zeros((trees, max(1, self.leaves - 1)), np.float32)
        self.rows = np.tile(np.arange(n, dtype=np.int32), (trees, 1))
        self.bounds = _bounds(n, self.depth)
        rng = np.random.default_rng(seed)
        for tree in range(trees):
            self._grow(tree, rng)

    def _grow(self, tree: int, rng: np.random.Generator) -> None:
        rows, vectors = self.rows[tree], self.unit
        for level in range(self.depth):
            bounds = _bounds(len(rows), level)
            low, sizes = bounds[:-1], np.diff(bounds)
            a = (rng.random(len(sizes)) * sizes).astype(np.int64)
            b = (rng.random(len(sizes)) * (sizes - 1)).astype(np.int64)
            b += b >= a
            normal = vectors[low + a] - vectors[low + b]
            length = np.linalg.norm(normal, axis=1, keepdims=True)
            chance = rng.standard_normal(normal.shape).astype(np.float32)  # for two vectors of one direction
            normal = np.where(length > 1e-6, normal / np.maximum(length, 1e-6), chance / np.linalg.norm(chance, axis=1, keepdims=True))
            node = np.repeat(np.arange(len(sizes)), sizes)
            along = np.einsum("ij,ij->i", vectors, normal[node])
            order = np.lexsort((along, node))
            rows, vectors, along = rows[order], vectors[order], along[order]
            middle = low + (sizes + 1) // 2
            first = (1 << level) - 1
            self.normals[tree, first : first + len(sizes)] = normal
            self.offsets[tree, first : first + len(sizes)] = (along[middle - 1] + along[middle]) / 2
        self.rows[tree] = rows

    def visited(self, queries: np.ndarray, visits: int) -> np.ndarray:
        """(queries, visits): leaves as tree * leaves + leaf in the order in which one queue over all trees pops them."""
        count, trees, depth, leaves = len(queries), self.trees, self.depth, self.leaves
        if depth == 0:
            return np.zeros((count, 1), np.int64)
        visits = min(visits, trees * leaves)
        queue = np.full((count, trees + visits * depth), -np.inf, np.float32)
        nodes = np.zeros(queue.shape, np.int32)  # tree * 2 leaves + number of the node in its tree, from 1
        queue[:, :trees] = np.inf
        nodes[:, :trees] = np.arange(trees) * 2 * leaves + 1
        held = trees
        every = np.arange(count)
        found = np.empty((count, visits), np.int64)
        for v in range(visits):
            best = queue[:, :held].argmax(1)
            margin = queue[every, best]
            queue[every, best] = -np.inf
            tree, node = np.divmod(nodes[every, best], 2 * leaves)
            for _ in range(depth):
                inner = np.flatnonzero(node < leaves)
                if not len(inner):
                    break
                t, n = tree[inner], node[inner]
                side = np.einsum("ij,ij->i", queries[inner], self.normals[t, n - 1]) - self.offsets[t, n - 1]
                onward = 2 * n + (side >= 0)
                queue[inner, held] = np.minimum(margin[inner], -np.abs(side))
                nodes[inner, held] = t * 2 * leaves + (onward ^ 1)
                node[inner] = onward
                held += 1
            found[:, v] = tree.astype(np.int64) * leaves + node - leaves
        return found

    def _nearest(self, queries: np.ndarray, keep: int) -> np.ndarray:
        cosine = queries @ self.unit.T
        near = np.argpartition(-cosine, keep - 1, axis=1)[:, :keep]
        return np.take_along_axis(near, np.argsort(-np.take_along_axis(cosine, near, 1), axis=1), 1)

    def _block(self, visits: int) -> int:
        """Queries whose queues, or cosines where a leaf is the whole shard, are in memory at a time."""
        return max(16, min(_BLOCK, _ENTRIES // (self.trees + visits * self.depth) if self.depth else _ENTRIES // len(self.unit)))

    def visits_needed(self, probes: np.ndarray, keep: int, least: int, recall: float = RECALL) -> int:
        """Leaves to visit, ``least`` or more, so that this share of the probes' nearest rows is among theirs; the nearest of all, which may be the probe, does not count."""
        n, leaves = len(self.unit), self.leaves
        if self.depth == 0 or n <= keep or least * n >= n * leaves:
            return least
        near = np.concatenate([self._nearest(probes[at : at + 16], keep) for at in range(0, len(probes), 16)])[:, 1:]
        sizes = np.diff(self.bounds)
        held_in = np.empty((self.trees, n), np.int32)
        for tree in range(self.trees):
            held_in[tree, self.rows[tree]] = tree * leaves + np.repeat(np.arange(leaves), sizes)
        visits = least
        while visits < self.trees * leaves:
            first = np.empty(near.shape, np.int64)
            for at in range(0, len(probes), self._block(visits)):
                for k, order in enumerate(self.visited(probes[at : at + self._block(visits)], visits), at):
                    when = np.full(self.trees * leaves, self.trees * leaves)
                    when[order] = np.arange(len(order))
                    first[k] = when[held_in[:, near[k]]].min(0)
            needed = int(np.sort(first, axis=None)[int(np.ceil(recall * first.size)) - 1]) + 1
            if needed <= visits:
                return max(least, needed)
            visits *= 2
        return self.trees * leaves

    def search(self, queries: np.ndarray, keep: int, factor: float, exact) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, cosine) of the best ``keep`` rows in each query's leaves and of those that tie with the last; best first, ties by row.

        ``exact`` gives the cosines of queries and rows, by which the best in single precision are ranked again.
        """
        n = len(self.unit)
        visits = self.visits_needed(queries[:: max(1, len(queries) // PROBES)], keep, int(np.ceil(factor * n**0.5 * self.leaves / n)))
        block = self._block(visits)
        parts = [self._best(queries[at : at + block], at, visits, keep, exact) for at in range(0, len(queries), block)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _best(self, queries: np.ndarray, first: int, visits: int, keep: int, exact):
        """The leaves popped first set a border for each query, which the rows of all later ones must reach."""
        leaf = self.visited(queries, visits)
        q, r, cosine = _ranked(*self._rows_of(queries, leaf[:, :_FIRST], keep, None), keep)
        if leaf.shape[1] > _FIRST:
            ends = np.flatnonzero(np.r_[np.diff(q) != 0, True])
            border = np.where(np.bincount(q, minlength=len(queries)) >= keep, cosine[ends], -np.inf).astype(np.float32) - np.float32(_CLOSE)
            later = self._rows_of(queries, leaf[:, _FIRST:], keep, border)
            q, r, cosine = _ranked(*(np.concatenate(x) for x in zip((q, r, cosine), later)), keep)
        return _ranked(q + first, r, exact(q + first, r), keep)

    def _rows_of(self, queries: np.ndarray, leaf: np.ndarray, keep: int, border: np.ndarray | None):
        """(query, row, cosine) in the leaves of each query: the best of each leaf, or what reaches the query's border."""
        order = np.argsort(leaf, axis=None, kind="stable")
        asked, leaf = order // leaf.shape[1], leaf.ravel()[order]
        starts = np.flatnonzero(np.r_[True, np.diff(leaf) != 0])
        parts = []
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)]):
            tree, at = divmod(int(leaf[start]), self.leaves)
            rows = self.rows[tree, self.bounds[at] : self.bounds[at + 1]]
            who = asked[start:stop]
            cosine = queries[who] @ self.unit[rows].T
            if border is not None:
                least = border[who, None]
            else:
                least = -np.inf if len(rows) <= keep else np.partition(cosine, len(rows) - keep, axis=1)[:, len(rows) - keep, None] - _CLOSE
            q, r = np.nonzero(cosine >= least)
            parts.append((who[q], rows[r], cosine[q, r]))
        return tuple(np.concatenate(x) for x in zip(*parts))


#: Leaves of a query that set its border.
_FIRST = 8
#: Cosines in single precision that may be equal in double precision.
_CLOSE = 1e-6


def _ranked(q: np.ndarray, r: np.ndarray, cosine: np.ndarray, keep: int):
    """Each pair once, in order of query, cosine and row, up to those that tie with the ``keep``-th."""
    order = np.lexsort((r, q))
    q, r, cosine = q[order], r[order], cosine[order]
    once = np.r_[True, (np.diff(q) != 0) | (np.diff(r) != 0)][: len(q)]
    q, r, cosine = q[once], r[once], cosine[once]
    order = np.lexsort((r, -cosine, q))
    q, r, cosine = q[order], r[order], cosine[order]
    starts = np.flatnonzero(np.r_[True, np.diff(q) != 0][: len(q)])
    sizes = np.diff(np.r_[starts, len(q)])
    last = np.repeat(cosine[starts + np.minimum(sizes, keep) - 1], sizes)
    near = cosine >= last - _CLOSE * (cosine.dtype == np.float32)
    return q[near], r[near], cosine[near]


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in the order of rows; every node is halved."""
    bounds = np.array([0, n])
    for _ in range(level):
        halved = np.empty(2 * len(bounds) - 1, np.int64)
        halved[::2] = bounds
        halved[1::2] = bounds[:-1] + (np.diff(bounds) + 1) // 2
        bounds = halved
    return bounds


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float32).reshape(-1, dim)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two arrays, in double precision, to ten digits."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.round(np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)), 10)


_HITS = "_g string, _h long, _own array<string>, _near array<struct<d double, ids array<string>>>"
_DATA, _QUERY = 1, 2


def _search_pair(keep: int, dim: int, trees: int, leaf_rows: int, factor: float):
    """Best classes of a slice's queries in a shard."""
    near = pa.list_(pa.struct([("d", pa.float64()), ("ids", pa.list_(pa.string()))]))
    fields = pa.schema([("_g", pa.string()), ("_h", pa.int64()), ("_own", pa.list_(pa.string())), ("_near", near)])

    def search(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("_h")  # the same forest whatever the order of arrival
        role = np.asarray(batch.column("_role").combine_chunks())
        raw, key, ids = _vectors(batch.column("_u"), dim), np.asarray(batch.column("_h").combine_chunks()), batch.column("_ids").combine_chunks().cast(pa.list_(pa.string()))
        data, asks = np.flatnonzero(role & _DATA), np.flatnonzero(role & _QUERY)
        if not len(data) or not len(asks):
            return fields.empty_table()
        unit = (raw / np.linalg.norm(raw.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
        forest = Forest(unit[data], trees, leaf_rows, len(data))
        q, r, cosine = forest.search(unit[asks], keep + 1, factor, lambda q, r: cosines(raw[asks[q]], raw[data[r]]))
        other = key[asks[q]] != key[data[r]]
        q, r, cosine = q[other], r[other], cosine[other]
        lists = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(q, np.arange(len(asks) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(-cosine), ids.take(pa.array(data[r]))], fields=list(near.value_type))
        )
        return pa.table({"_g": batch.column("_g").take(pa.array(asks)), "_h": key[asks], "_own": ids.take(pa.array(asks)), "_near": lists}, schema=fields)

    return search


def nearest(
    rows: DataFrame, *, group: str, id_: str, vector: str, k: int = K, dim: int = DIM, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
    search_factor: float = SEARCH_FACTOR, shard_rows: int = SHARD_ROWS, slice_rows: int = SLICE_ROWS, exact: bool = False,
) -> DataFrame:
    """(group, id, neighbours array<struct<cosine, id>>): the k most similar other rows of the group, best first, ties by id.

    Vectors that are null, zero, not finite or not of ``dim`` elements take no part; neither do rows without an id or group. Ids must be
    unique. A group with fewer than k + 1 rows gives shorter lists. Columns of other names are ignored. ``exact`` compares all queries with
    all rows, shard by shard.
    """
    if exact:
        trees, leaf_rows = 1, shard_rows * 2
    v = F.col("_v")
    kept = (
        rows.select(F.col(group).cast("string").alias("_g"), F.col(id_).cast("string").alias("_id"), F.col(vector).cast("array<float>").alias("_v"))
        .where(F.col("_g").isNotNull() & F.col("_id").isNotNull() & (F.size("_v") == dim))
        .where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .where(F.exists(v, lambda x: x != 0))
        .select("_g", F.xxhash64("_v").alias("_h"), "_id", "_v")
    )
    kept = cut(kept)  # read again for classes of many copies
    # The first copies by id stand for a class; the limit holds before the shuffle too.
    copies = Window.partitionBy("_g", "_h").orderBy("_id")
    classes = cut(
        kept.withColumn("_r", F.row_number().over(copies))
        .where(F.col("_r") <= k + 2)
        .groupBy("_g", "_h")
        .agg(F.min_by("_v", "_id").alias("_u"), F.array_sort(F.collect_list("_id")).alias("_ids"))
    )
    sizes = classes.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    shards = F.ceil(F.col("_n") / shard_rows).cast("int")
    slices = F.greatest(shards, F.least(F.lit(4), F.ceil(F.col("_n") / slice_rows).cast("int")))
    sizes = sizes.select("_g", shards.alias("_shards"), slices.alias("_slices"))
    own_shard, own_slice = F.pmod(F.xxhash64("_h", F.lit(1)), F.col("_shards")).cast("int"), F.pmod(F.xxhash64("_h", F.lit(2)), F.col("_slices")).cast("int")
    place = lambda a, b, role: F.struct(a.alias("a"), b.alias("b"), role.alias("role"))
    as_data = F.transform(F.sequence(F.lit(0), F.col("_slices") - 1), lambda b: place(F.col("_a"), b, F.when(b == F.col("_b"), _DATA | _QUERY).otherwise(_DATA)))
    as_query = F.transform(F.filter(F.sequence(F.lit(0), F.col("_shards") - 1), lambda a: a != F.col("_a")), lambda a: place(a, F.col("_b"), F.lit(_QUERY)))
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    pairs = (
        classes.join(broadcast_if_small(sizes, 200_000), "_g")
        .withColumns({"_a": own_shard, "_b": own_slice})
        .select("_g", "_h", "_u", "_ids", F.explode(F.concat(as_data, as_query)).alias("_at"))
        .select("_g", F.col("_at.a").alias("_a"), F.col("_at.b").alias("_b"), F.col("_at.role").alias("_role"), "_h", "_u", "_ids")
        .repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_g", "_a", "_b")
    )
    found = pairs.groupBy("_g", "_a", "_b").applyInArrow(_search_pair(k + 1, dim, trees, leaf_rows, search_factor), _HITS)
    if sizes.where("_shards > 1").limit(1).count():
        found = found.groupBy("_g", "_h").agg(F.first("_own").alias("_own"), F.flatten(F.collect_list("_near")).alias("_near"))  # a list of k + 1 from each shard
    entry = lambda d, i: F.struct(d.alias("d"), i.alias("id"))
    listed = F.concat(F.transform("_own", lambda i: entry(F.lit(-1.0), i)), F.flatten(F.transform("_near", lambda x: F.transform(x["ids"], lambda i: entry(x["d"], i)))))
    best = found.select("_g", "_h", "_own", F.slice(F.array_sort(listed), 1, k + 1).alias("_list"))
    few = best.where(F.size("_own") <= k + 1).select("_g", F.explode("_own").alias("_id"), "_list")
    # Classes of more copies: all rows have the same first copies as neighbours, and are spread over salts whatever their number.
    many = classes.where(F.size("_ids") > k + 1).select("_g", "_h", F.transform(F.slice("_ids", 1, k + 1), lambda i: entry(F.lit(-1.0), i)).alias("_list"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    crowd = kept.select("_g", "_h", "_id", F.pmod(F.xxhash64("_id"), F.lit(_SALTS)).cast("int").alias("_salt"))
    crowded = crowd.join(broadcast_if_small(many, 50_000), ["_g", "_h", "_salt"]).select("_g", "_id", "_list")
    return few.unionByName(crowded).select(
        F.col("_g").alias(group),
        F.col("_id").alias(id_),
        F.transform(F.slice(F.filter("_list", lambda x: x["id"] != F.col("_id")), 1, k), lambda x: F.struct((-x["d"]).alias("cosine"), x["id"].alias("id"))).alias("neighbours"),
    )


#: Parts of a class of very many copies.
_SALTS = 16


def current_vectors(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunks of completed runs with a usable vector, one for each (run, plain path, hash), under its smallest id."""
    current = runs.where(F.col("status") == "completed").select(F.col("id").alias("index_run_id"))
    usable = (F.size("embedding") == DIM) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return (
        chunks.select("id", "index_run_id", plain_path(F.col("file_path")).alias("path"), F.lower("content_hash").alias("hash"), "embedding")
        .where(usable)
        .join(broadcast_if_small(current, 200_000), "index_run_id")
        .groupBy("index_run_id", "path", "hash")
        .agg(F.min_by("embedding", "id").alias("embedding"), F.min("id").alias("id"))
        .select("index_run_id", "id", "embedding")
    )


def chunk_neighbours(chunks: DataFrame, runs: DataFrame, **options) -> DataFrame:
    """The five most similar chunks of the same run for every chunk of a current run."""
    return nearest(current_vectors(chunks, runs), group="index_run_id", id_="id", vector="embedding", **options)


def p3_found(spark, sf_dir):
    found = chunk_neighbours(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "index_runs"))
    pairs = found.select("id", F.explode("neighbours").alias("_n")).where(F.col("_n.cosine") >= 0.9)
    return pairs.select(F.least("id", "_n.id").alias("id_a"), F.greatest("id", "_n.id").alias("id_b")).distinct()


def p3_neighbours(spark, sf_dir):
    found = chunk_neighbours(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "index_runs"))
    return found.select("index_run_id", "id", F.posexplode("neighbours").alias("_p", "_n")).select(
        "index_run_id", "id", (F.col("_p") + 1).alias("rank"), F.col("_n.id").alias("neighbour_id"), F.round("_n.cosine", 6).alias("cosine")
    )


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}

#: Brute force over all pairs of a run.
_NEIGHBOURS = r"""WITH v AS (
  SELECT c.index_run_id AS run, min(c.id) AS id, arg_min(c.embedding, c.id) AS e FROM code_chunks c JOIN index_runs r ON r.id = c.index_run_id AND r.status = 'completed'
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY c.index_run_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', ''), lower(content_hash)
), n AS (
  SELECT a.run, a.id, b.id AS other, round(list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]), 10) AS cosine FROM v a JOIN v b ON a.run = b.run AND a.id <> b.id
), k AS (SELECT *, row_number() OVER (PARTITION BY run, id ORDER BY cosine DESC, other) AS rank FROM n QUALIFY rank <= 5)
"""
ORACLE = {
    "p3_found": _NEIGHBOURS + "SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM k WHERE cosine >= 0.9",
    "p3_neighbours": _NEIGHBOURS + "SELECT run AS index_run_id, id, rank::INT AS rank, other AS neighbour_id, round(cosine, 6) AS cosine FROM k",
}
