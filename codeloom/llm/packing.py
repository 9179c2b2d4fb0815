"""Filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

Bound-certified repacking: items are spread over partitions by hash, each packed by best-fit decreasing. Dual feasible functions give a
lower bound on the containers that any packing of a partition needs; a partition that meets its bound is certified. Partitions with
gaps, and the least filled container of the others, give their items up; these meet in as many partitions as their number fills and are packed again,
until the whole meets the bound for all items, one partition is left or hardly fewer would be.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut, spread, table

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Items packed in one task, in the last round too.
PARTITION_ITEMS = 40_000
#: A container filled this far is never opened again.
FULL = 0.995
#: Parameters of the dual feasible functions: thresholds in 32nds of the capacity, and roundings.
_THRESHOLDS = range(1, 17)
_ROUNDINGS = range(1, 21)

_ITEMS = "doc_id long, piece_no int, token_from int, token_to int, size int"
_PACKED = _ITEMS + ", container_id string, loose boolean, bound int"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """Token ranges: one for a text that fits, else full ones and the rest."""
    return [(a, min(tokens, a + capacity)) for a in range(0, tokens, capacity)] or [(0, 0)]


def sized_items(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece_no, token_from, token_to, size: the texts in tokens, cut only where one exceeds the capacity. Null is empty."""
    types = {"doc_id": pa.int64(), "piece_no": pa.int32(), "token_from": pa.int32(), "token_to": pa.int32(), "size": pa.int32()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n = len(encoding.encode_ordinary(text)) if text else 0
                rows += [(doc_id, k, a, b, b - a) for k, (a, b) in enumerate(pieces(n, capacity), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))

    return spread(documents.select("doc_id", "text")).mapInArrow(measure, _ITEMS)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs, by the best of a family of dual feasible functions; ``counts`` has the items of each size."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for t in _THRESHOLDS:  # sizes above capacity - e count whole, below e not at all
        e = capacity * t // 32
        mass = sum((capacity if s > capacity - e else s if s >= e else 0) * n for s, n in counts.items())
        best = max(best, -(-mass // capacity))
    for k in _ROUNDINGS:  # x keeps its size where (k + 1) x is whole, else rounds to k-ths
        mass = sum((s * k if (k + 1) * s % capacity == 0 else (k + 1) * s // capacity * capacity) * n for s, n in counts.items())
        best = max(best, -(-mass // (capacity * k)))
    return max(best, 1 if counts else 0)


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(container of each item, free room of each container); ``sizes`` in falling order. Rooms are found in a bit set."""
    rooms: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    chosen = []
    for size in sizes:
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            at, room = len(rooms), capacity
            rooms.append(capacity)
        rooms[at] = room - size
        by_room[room - size].append(at)
        mask |= 1 << (room - size)
        chosen.append(at)
    return chosen, rooms


def _packer(capacity: int, round_no: int, last: bool):
    fields = pa.schema(
        [("doc_id", pa.int64()), ("piece_no", pa.int32()), ("token_from", pa.int32()), ("token_to", pa.int32()), ("size", pa.int32())]
        + [("container_id", pa.string()), ("loose", pa.bool_()), ("bound", pa.int32())]
    )

    def pack(group: pa.Table) -> pa.Table:
        part = group.column("_part")[0].as_py()
        group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece_no", "ascending")])
        sizes = group.column("size").to_pylist()
        chosen, rooms = best_fit_decreasing(sizes, capacity)
        counts: dict[int, int] = {}
        for s in sizes:
            counts[s] = counts.get(s, 0) + 1
        bound = lower_bound(counts, capacity)
        gap = len(rooms) - bound
        opened: set[int] = set()
        if not last:
            order = sorted(range(len(rooms)), key=lambda b: -rooms[b])
            opened = {b for b in order[: 4 * gap + 1] if rooms[b] > (1 - FULL) * capacity}
        return pa.table(
            [group.column(c) for c in ("doc_id", "piece_no", "token_from", "token_to", "size")]
            + [pa.array([f"{round_no}-{part}-{b}" for b in chosen]), pa.array([b in opened for b in chosen]), pa.array([bound] * len(chosen), pa.int32())],
            schema=fields,
        )

    return pack


def pack(items: DataFrame, capacity: int = CAPACITY, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """Items with ``container_id``; no container holds more than ``capacity``, which no item may exceed.

    Items of size 0 go with others. Repeated rows are items each. The result is the same for the same rows. No round packs more than about
    ``partition_items`` in a task: the loose items of a round are counted, and where they would not fit into half as many partitions as
    before, their next packing is the last.
    """
    items = cut(items)
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    bound = lower_bound(histogram, capacity)
    parts = max(1, -(-sum(histogram.values()) // partition_items))
    # The bound is met by many containers that are full to the last token; the exchange can stop once it is.
    closed: list[DataFrame] = []
    done = 0
    loose = items
    round_no = 0
    last = parts == 1
    while True:
        spread = F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(round_no)), F.lit(parts)).cast("int")
        packed = cut(loose.withColumn("_part", spread).groupBy("_part").applyInArrow(_packer(capacity, round_no, last), _PACKED))
        open_container = F.when(F.col("loose"), F.col("container_id"))
        n = packed.agg(F.count_distinct("container_id").alias("all"), F.count_distinct(open_container).alias("loose"), F.count_if("loose").alias("items")).first()
        if last or n["loose"] == 0 or done + n["all"] <= bound:
            closed.append(packed)
            break
        closed.append(packed.where(~F.col("loose")))
        done += n["all"] - n["loose"]
        loose = packed.where("loose").select("doc_id", "piece_no", "token_from", "token_to", "size")
        before, parts = parts, max(1, -(-n["items"] // partition_items))
        last = parts == 1 or parts > before // 2
        round_no += 1
    result = closed[0]
    for more in closed[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "piece_no", "token_from", "token_to", "size", "container_id")


def p8_containers(spark, sf_dir):
    return pack(sized_items(table(spark, sf_dir, "documents")))


def p8_fill(spark, sf_dir):
    """Containers, their mean fill, and the lower bound that certifies their number."""
    packed = pack(sized_items(table(spark, sf_dir, "documents")))
    histogram = {r["size"]: r["n"] for r in packed.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    return packed.agg(
        F.count_distinct("container_id").alias("containers"),
        F.lit(lower_bound(histogram, CAPACITY)).cast("long").alias("lower_bound"),
        F.sum("size").alias("tokens"),
        F.round(F.sum("size") / (F.count_distinct("container_id") * CAPACITY), 6).alias("fill"),
    )


def p8_placed(spark, sf_dir):
    """Every document's pieces: whether they cover it without a gap, and whether one was cut although it fits; containers above capacity come as rows without a document."""
    packed = pack(sized_items(table(spark, sf_dir, "documents")))
    placed = packed.groupBy("doc_id").agg(
        (F.sum("size") == F.max("token_to")).alias("covered"), ((F.count(F.lit(1)) > 1) & (F.max("token_to") <= CAPACITY)).alias("needlessly_cut")
    )
    overfull = packed.groupBy("container_id").agg(F.sum("size").alias("_n")).where(F.col("_n") > CAPACITY)
    return placed.unionByName(overfull.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("covered"), F.lit(None).cast("boolean").alias("needlessly_cut")))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_placed": p8_placed}
ORACLE = {"p8_placed": "SELECT doc_id, true AS covered, false AS needlessly_cut FROM documents"}
