"""Evaluation texts that leak into training texts.

Latent semantic retrieval: passages of all documents and items are rows of a TF-IDF matrix over the items' vocabulary; a
randomised singular value decomposition of it, distributed over the documents, gives each word a latent vector. A passage is the sum of its
words' vectors, so that windows at every place of a document come from running sums. The windows of a document whose cosine with a window of
an item is high are the candidates, and there are no others. Of each candidate the longest common subsequence of words is taken,
and an alignment with a bounded share of altered words decides whether the passage is held; where it is not, a long common
subsequence along with the words that answer the item tells a paraphrase.

The items are held-out material of fixed size: they are taken in blocks of bounded size, which go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.words import words
from codeloom.session import cut, spread, table

MIN_WORDS = 20
#: One altered word in so many.
ALTERED = 10
#: Latent dimensions and further ones of the random sketch.
LATENT, OVERSAMPLE = 128, 16
#: Words of a window, and the step of windows in documents and in items, which divides the window and the margin.
WINDOW, STRIDE = 20, 5
#: Candidates: 0.25 below the least that planted passages with two words altered have (README).
MIN_COSINE = 0.5
#: Least common subsequence of a window with the item around: a passage within the bounds has a window at most two words from its
#: beginning, so 18 words in common less two altered ones, or less one word more where an insertion shifts the rest.
MIN_COMMON = 15
#: A paraphrase has so long a common subsequence with a window and this share of the item's answer words.
PARAPHRASE_COMMON, PARAPHRASE_ANSWER = 11, 0.6
#: Items that one search holds; more are searched in blocks of so many.
ITEM_BLOCK = 2000
#: Words of the item beside a window that may stand opposite it.
_BESIDE = 6
#: A run of intact words that every passage within the bounds has: 18 of 20 words in at most three runs, and longer ones for longer passages.
_RUN = 6
_SEED = 11
#: Empty places between texts that lie in a row.
_MARGIN = 40
#: Words in memory at a time, and words of a document searched at a time.
_PIECE = 40_000
_SEGMENT = 20_000
#: Windows whose cosines are in memory at a time.
_ROWS = 256
#: Candidates whose common subsequences are sought at a time, few enough for the cache of a core.
_PAIRS = 8192


class Items:
    """Encoded items: vocabulary, words as numbers, answer words, and all items in a row with places between them."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        texts = [(i, words(t)) for i, t in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.ids = [i for i, _ in texts]
        self.codes = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in texts]
        # What the item asks about or tells: its numbers and identifiers.
        self.answers = [np.unique([self.vocabulary[w] for w in ws if any(c.isdigit() or c == "_" for c in w)]).astype(np.int32) for _, ws in texts]
        self.begins, self.flat = _in_a_row(self.codes, -2)


def _in_a_row(codes: list[np.ndarray], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins in one array, at a multiple of ``STRIDE``, with at least ``_MARGIN`` blanks around each."""
    lengths = np.array([len(c) for c in codes], np.int64)
    rooms = -(-(lengths + _MARGIN) // STRIDE) * STRIDE
    begins = _MARGIN + np.concatenate([[0], np.cumsum(rooms)])[:-1] if len(lengths) else lengths
    flat = np.full(int(rooms.sum()) + 2 * _MARGIN, blank, np.int32)
    for begin, code in zip(begins, codes):
        flat[begin : begin + len(code)] = code
    return begins, flat


def _encoder(vocabulary: dict[str, int]):
    fields = pa.schema([("doc_id", pa.int64()), ("codes", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [[vocabulary.get(w, -1) for w in words(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.list_(pa.int32()))], schema=fields)

    return encode


def _blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Words of the vocabulary and the passage each is in: documents are cut into passages of ``WINDOW`` words."""
    return _passages(batch.column("codes"))


def _passages(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, int]:
    offsets = np.asarray(column.offsets)
    code = np.asarray(column.values)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    within = np.arange(len(code)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    per_doc = (lengths + WINDOW - 1) // WINDOW
    first = np.concatenate([[0], np.cumsum(per_doc)])
    passage = np.repeat(first[:-1], lengths) + within // WINDOW
    known = code >= 0
    return code[known], passage[known], int(first[-1])


def _summed(frame: DataFrame, size: int, fold: int = 8, most: int = 4) -> np.ndarray:
    """Sum of the arrays in the column ``part`` (bytes of float64): combined in the executors until at most ``most`` are left."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("part").to_pylist():
                array = np.frombuffer(part, np.float64)
                total = array.copy() if total is None else total + array
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = frame.rdd.getNumPartitions()
    while parts > most:
        parts = (parts + fold - 1) // fold
        frame = frame.repartition(parts).mapInArrow(combine, "part binary")
    rows = frame.collect()
    return np.sum([np.frombuffer(r[0], np.float64) for r in rows], axis=0) if rows else np.zeros(size)


def _partial(function, size: int):
    """One array per partition: the sum of ``function`` over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.float64)
        for batch in batches:
            if batch.num_rows:
                function(batch, total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def _weighted(batch: pa.RecordBatch, idf: np.ndarray):
    """Pieces of about ``_PIECE`` words: words, passages from 0, their number, weights of unit passages."""
    code, passage, _ = _blocks(batch)
    starts = np.flatnonzero(np.r_[True, np.diff(passage) != 0]) if len(code) else np.zeros(0, int)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _PIECE)))
        low, high = starts[at], starts[to] if to < len(starts) else len(code)
        part = code[low:high]
        local = np.repeat(np.arange(to - at), np.diff(np.append(starts[at:to], high)))
        weight = idf[part].astype(np.float32)
        scale = 1 / np.sqrt(np.maximum(np.bincount(local, weight * weight, to - at), 1e-12))
        yield part, local, to - at, weight * scale[local].astype(np.float32)
        at = to


def _projected(code, passage, n, weight, basis: np.ndarray) -> np.ndarray:
    """Passages times basis."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    if len(code):
        starts = np.flatnonzero(np.r_[True, np.diff(passage) != 0])
        out[passage[starts]] = np.add.reduceat(basis[code] * weight[:, None], starts, axis=0)
    return out


def fit(encoded: DataFrame, items: Items, latent: int = LATENT, oversample: int = OVERSAMPLE) -> np.ndarray:
    """Latent vectors of the items' words, idf included: two passes of a randomised SVD after one of counting, over all documents and items."""
    own = pa.RecordBatch.from_arrays([pa.array(items.ids, pa.int64()), pa.array(items.codes, pa.list_(pa.int32()))], names=["doc_id", "codes"])

    def total(function, length: int) -> np.ndarray:
        part = np.zeros(length)
        function(own, part)
        return part + _summed(encoded.mapInArrow(_partial(function, length), "part binary"), length)

    size = len(items.vocabulary)
    width = min(latent + oversample, max(1, size))

    def count(batch, into):
        code, passage, n = _blocks(batch)
        pairs = np.unique(passage.astype(np.int64) * size + code)
        into[:size] += np.bincount(pairs % size, minlength=size)
        into[size] += n

    counts = total(count, size + 1)
    idf = np.log((counts[size] + 1) / (counts[:size] + 1)) + 1
    sketch = np.random.default_rng(_SEED).standard_normal((size, width)).astype(np.float32)

    def forward(batch, into):
        for code, passage, n, weight in _weighted(batch, idf):
            y = _projected(code, passage, n, weight, sketch)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            sums = np.add.reduceat(y[passage[order]] * weight[order][:, None], starts, axis=0)
            into.reshape(size, width)[code[order][starts]] += sums

    basis = np.linalg.qr(total(forward, size * width).reshape(size, width))[0].astype(np.float32)

    def gram(batch, into):
        for piece in _weighted(batch, idf):
            y = _projected(*piece, basis)
            into += (y.T @ y).ravel()

    square = basis.shape[1] ** 2
    values, vectors = np.linalg.eigh(total(gram, square).reshape(basis.shape[1], -1))
    top = np.argsort(-values)[:latent]
    return ((basis @ vectors[:, top]) * idf[:, None]).astype(np.float32)


def window_starts(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Starts of the windows of texts that lie in a row, at multiples of ``STRIDE``; the last window of a text reaches its end, a short text is one window."""
    per = -(-np.maximum(0, lengths - WINDOW) // STRIDE) + 1
    return np.repeat(begins, per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * STRIDE


def window_vectors(flat: np.ndarray, starts: np.ndarray, latent: np.ndarray) -> np.ndarray:
    """Unit latent vectors of windows, as sums over the steps of which they consist; blanks and words outside the vocabulary add nothing."""
    known = np.vstack([latent, np.zeros((1, latent.shape[1]), latent.dtype)])[np.where(flat >= 0, flat, len(latent))]
    steps = known[: len(flat) // STRIDE * STRIDE].reshape(-1, STRIDE, latent.shape[1]).sum(1)
    at = starts // STRIDE
    found = sum(steps[at + k] for k in range(WINDOW // STRIDE))
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, norm, out=np.zeros_like(found), where=norm > 1e-6)


def common_words(texts: np.ndarray, patterns: np.ndarray, least: int = 0) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``texts`` with the same row of ``patterns`` (32 words), bit-parallel.

    Rows that can no longer reach ``least`` are given up on the way, with 0.
    """
    width, total = texts.shape[1], len(patterns)
    row = np.full(total, 0xFFFFFFFF, np.uint32)
    kept = np.arange(total)
    for k in range(width):
        match = np.packbits(patterns == texts[:, k : k + 1], axis=1, bitorder="little").view(np.uint32).ravel()
        met = row & match
        row = (row + met) | (row - met)
        if k in _STOPS:
            going = np.flatnonzero(np.bitwise_count(~row) + (width - 1 - k) >= least)
            if len(going) < len(row):
                row, kept, texts, patterns = row[going], kept[going], texts[going], patterns[going]
    found = np.zeros(total, np.int64)
    found[kept] = np.bitwise_count(~row)
    return found


#: Words of a window after which rows are given up.
_STOPS = (8, 11, 14)


def _same(a: list[int], i: int, b: list[int], j: int, step: int) -> int:
    n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
        i, j, n = i + step, j + step, n + 1
    return n


def _reach(a: list[int], i: int, b: list[int], j: int, step: int, spare: int) -> list[int]:
    """Most words of ``b`` from j on that align with ``a`` from i on, the last one intact, for 0, 1, ... altered words (-1 for none).

    On each diagonal only the furthest place counts. It ends where ten times the altered words exceed the words reached by more than
    ``spare``, the most that the other side can add.
    """
    n = _same(a, i, b, j, step)
    best, front = [n], {0: n}  # diagonal (words of a less words of b) -> words of b
    left = len(b) - j if step > 0 else j + 1
    while front:
        errors = len(best)
        top = -1
        following: dict[int, int] = {}
        for diagonal, m in front.items():
            for d, reached in ((diagonal, m + 1), (diagonal + 1, m), (diagonal - 1, m + 1)):
                if reached > left or not 0 <= i + (reached + d) * step <= len(a):
                    continue
                run = _same(a, i + (reached + d) * step, b, j + reached * step, step)
                if run:
                    top = max(top, reached + run)
                if reached + run > following.get(d, -1):
                    following[d] = reached + run
        best.append(top)
        furthest = max(following.values(), default=0)
        front = following if ALTERED * errors <= min(furthest + spare, left + spare) else {}
    return best


def holds(doc: list[int], p: int, item: list[int], q: int, min_words: int = MIN_WORDS, altered: int = ALTERED) -> bool:
    """Whether a passage with ``min_words`` words of the item or more aligns around doc[p] = item[q], at most one in ``altered`` altered.

    Words are altered where one is replaced, left out or put in; the first and the last word are intact.
    """
    right = _reach(doc, p, item, q, 1, q)
    left = _reach(doc, p - 1, item, q - 1, -1, max(right))
    return any(r > 0 and m >= 0 and r + m >= min_words and (e + f) * altered <= r + m for e, r in enumerate(right) for f, m in enumerate(left))


def _anchors(doc: list[int], low: int, high: int, places: dict[int, list[int]], item: list[int]) -> Iterator[tuple[int, int]]:
    """First words of intact runs of at least ``_RUN`` words between doc[low:high] and the item."""
    for p in range(low, high):
        for q in places.get(doc[p], ()):
            if (p == low or q == 0 or doc[p - 1] != item[q - 1]) and doc[p : p + _RUN] == item[q : q + _RUN] and q + _RUN <= len(item):
                yield p, q


_FOUND = "doc_id long, item_id long, kind string, cosine float, common int, answer float"


def _searcher(items: Items, latent: np.ndarray, min_cosine: float, paraphrases: bool = False):
    least = PARAPHRASE_COMMON if paraphrases else MIN_COMMON
    kind = np.int16 if len(items.vocabulary) < 32_000 else np.int32  # narrow numbers compare faster
    lengths = np.array([len(c) for c in items.codes], np.int64)
    long = np.flatnonzero(lengths >= MIN_WORDS)
    targets = window_starts(items.begins[long], lengths[long])
    owner = np.searchsorted(items.begins, targets, "right") - 1
    target_vectors = window_vectors(items.flat, targets, latent).T.copy()
    around = np.arange(-_BESIDE, WINDOW + _BESIDE)
    narrow_items = items.flat.astype(kind)
    lists = [c.tolist() for c in items.codes]
    places: list[dict[int, list[int]]] = []
    for code in lists:
        where: dict[int, list[int]] = {}
        for q, w in enumerate(code):
            where.setdefault(w, []).append(q)
        places.append(where)
    fields = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("cosine", pa.float32()), ("common", pa.int32()), ("answer", pa.float32())])

    def candidates(flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, windows of items, cosine) wherever the cosine is high enough."""
        vectors = window_vectors(flat, starts, latent)
        for at in range(0, len(starts), _ROWS):
            close = (vectors[at : at + _ROWS] @ target_vectors).ravel()
            hot = np.flatnonzero(close >= min_cosine)
            if len(hot):
                w, t = np.divmod(hot, len(targets))
                yield starts[at + w], t, close[hot]

    def segment(codes: list[np.ndarray], names: list[int], out: dict[tuple[int, int], tuple]) -> None:
        """Adds what the texts hold, as (kind, cosine, common, answer) by (text, item); a passage is more than a paraphrase."""
        begins, flat = _in_a_row(codes, -3)
        narrow = flat.astype(kind)
        sizes = np.array([len(c) for c in codes], np.int64)
        kept: list[tuple[np.ndarray, ...]] = []
        for start, t, cosine in candidates(flat, window_starts(begins, sizes)):
            for low in range(0, len(start), _PAIRS):
                part = slice(low, low + _PAIRS)
                common = common_words(narrow[start[part, None] + np.arange(WINDOW)], narrow_items[targets[t[part], None] + around], least)
                good = common >= least
                kept.append((start[part][good], owner[t[part][good]], cosine[part][good], common[good]))
        if not sum(len(k[0]) for k in kept):
            return
        start, item, cosine, common = (np.concatenate(x) for x in zip(*kept))
        text = np.searchsorted(begins, start, "right") - 1
        order = np.lexsort((-cosine, -common, item, text))
        start, item, cosine, common, text = start[order], item[order], cosine[order], common[order], text[order]
        first = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(item) != 0)])
        held: dict[int, list[int]] = {}
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(start)]):
            d, n = int(text[a]), int(item[a])
            pair, best = (names[d], n), (float(cosine[a:b].max()), int(common[a]))
            if pair in out and out[pair][0] == "passage":
                continue
            if d not in held:
                held = {d: codes[d].tolist()}
            passage = False
            tried: set[tuple[int, int]] = set()  # windows overlap, and so do their runs
            for k in range(a, b):
                if common[k] < MIN_COMMON or passage:
                    break
                p = int(start[k] - begins[d])
                for i, j in _anchors(held[d], max(0, p - _BESIDE), min(p + WINDOW, len(held[d])), places[n], lists[n]):
                    run = i - _same(held[d], i - 1, lists[n], j - 1, -1), i - j  # its first word and diagonal
                    if run not in tried:
                        tried.add(run)
                        passage = passage or holds(held[d], i, lists[n], j)
            if not passage and not paraphrases:
                continue
            answer = items.answers[n]
            share = float(np.isin(answer, codes[d]).mean()) if len(answer) else 0.0
            if passage or share >= PARAPHRASE_ANSWER:
                before = out.get(pair, ("", -1.0, 0, 0.0))
                out[pair] = ("passage" if passage else "paraphrase", max(best[0], before[1]), max(best[1], before[2]), max(share, before[3]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int], tuple] = {}
            column = batch.column("codes")
            offsets = np.asarray(column.offsets)
            values = np.asarray(column.values)
            codes: list[np.ndarray] = []
            names: list[int] = []
            held = 0
            for row in range(batch.num_rows if len(targets) else 0):
                whole = values[offsets[row] : offsets[row + 1]]
                if len(whole) < MIN_WORDS - MIN_WORDS // ALTERED:
                    continue
                for low in range(0, max(1, len(whole) - 2 * WINDOW), _SEGMENT):  # pieces of a long text overlap by more than an item's passage needs
                    codes.append(whole[low : low + _SEGMENT + 4 * WINDOW])
                    names.append(row)
                    held += len(codes[-1])
                    if held >= _SEGMENT:
                        segment(codes, names, out)
                        codes, names, held = [], [], 0
            if codes:
                segment(codes, names, out)
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[r], items.ids[n], *found) for (r, n), found in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in rows], fields.field(k).type) for k in range(len(fields))], schema=fields)

    return search


def find_leaks(documents: DataFrame, items: DataFrame, *, min_cosine: float = MIN_COSINE, paraphrases: bool = False, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, kind, cosine, common, answer): documents that hold at least 20 consecutive words of an item, one in ten altered at most.

    ``kind`` is passage, or paraphrase if those are asked for: a window with a long common subsequence in a document that has most of
    the item's answer words. Rows with null ids are left out; null, empty and short texts hold nothing; repeated rows and repeated items each give their
    pairs, a pair once. Whole texts are searched, by as many blocks of items as there are.
    """
    documents = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    found: DataFrame | None = None
    block: list[tuple[int, str]] = []

    def searched(rows: list[tuple[int, str]]) -> DataFrame | None:
        held = Items(rows)
        if not held.vocabulary:
            return None
        encoded = cut(spread(documents).mapInArrow(_encoder(held.vocabulary), "doc_id long, codes array<int>"))
        return encoded.mapInArrow(_searcher(held, fit(encoded, held), min_cosine, paraphrases), _FOUND)

    for row in items.where(F.col("item_id").isNotNull()).select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((row[0], row[1] or ""))
        if len(block) == item_block:
            part = searched(block)
            found, block = part if found is None else found if part is None else found.unionByName(part), []
    part = searched(block) if block else None
    found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame([], _FOUND)
    strongest = F.struct(F.col("kind") == "passage", "cosine", "common", "answer")
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("kind", "cosine", "common", "answer"), strongest).alias("_f")).select("doc_id", "item_id", "_f.*")


def p9_found(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_items(spark, sf_dir):
    """Which items leaked, and into how many documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p9_paraphrases(spark, sf_dir):
    """Documents that hold no passage of an item but much of its wording and its answer words."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), paraphrases=True)
    return found.where("kind = 'paraphrase'").select("doc_id", "item_id", "common", F.round("answer", 3).alias("answer"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items, "p9_paraphrases": p9_paraphrases}
ORACLE: dict[str, str] = {}
