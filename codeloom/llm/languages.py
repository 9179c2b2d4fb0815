"""Language of documents and of the paragraphs that depart from it, with hyperdimensional profiles.

Each letter has a random vector of signs. An n-gram is the product (binding) of its letters' vectors, each permuted by its place;
a text is the sum (bundle) of its n-grams; a language is the bundle of its texts. A text has the language whose prototype is nearest by
cosine. Prototypes are fitted on a bounded sample of labelled documents: labels of the sample that the first profiles contradict
are left out in a second round, and a few rounds of correction move prototypes by the texts they get wrong.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.words import mended
from codeloom.session import spread, table

LANGUAGES = ("en", "de", "fr", "es", "pt", "it")
DIM = 1024
GRAM = 3
#: The sample for fitting: labelled documents of each language, none longer than so many characters.
SAMPLE_PER_LANGUAGE = 300
SAMPLE_CHARS = 4000
#: Paragraphs with fewer letters count only where the language is this sure.
MIN_LETTERS, SURE = 20, 0.95
_SEED = 3

# Names and codes of the languages.
_NAMES = {
    "en": "en eng english englisch anglais ingles inglés inglese",
    "de": "de deu ger german deutsch allemand aleman alemán alemao alemão tedesco",
    "fr": "fr fra fre french francais français franzosisch französisch frances francés francês francese",
    "es": "es spa spanish espanol español spanisch espagnol espanhol spagnolo castellano",
    "pt": "pt por portuguese portugues português portugiesisch portugais portugués portoghese",
    "it": "it ita italian italiano italienisch italien",
}
_CODES = {name: code for code, names in _NAMES.items() for name in names.split()}

_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})")
_INLINE = re.compile(r"`[^`\n]*`|</?[A-Za-z][^<>\n]*>")
#: Words that are addresses, paths, identifiers, calls or hold digits.
_CODEY = re.compile(r"[^\W_][_./\\@]+[^\W_]|\d|\w\(\)|://")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def label_language(label: str | None) -> str | None:
    """Two-letter code that a label names in any notation; None where it names none of the languages."""
    if not label:
        return None
    parts = re.split(r"[^\w]+|_", label.strip().lower())
    return _CODES.get(parts[0]) if parts and parts[0] else None


def paragraphs(text: str) -> list[tuple[str, bool]]:
    """(paragraph, is fenced code) in order: paragraphs end at blank lines, a fenced block is one with all its lines."""
    found: list[tuple[str, bool]] = []
    current: list[str] = []
    fence = ""
    for line in re.split(r"\r\n|\r|\n", text):
        m = _FENCE.match(line)
        if fence:
            current.append(line)
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not line.strip().strip(fence[0]):
                found.append(("\n".join(current), True))
                current, fence = [], ""
        elif m:
            if current:
                found.append(("\n".join(current), False))
            current, fence = [line], m.group(1)
        elif not line.strip():
            if current:
                found.append(("\n".join(current), False))
            current = []
        else:
            current.append(line)
    if current:
        found.append(("\n".join(current), bool(fence)))
    return found


def prose(paragraph: str) -> str:
    """Words of a paragraph in lower case with single spaces, without code, tags, addresses and identifiers."""
    text = mended(paragraph)
    if "`" in text or "<" in text:
        text = _INLINE.sub(" ", text)
    plain = " ".join([w for w in text.split() if not _CODEY.search(w)])
    return " ".join(_LETTERS.findall(plain.lower().replace("’", "'")))


@lru_cache(maxsize=8192)
def _letter(c: str) -> np.ndarray:
    return (np.random.default_rng((_SEED, ord(c))).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)


def _gram(gram: str) -> np.ndarray:
    """Binding of permuted letters."""
    bound = np.ones(DIM, np.int8)
    for place, c in enumerate(gram):
        bound = bound * np.roll(_letter(c), place)
    return bound


class _Grams:
    """Vectors of the n-grams met so far, by row; begun anew when full."""

    def __init__(self, rows: int = 32_768):
        self.rows = rows
        self.index: dict[str, int] = {}
        self.vectors = np.empty((256, DIM), np.int8)

    def of(self, grams) -> np.ndarray:
        index = self.index
        try:
            return self.vectors[[index[g] for g in grams]]
        except KeyError:
            pass
        if len(index) + len(grams) > self.rows:
            index.clear()
        found = []
        for g in grams:
            at = index.get(g)
            if at is None:
                at = index[g] = len(index)
                if at == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                self.vectors[at] = _gram(g)
            found.append(at)
        return self.vectors[found]


_GRAMS = _Grams()


def bundle(text: str) -> np.ndarray:
    """Unit vector of a text: the sum of its n-grams, square roots of counts as weights; zero for a text without letters."""
    if not text:
        return np.zeros(DIM, np.float32)
    padded = f" {text} "
    counts = Counter([padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)])
    vector = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts))) @ _GRAMS.of(counts).astype(np.float32)
    norm = np.linalg.norm(vector)
    return vector / norm if norm > 0 else vector


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def fit_prototypes(texts: list[str], labels: list[str], rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(common vector, prototypes): the part that all languages share is taken off before texts are compared."""
    x = np.stack([bundle(t) for t in texts]) if texts else np.zeros((0, DIM), np.float32)
    y = np.array([LANGUAGES.index(k) for k in labels], int)
    keep = np.ones(len(y), bool)
    common = np.zeros(DIM, np.float32)
    prototypes = np.zeros((len(LANGUAGES), DIM), np.float32)
    for _ in range(3):
        sums = np.stack([x[keep & (y == k)].mean(0) if (keep & (y == k)).any() else np.zeros(DIM, np.float32) for k in range(len(LANGUAGES))])
        present = np.linalg.norm(sums, axis=1) > 0
        common = sums[present].mean(0) if present.any() else common
        prototypes = _units(np.where(present[:, None], sums - common, 0))
        keep = (x @ prototypes.T - common @ prototypes.T).argmax(1) == y if len(y) else keep
    centred = _units(x - common)
    for _ in range(rounds):
        wrong = 0
        for i in np.flatnonzero(keep):
            scores = prototypes @ centred[i]
            best = int(scores.argmax())
            rival = int(np.argsort(-scores)[1]) if best == y[i] else best
            if best != y[i] or scores[y[i]] - scores[rival] < 0.05:
                wrong += 1
                prototypes[y[i]] += 0.05 * centred[i]
                prototypes[rival] -= 0.05 * centred[i]
        prototypes = _units(prototypes)
        if not wrong:
            break
    return common.astype(np.float32), prototypes.astype(np.float32)


class Profiles:
    """Fitted prototypes."""

    def __init__(self, common: np.ndarray, prototypes: np.ndarray):
        self.common, self.prototypes = common, prototypes

    def language(self, text: str) -> tuple[str | None, float]:
        """Language of prose and the confidence in it: the share of the best prototype in a softmax of cosines."""
        if not text:
            return None, 0.0
        vector = bundle(text) - self.common
        scores = self.prototypes @ (vector / max(1e-9, float(np.linalg.norm(vector))))
        weights = np.exp((scores - scores.max()) * 20)
        best = int(scores.argmax())
        return LANGUAGES[best], float(weights[best] / weights.sum())

    def document(self, text: str | None) -> tuple[str | None, float, list[tuple[int, str, float]]]:
        """Main language, its confidence, and (number, language, confidence) of the paragraphs that depart from it."""
        parts = []
        for number, (paragraph, fenced) in enumerate(paragraphs(text or ""), 1):
            words = "" if fenced else prose(paragraph)
            if words:
                parts.append((number, len(words), *self.language(words)))
        # A few letters tell little: they have no vote beside longer paragraphs, and depart from none.
        telling = [p for p in parts if p[1] >= MIN_LETTERS or p[3] >= SURE]
        parts = telling or parts
        if not parts:
            return None, 0.0, []
        mass: dict[str, float] = {}
        sure: dict[str, float] = {}
        for _, n, language, confidence in parts:
            mass[language] = mass.get(language, 0) + n
            sure[language] = sure.get(language, 0) + n * confidence
        main = max(mass, key=lambda k: mass[k])
        return main, sure[main] / sum(mass.values()), [(k, language, c) for k, _, language, c in parts if language != main]


def fit(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, max_chars: int = SAMPLE_CHARS) -> Profiles:
    """Profiles from at most ``per_language`` labelled documents of each language, picked by the hash of their text."""
    code = F.lower(F.regexp_extract(F.trim("lang"), r"^([^\W_]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    picked = (
        documents.select("text", known[code].alias("_label"))
        .where(F.col("_label").isNotNull() & F.col("text").isNotNull() & F.length("text").between(40, max_chars))
        .withColumn("_r", F.row_number().over(Window.partitionBy("_label").orderBy(F.xxhash64("text"), "text")))
        .where(F.col("_r") <= per_language)
        .select("text", "_label")
        .collect()
    )
    texts, labels = [], []
    for text, label in sorted((r[0], r[1]) for r in picked):
        for paragraph, fenced in paragraphs(text):
            words = "" if fenced else prose(paragraph)
            if len(words) >= 30:
                texts.append(words)
                labels.append(label)
    return Profiles(*fit_prototypes(texts, labels))


_FIELDS = pa.schema([("doc_id", pa.int64()), ("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("label", pa.string())])


def _labeller(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                main, confidence, others = profiles.document(text)
                rows.append((doc_id, 0, main, confidence, label))
                rows += [(doc_id, number, language, c, None) for number, language, c in others]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _FIELDS.field(k).type) for k in range(5)], schema=_FIELDS)

    return run


def identify(documents: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, label): a row for each document (seg_no 0) and for each paragraph in another language.

    Null, empty and all-code texts get a row with null lang. Repeated rows count each. Whole texts are read; paragraphs are numbered
    from 1, fenced code included.
    """
    profiles = profiles or fit(documents)
    return spread(documents.select("doc_id", "text", "lang")).mapInArrow(
        _labeller(profiles), "doc_id long, seg_no int, lang string, confidence double, label string"
    )


def mislabelled(documents: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """Documents whose label is missing or names another language than the main one, and all departing paragraphs."""
    code = F.lower(F.regexp_extract(F.trim("label"), r"^([^\W_]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return identify(documents, profiles).where(F.col("lang").isNotNull() & ((F.col("seg_no") > 0) | ~known[F.coalesce(code, F.lit(""))].eqNullSafe(F.col("lang"))))


def p10_found(spark, sf_dir):
    return mislabelled(table(spark, sf_dir, "documents")).select("doc_id", "seg_no", "lang")


def p10_languages(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"))


QUERIES = {"p10_found": p10_found, "p10_languages": p10_languages}
ORACLE: dict[str, str] = {}
