"""Credentials in source text: their places, and the text without them.

Every line is cut into lexical tokens and labelled by a linear-chain conditional random field
(``secret_crf``); the Viterbi spans are the characters that are redacted. Private keys in armour are one token of
several lines. Replacements keep quotes, length in lines and the code around.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.secret_crf import Crf, Line, lex, private_keys, train
from codeloom.llm.secret_samples import samples
from codeloom.session import table

#: Training lines and seed; both are parameters of the model, not of the data.
TRAINING_LINES = 3000
SEED = 20
#: Longer training lines are left out.
TRAINING_TOKENS = 48
_SPANS = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_BLOCK = re.compile(r"\"\"\"|'''|`")


@lru_cache(maxsize=1)
def model() -> Crf:
    """The trained labeller, made once in a process."""
    lines: list[Line] = []
    labels: list[list[int]] = []
    for text, spans in samples(TRAINING_LINES, SEED):
        line = lex(text)
        if len(line.spans) > TRAINING_TOKENS:
            continue
        label = []
        for s, e in line.spans:
            inside = next(((a, b) for a, b in spans if a <= s and e <= b), None)
            label.append(0 if inside is None else 1 if inside[0] == s else 2)
        lines.append(Line(line.spans, line.features, [o or y == 1 for o, y in zip(line.open, label)]))
        labels.append(label)
    return train(lines, labels)


def secret_spans(text: str | None, crf: Crf) -> list[tuple[int, int, int]]:
    """(line_no from 1, start, end) of every literal secret, offsets in characters of the text."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    armoured = "-----BEGIN" in text
    keys = private_keys(text) if armoured else []
    armour = [(m.start(), max(m.end(), e)) for m, e in _armours(text)] if armoured else []
    fences = [(m.start(), m.group()) for m in _BLOCK.finditer(text)] if '"""' in text or "'''" in text or "`" in text else []
    fence, passed, at, above = "", 0, 0, ""
    for n, line in enumerate(text.split("\n"), 1):
        end = at + len(line)
        while passed < len(fences) and fences[passed][0] < at:
            mark = fences[passed][1]
            fence = mark if not fence else "" if fence == mark else fence
            passed += 1
        if not any(s <= end and at < e for s, e in armour):
            bare = line.lstrip()
            before = above if bare[:1] in ("'", '"', "`") else ""
            found += [(n, at + s, at + e) for s, e in crf.of(line, before, bool(fence) and not _BLOCK.match(bare))]
        above, at = line, end + 1
    for s, e in keys:
        found.append((text.count("\n", 0, s) + 1, s, e))
    found.sort()
    return found


_ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")


def _armours(text: str):
    """Armoured blocks of any kind, with their ends; what is in them is no token of its own."""
    for m in _ARMOUR.finditer(text):
        end = text.find("-----END", m.end())
        yield m, (end if end >= 0 else m.end())


def redacted(text: str | None, spans) -> str | None:
    """The text with each secret replaced by asterisks, line breaks and escapes of line breaks kept."""
    if not text or spans is None or len(spans) == 0:
        return text
    parts, at = [], 0
    for span in spans:
        start, end = span["start"], span["end"]
        if start < at:
            continue
        parts.append(text[at:start])
        parts.append(re.sub(r"\\[nr]|[^\r\n]", lambda m: m.group() if len(m.group()) > 1 else "*", text[start:end]))
        at = end
    parts.append(text[at:])
    return "".join(parts)


def spans_of(content: Column) -> Column:
    """Array of (line_no, start, end) of a text's secrets; the model is trained on the driver and goes with the function."""
    crf = model()

    def label(texts: pd.Series) -> pd.Series:
        found = []
        for text in texts:
            # Copies of a text are labelled once in a batch run; only spans and digests are kept.
            key = (blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "", False) if text else None
            spans = crf.cache.get(key) if key else ()
            if spans is None:
                spans = secret_spans(text, crf)
                crf.cache[key] = spans
            found.append([{"line_no": n, "start": s, "end": e} for n, s, e in spans])
        return pd.Series(found, dtype=object)

    return F.pandas_udf(label, _SPANS)(content)


@F.pandas_udf(T.StringType())
def _redacted(content: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([redacted(c, s) for c, s in zip(content, spans)], dtype=object)


def find_secrets(chunks: DataFrame) -> DataFrame:
    """One row per secret: id, line_no, start, end. Null and empty contents have none; repeated rows count each."""
    return (
        chunks.select("id", spans_of(F.col("content")).alias("_spans"))
        .select("id", F.explode("_spans").alias("_s"))
        .select("id", "_s.line_no", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))
    )


def redact(chunks: DataFrame) -> DataFrame:
    """All chunks (id, content) with asterisks for the characters of secrets, and their number."""
    return chunks.select("id", "content", spans_of(F.col("content")).alias("_spans")).select(
        "id", _redacted("content", "_spans").alias("content"), F.coalesce(F.size("_spans"), F.lit(0)).alias("secrets")
    )


def p4_found(spark, sf_dir):
    return (
        table(spark, sf_dir, "code_chunks")
        .select("id", spans_of(F.col("content")).alias("_spans"))
        .select("id", F.explode(F.array_distinct(F.transform("_spans", lambda s: s["line_no"]))).alias("line_no"))
    )


def p4_redacted(spark, sf_dir):
    return redact(table(spark, sf_dir, "code_chunks"))


def p4_structure(spark, sf_dir):
    """Whether each redacted content has the length, the lines, the quotes and the brackets of the original, and changes exactly where secrets are."""
    chunks = table(spark, sf_dir, "code_chunks").select("id", F.col("content").alias("_before"), spans_of(F.col("content")).alias("_spans"))
    after = chunks.withColumn("_after", _redacted("_before", "_spans"))
    outline = lambda c: F.regexp_replace(c, r"[^\r\n]+", "")
    same_length = F.length("_before") == F.length("_after")
    return after.select(
        "id", same_length.alias("same_length"), (outline(F.col("_before")) == outline(F.col("_after"))).alias("same_lines"), ((F.col("_before") == F.col("_after")) == (F.size("_spans") == 0)).alias("changed_where_found")
    )


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted, "p4_structure": p4_structure}
ORACLE = {"p4_structure": "SELECT id, true AS same_length, true AS same_lines, true AS changed_where_found FROM code_chunks"}
