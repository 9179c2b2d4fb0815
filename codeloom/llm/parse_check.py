"""Source files that do not parse, by the grammar of their suffix.

Each file is parsed by its own grammar. One that fails is parsed by all the other grammars, in the order of a
ranking by language-specific tokens: the first success names the language the text really is in, and a text that no
grammar takes is corrupt. A text that is nested more deeply than a reader goes is left undecided.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ecma import EcmaDepthError, EcmaError, parse
from codeloom.session import spread, table

#: Grammars by suffix.
GRAMMARS = ("py", "js", "jsx", "ts", "tsx")
_SCHEMA = "index_run_id string, repo_id string, rel_path string, language string, parses boolean, parsed_as string, error string, error_line int"
_ARROW = pa.schema(
    [(c, pa.string()) for c in ("index_run_id", "repo_id", "rel_path", "language")]
    + [("parses", pa.bool_()), ("parsed_as", pa.string()), ("error", pa.string()), ("error_line", pa.int32())]
)
_SIGNS = {
    "py": re.compile(r"^[ \t]*(?:def|elif|except|from|with|class)\b[^\n{]*:?[ \t]*$|\bself\b|^[ \t]*#|\bNone\b", re.M),
    "js": re.compile(r"\b(?:function|const|let|var|require|typeof)\b|=>|===|//|[;{]$", re.M),
    "ts": re.compile(r"\b(?:interface|readonly|enum|implements|namespace|declare)\b|:\s*(?:string|number|boolean|unknown|void|any)\b|\bas\s+[A-Z]|<[A-Z]\w*>\(", re.M),
    "jsx": re.compile(r"</[A-Za-z.]*>|/>|<[A-Z]\w*[\s>]|className=", re.M),
}


def text_of(content: bytes | None) -> str:
    """UTF-8, else latin-1; a byte order mark at the start is no part of the text and null is empty."""
    if content is None:
        return ""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return text.removeprefix("﻿")


class TooDeep(Exception):
    """The reader's limits end before the text does."""


def parse_error(text: str, language: str) -> tuple[str, int] | None:
    """Message and line where the text does not parse as the language, else None; ``TooDeep`` where that stays open. An empty text parses."""
    if language == "py":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        except (RecursionError, MemoryError):
            raise TooDeep from None
        except (SyntaxError, ValueError) as error:
            return str(getattr(error, "msg", None) or error), int(getattr(error, "lineno", None) or 0)
        return None
    try:
        parse(text, ts=language in ("ts", "tsx"), jsx=language in ("jsx", "tsx"))
    except EcmaDepthError:
        raise TooDeep from None
    except EcmaError as error:
        return str(error), error.line
    return None


def ranked_languages(text: str) -> list[str]:
    """All grammars, the likeliest first, by counts of tokens that mark a language."""
    n = {k: len(sign.findall(text)) for k, sign in _SIGNS.items()}
    score = {"py": 2 * n["py"], "js": n["js"], "jsx": n["js"] + 3 * n["jsx"] - 0.5, "ts": n["js"] + 3 * n["ts"] - 0.5, "tsx": n["js"] + 3 * (n["ts"] + n["jsx"]) - 1}
    return sorted(GRAMMARS, key=lambda k: (-score[k], GRAMMARS.index(k)))


def verdict(text: str, language: str) -> tuple[bool | None, str | None, str | None, int | None]:
    """Whether the text parses by its own grammar (null if that stays open), the grammar that takes it, and the error with its line."""
    try:
        error = parse_error(text, language)
    except TooDeep:
        return None, None, "nested too deeply", None
    if error is None:
        return True, language, None, None
    for other in ranked_languages(text):
        try:
            if other != language and parse_error(text, other) is None:
                return False, other, *error
        except TooDeep:
            continue
    return False, None, *error


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        language = batch.column("language").to_pylist()
        found = [verdict(text_of(c), k) if k in GRAMMARS else (None, None, "no grammar", None) for c, k in zip(batch.column("content").to_pylist(), language)]
        columns = [batch.column(c) for c in ("index_run_id", "repo_id", "rel_path")]
        columns += [pa.array(language, pa.string()), *(pa.array([f[i] for f in found], _ARROW.field(4 + i).type) for i in range(4))]
        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def check_files(files: DataFrame) -> DataFrame:
    """One row per file: parses, the grammar that takes it (parsed_as), first error and its line.

    The language is the suffix of ``rel_path``, else the ``language`` column; a file of neither has null in
    ``parses``, as has one nested too deeply to tell. Null and empty contents parse. Repeated rows count each; further columns are left out.
    """
    suffix = F.lower(F.regexp_extract("rel_path", r"\.([A-Za-z]+)$", 1))
    return spread(files.select(
        "index_run_id", "repo_id", "rel_path", F.when(suffix.isin(*GRAMMARS), suffix).otherwise(F.col("language")).alias("language"), "content"
    )).mapInArrow(_check, _SCHEMA)


def failure_rates(checked: DataFrame) -> DataFrame:
    """Files, failing files by kind, and the failing share for each repository and language."""
    failing = F.count_if(~F.col("parses"))
    return checked.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("files"),
        failing.alias("failing"),
        F.count_if(~F.col("parses") & F.col("parsed_as").isNotNull()).alias("wrong_extension"),
        F.count_if(~F.col("parses") & F.col("parsed_as").isNull()).alias("corrupt"),
        F.count_if(F.col("parses").isNull()).alias("undecided"),
        F.round(failing / F.count(F.lit(1)), 6).alias("failing_share"),
    )


def p7_found(spark, sf_dir):
    return check_files(table(spark, sf_dir, "source_files")).where(~F.col("parses")).select("index_run_id", "rel_path")


def p7_rates(spark, sf_dir):
    return failure_rates(check_files(table(spark, sf_dir, "source_files")))


QUERIES = {"p7_found": p7_found, "p7_rates": p7_rates}
ORACLE: dict[str, str] = {}
