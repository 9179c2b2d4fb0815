"""Retrieval queries from changed symbols of a diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import NON_CODE_EXTENSIONS, extension, module_name, split_lines

# Names without signal for retrieval, and the forms of definitions and identifiers.
NOISE = (
    "self", "cls", "None", "True", "False",
    "return", "import", "from", "pass", "raise",
    "if", "else", "elif", "for", "while", "with",
    "try", "except", "finally", "and", "or", "not",
    "in", "is", "as", "lambda", "yield", "await",
    "async", "def", "class",
    "str", "int", "float", "bool", "list", "dict",
    "set", "tuple", "len", "range", "print", "type",
    "super", "property", "staticmethod", "classmethod",
)
_IDENTIFIER = r"[a-zA-Z_][\p{L}\p{N}_]*"
_DEFINITION = rf"^(?:async\s+)?def\s+({_IDENTIFIER})"
_CLASS = rf"^class\s+({_IDENTIFIER})"


def changed_lines(hunks: Column) -> Column:
    """Stripped text of added and removed lines, in order."""
    lines = F.flatten(F.transform(hunks, lambda h: split_lines(h["content"])))
    changed = F.filter(lines, lambda x: x.rlike(r"^[+-]"))
    return F.transform(changed, lambda x: F.regexp_replace(F.substring(x, 2, 2**30), r"(?U)^\s+|\s+$", ""))


def line_symbols(line: Column) -> Column:
    """A definition's name, else a class's, else the identifiers that look like names of types or of the domain."""
    function = F.regexp_extract(line, "(?U)" + _DEFINITION, 1)
    class_ = F.regexp_extract(line, "(?U)" + _CLASS, 1)
    tokens = F.regexp_extract_all(line, F.lit(_IDENTIFIER), F.lit(0))
    meaningful = F.filter(tokens, lambda t: t.rlike(r"^[A-Z][a-zA-Z0-9]+") | (t.contains("_") & (F.length(t) > 5)))
    return F.when(function != "", F.array(function)).when(class_ != "", F.array(class_)).otherwise(meaningful)


def symbols_of(lines: Column) -> Column:
    """Distinct symbols of lines in order of appearance, without noise."""
    noise = F.array(*map(F.lit, NOISE))
    found = F.flatten(F.transform(lines, line_symbols))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 3) & ~F.array_contains(noise, t)))


def symbols(hunks: Column) -> Column:
    """Symbols of the changed lines of hunks."""
    return symbols_of(changed_lines(hunks))


def file_queries(files: DataFrame, most: int = 8) -> DataFrame:
    """Adds ``query`` to changed code files: module name and up to ``most`` symbols; removed and non-code files and empty queries drop out."""
    named = files.where(F.col("status") != "removed").where(~extension(F.col("filename")).isin(*NON_CODE_EXTENSIONS))
    listed = named.withColumn("_module", module_name(F.col("filename"))).withColumn("_symbols", F.slice(symbols(F.col("hunks")), 1, most))
    query = F.when(F.size("_symbols") == 0, F.col("_module")).otherwise(F.concat_ws(" ", "_module", F.array_join("_symbols", " ")))
    return listed.withColumn("query", query).where(F.col("query") != "").drop("_module", "_symbols")
