"""Text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line separators as in str.splitlines, and names that are never indexed or queried.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SKIPPED_DIRECTORIES = (".git", ".github", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", "coverage", ".pytest_cache", "migrations")
SKIPPED_FILES = (".env", ".env.example", ".gitignore", "package-lock.json", "yarn.lock", "poetry.lock")
CODE_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".jsx")
NON_CODE_EXTENSIONS = (".md", ".rst", ".txt", ".json", ".yaml", ".yml", ".lock", ".toml", ".cfg", ".ini", ".png", ".jpg", ".jpeg", ".svg")


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a final break opens no further line and an empty text has none."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def content_hash(content: Column, path: Column) -> Column:
    """SHA-256 of the content followed by the path, as hexadecimal digits."""
    return F.sha2(F.concat(content, path), 256)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot, empty where there is none; a leading dot begins no suffix."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the whole path, with the dot."""
    return F.lower(F.regexp_extract(path, r"(?s)(\.[^.]*)$", 1))


def indexable(rel_path: Column) -> Column:
    """Path filters of the scan: directories, file names, suffixes."""
    parts = F.split(rel_path, "/")
    return (
        ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_DIRECTORIES))) & ~file_name(rel_path).isin(*SKIPPED_FILES) & suffix(rel_path).isin(*CODE_SUFFIXES)
    )


def module_line_count(source: Column) -> Column:
    """Line breaks plus one, also where the text ends with a break."""
    return F.size(F.split(source, "\n", -1))


def oversized(line_count: Column, most: int = 80) -> Column:
    return line_count > most


def module_name(path: Column) -> Column:
    """Last two parts of a path without what follows the first dot of the last part."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    last = F.when(F.size(parts) > 1, F.slice(parts, -2, 2)).otherwise(parts)
    return F.regexp_replace(F.array_join(last, "/"), r"\.[^/]+$", "")


# Labels of the parts of an embedded text, in order.
PART_LABELS = ("file", "type", "name", "class", "description", "calls")


def embedding_text(file_path, chunk_type, name, parent_class, docstring, calls, content, most_calls: int = 10) -> Column:
    """What is embedded for a chunk: its place and kind, then the code; empty parts are left out."""
    values = (file_path, chunk_type, name, parent_class, docstring, F.array_join(F.slice(calls, 1, most_calls), ", "))
    present = (None, None, None, parent_class != "", docstring != "", F.size(calls) > 0)
    parts = [F.concat(F.lit(f"{label}: "), value) for label, value in zip(PART_LABELS, values)]
    return F.concat_ws("\n", *[part if there is None else F.when(there, part) for part, there in zip(parts, present)], F.concat(F.lit("\n"), content))


def chunk_header(number, parent_class, name, chunk_type, file_path, line_start, line_end) -> Column:
    """``[i] Parent.name (type) — path:start-end``, a fixed form."""
    full = F.when(F.coalesce(parent_class, F.lit("")) != "", F.concat(parent_class, F.lit("."), name)).otherwise(name)
    place = [F.coalesce(x.cast("string"), F.lit("None")) for x in (line_start, line_end)]
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), full, F.lit(" ("), chunk_type, F.lit(") — "), file_path, F.lit(":"), place[0], F.lit("-"), place[1])
