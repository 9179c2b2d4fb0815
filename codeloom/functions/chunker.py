"""Syntax chunks of one source file (X5-X8, F8-F11): Python by its own grammar, the JavaScript family by ``ecma``."""

from __future__ import annotations

import ast
import re
import warnings
from typing import NamedTuple

from codeloom.functions.ecma import EcmaError, parse

# Calls that are no signal.
COMMON_CALLS = frozenset(["print", "len", "str", "int", "float", "bool", "list", "dict", "set"])
_DOC_STRIP = "\"' \n\t"


class Chunk(NamedTuple):
    chunk_type: str
    name: str
    parent_class: str
    content: str
    line_start: int
    line_end: int
    docstring: str | None
    calls: list[str] | None


def read_source(content: bytes) -> str:
    """UTF-8, else latin-1."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def chunk_source(source: str, suffix: str, calls_kept: int = 20) -> tuple[list[Chunk], str | None]:
    """Chunks of a file and the error that stopped its parser; blank files have none, and a file without functions is one module."""
    if not source.strip():
        return [], None
    error = None
    found: list[Chunk] = []
    try:
        found = _python(source, calls_kept) if suffix == "py" else _ecma(source, suffix)
    except (SyntaxError, ValueError, RecursionError, EcmaError) as problem:
        error = str(problem)
    if not found:
        lines = source.count("\n") + 1
        found = [Chunk("module", "", "", source, 1, lines, None, None)]
    return found, error


def _python(source: str, calls_kept: int) -> list[Chunk]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    raw = source.splitlines(keepends=True) if "\f" not in source and "\v" not in source else re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", source)
    lines = [x.encode("utf-8", "surrogatepass") for x in raw]

    def text(node: ast.AST) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return lines[a][node.col_offset : node.end_col_offset].decode("utf-8", "surrogatepass")
        parts = [lines[a][node.col_offset :], *lines[a + 1 : b], lines[b][: node.end_col_offset]]
        return b"".join(parts).decode("utf-8", "surrogatepass")

    def docstring(node) -> str | None:
        for statement in node.body:
            if isinstance(statement, ast.Expr) and isinstance(statement.value, ast.Constant) and isinstance(statement.value.value, str):
                return text(statement.value).strip(_DOC_STRIP) or None
        return None

    def calls(node) -> list[str] | None:
        found = []
        for inner in _preorder(node):
            if isinstance(inner, ast.Call):
                if isinstance(inner.func, ast.Name) and inner.func.id not in COMMON_CALLS:
                    found.append(inner.func.id)
                elif isinstance(inner.func, ast.Attribute):
                    found.append(text(inner.func))
        return list(dict.fromkeys(found))[:calls_kept] or None

    chunks: list[Chunk] = []
    stack: list[tuple[ast.AST, str]] = [(tree, "")]
    while stack:
        node, owner = stack.pop()
        inner = owner
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "method" if owner else "function"
            chunks.append(Chunk(kind, node.name, owner, text(node), node.lineno, node.end_lineno, docstring(node), calls(node)))
            inner = node.name if is_class else owner
        stack += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]
    return chunks


def _preorder(node: ast.AST):
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(list(ast.iter_child_nodes(node)))


def _ecma(source: str, suffix: str) -> list[Chunk]:
    """Functions, arrow functions, classes and methods; TypeScript and JSX syntax is read in every file of the family."""
    try:
        declared = parse(source, ts=suffix in ("ts", "tsx"), jsx=suffix in ("jsx", "tsx", "js"))
    except EcmaError:
        declared = parse(source, ts=True, jsx=suffix != "ts")
    chunks = []
    for d in declared:
        if d.kind == "property":
            kind = "method"
        else:
            kind = d.kind
        first = source.count("\n", 0, d.start) + 1
        body = source[d.start : d.end]
        chunks.append(Chunk(kind, d.name or "anonymous", d.owner, body, first, first + body.count("\n"), None, None))
    return chunks
