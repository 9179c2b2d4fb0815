"""Functions paired with their documentation.

Comment spans and function spans are taken from the text independently; an as-of join over line numbers then attaches
to each function the nearest comment block that ends directly above it, and rejects it where a statement or an empty line
lies between. Python functions may have a docstring instead, the span of the first statement of the body.
Documentation that says nothing is dropped by ``says_something``.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.ecma import EcmaError, parse
from codeloom.session import table

MIN_WORDS = 4


class Span(NamedTuple):
    """Lines ``first`` to ``last`` (from 0) and the text in them."""

    first: int
    last: int
    text: str


_LINE = re.compile(r"\r\n|\r|\n")
_PY_TOKEN = re.compile(
    r"(?P<doc>(?P<prefix>[rRuUbBfF]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'))"
    r"|(?P<comment>#[^\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<colon>:)|(?P<break>\n)|(?P<other>\\\n|[^\s\"'#()\[\]{}:]+|\s)"
)
_PY_DEF = re.compile(r"(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)")
_JS_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)")


def _newlines(text: str) -> str:
    return _LINE.sub("\n", text)


def comment_spans(text: str, language: str) -> list[Span]:
    """Comment blocks at the start of lines: neighbouring lines of comments form one block."""
    spans: list[Span] = []
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        s = lines[i].strip()
        j = i
        if language == "py":
            if not s.startswith("#"):
                i += 1
                continue
        elif s.startswith("/*"):
            body = s
            while "*/" not in (body[2:] if j == i else body) and j + 1 < len(lines):
                j += 1
                body = lines[j]
            if body.split("*/", 1)[-1].strip() and "*/" in body:  # code after the comment on its line
                i = j + 1
                continue
        elif not s.startswith("//"):
            i += 1
            continue
        block = "\n".join(lines[i : j + 1])
        if spans and spans[-1].last == i - 1:
            spans[-1] = Span(spans[-1].first, j, spans[-1].text + "\n" + block)
        else:
            spans.append(Span(i, j, block))
        i = j + 1
    return spans


_PY_HEAD = re.compile(r"(?:async[ \t]+)?def[ \t]|@")
_JS_HEAD = re.compile(r"\bfunction\b|=>|^\s*@|^\s*(?:(?:export|default|public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*[*#]?[\w$\[\]'\".]+\s*(?:<[^>]*>)?\s*\(|=\s*(?:async\s*)?\(\s*$")


def function_span(text: str, language: str) -> Span | None:
    """The chunk's function: from its first decorator or its head to the end of the text.

    The head is the first line of code that can be one; where none can, it is the first line of code.
    """
    lines = text.split("\n")
    inside = False
    first = None
    head = _PY_HEAD if language == "py" else _JS_HEAD
    for i, line in enumerate(lines):
        s = line.strip()
        if inside:
            inside = "*/" not in s
            continue
        if not s or language == "py" and s.startswith("#") or language != "py" and s.startswith("//"):
            continue
        if language != "py" and s.startswith("/*"):
            inside = "*/" not in s[2:]
            if inside or not s.split("*/", 1)[-1].strip():
                continue
        first = i if first is None else first
        if (head.match(s) if language == "py" else head.search(s)):
            first = i
            break
    return None if first is None else Span(first, len(lines) - 1, "\n".join(lines[first:]))


def docstring_span(function: Span) -> Span | None:
    """The plain string that is the first statement of a Python function's body."""
    text = function.text
    head = re.search(r"^[ \t]*" + _PY_DEF.pattern, text, re.M)
    if head is None:
        return None
    at, depth, in_head = head.end(), 0, True
    strings: list[str] = []
    start = end = at
    while at < len(text):
        m = _PY_TOKEN.match(text, at)
        if m is None:
            return None
        kind = m.lastgroup if m.lastgroup != "prefix" else "doc"
        at = m.end()
        if in_head:
            depth += (kind == "open") - (kind == "close")
            if kind == "colon" and depth == 0:
                in_head = False
            continue
        if kind == "doc":
            if set(m["prefix"].lower()) & set("fb"):
                return None
            if not strings:
                start = m.start()
            strings.append(m.group())
            end = at
        elif kind == "comment" or kind == "other" and not m.group().strip(" \t\r\n\f\\"):
            continue
        elif kind == "break" or kind == "other" and strings and m.group().startswith(";"):
            if strings:
                break
        else:
            return None
    if not strings:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            value = "".join(ast.literal_eval(s) for s in strings)
    except (SyntaxError, ValueError):
        return None
    line = function.first + text.count("\n", 0, start)
    return Span(line, line + text.count("\n", start, end), value)


def attached_comment(function: Span, comments: list[Span]) -> Span | None:
    """As-of join: the last block that ends before the function, unless a line, blank or a statement, lies between."""
    at = bisect_right([c.last for c in comments], function.first - 1) - 1
    return comments[at] if at >= 0 and comments[at].last == function.first - 1 else None


# Tags of documentation markup, tool directives, placeholders and notices of generated code.
_TAG = re.compile(
    r"^\s*(?:[@\\](?:param|arg|argument|prop|property|returns?|throws|exception|raises?|type|typedef|template|yields?|see|since|author|version|deprecated|inheritdoc|override|private|public|protected|internal|ignore|async|static|readonly|class|constructor|function|method|name|memberof|module|namespace|kind|callback|event|fires|example|todo|hidden|package|access|alias|augments|extends|implements|default|enum|final|generator|global|license|copyright|lends|listens|mixin|mixes|requires|summary|tutorial|variation|virtual|abstract)\b"
    r"|:(?:param|parameter|arg|argument|key|keyword|var|ivar|cvar|vartype|type|returns?|rtype|raises?|raise|except|exception|yields?|meta)\b[^:]*:)",
    re.I,
)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields|attributes|keyword args|keyword arguments|other parameters|throws|examples?|notes?|see also|references)\s*:?\s*$", re.I)
_ENTRY = re.compile(r"^\s*\*{0,2}\w+(?:\s*\([^)]*\)|\s*:\s*[\w\[\], |.]+)?\s*(?::|--?|$)")
_DIRECTIVE = re.compile(
    r"^\s*(?:eslint\b|eslint-|noqa\b|type:\s*ignore|pylint:|flake8:|mypy:|ruff:|isort:|fmt:|yapf:|black:|bandit:|nosec\b|pragma\b|pyright:|prettier-ignore|ts-ignore|ts-expect-error|ts-nocheck|ts-check|@ts-|istanbul\b|c8\b|v8 ignore|jshint\b|jslint\b|jscs\b|tslint:|tslint-|biome-|deno-|globals?\b\s+\w+|sourceMappingURL|#?\s*(?:end)?region\b|webpackChunkName|@flow|@jsx|@__PURE__|#__PURE__|nolint|coverage:|vim?:|-\*-|sonar|NOSONAR|codeql|lgtm|cspell|spell-?checker|@jest|@vitest|stylelint-|rubocop|doctest:)",
    re.I,
)
_PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|tba|hack|wip|placeholder|n/?a|none|docs?|documentation|description|missing|here|write|add|me|fill in|later|comment|docstring|to be (?:done|documented)|not documented|undocumented|no (?:docs?|documentation|description)|lorem ipsum|\.\.\.|…)\b[\s:.,!\-()]*)+\W*$",
    re.I,
)
_TODO = re.compile(r"^\s*(?:todo|fixme|xxx|hack|tbd)\b(?:\([^)]*\))?\s*[:\-]?\s*", re.I)
_GENERATED = re.compile(r"@generated|auto-?\s?generated|(?:this|the)\s+(?:file|code|function|class|method)\s+(?:is|was|has been)\s+(?:automatically\s+)?generated|generated\s+(?:by|from|with|file|code|automatically)|do not (?:edit|modify)|machine[- ]generated", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CODE_LINE = re.compile(
    r"[;{]\s*$|^\s*[})\]]+[;,]?\s*$|^\s*(?:const|let|var|import|export|return|throw|await|del|assert|raise|yield|pass|break|continue)\b.*[(=;'\"\[].*$|^\s*[\w.\[\]'\"]+\s*(?:[-+*/|&]?=)\s*\S+|^\s*(?:if|for|while|elif|else|try|except|with|def|class|async def)\b.*:\s*$|^\s*[\w.]+\(.*\)\s*;?\s*$|^\s*(?:>>>|\$\s)|^\s*(?:from\s+[\w.]+\s+import|import\s+[\w.]+\s*$)|^\s*</?\w[^>]*>\s*$"
)


def _is_code(text: str) -> bool:
    """Whether the whole text is code that someone commented out."""
    if not re.search(r"[=(){}\[\];]", text):
        return False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    try:
        parse(text, ts=True, jsx=True)
        return True
    except EcmaError:
        return False


def _bare_lines(doc: str) -> list[str]:
    """Lines without comment marks."""
    found = []
    for line in doc.split("\n"):
        s = line.strip()
        s = re.sub(r"^(?:/\*+!?|//+[/!]?|#+!?|\*+(?!/))|\*+/$", "", s).strip() if s else s
        found.append(re.sub(r"\*+/$|^\*+/", "", s).strip())
    return found


def prose(doc: str) -> str:
    """What is left of documentation without marks, tags, directives, rulers, placeholders, code and notices of generated code."""
    lines = _bare_lines(doc)
    text = "\n".join(lines).strip()
    if _is_code(re.sub(r"^[ \t]+", "", text)):
        return ""
    kept: list[str] = []
    in_tag = fenced = notice = False
    section = False
    for line in lines:
        if line.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced:
            continue
        if not line:
            in_tag = section = notice = False
            continue
        if _TAG.match(line) and not re.match(r"\s*[@\\](?:summary|description|deprecated|desc|todo)\b", line, re.I):
            in_tag, section = True, False
            continue
        if _SECTION.match(line):
            section = True
            continue
        if section and _ENTRY.match(line) or in_tag and not section:
            continue
        if _GENERATED.search(line):
            notice = True
            continue
        if notice and re.match(r"(?:source|changes|date|version)\b", line, re.I):
            continue
        if _DIRECTIVE.match(line) or _PLACEHOLDER.match(line) or not _WORD.search(line):
            continue
        if _CODE_LINE.search(line) and (line.rstrip().endswith((";", "{", "}", ":")) or _is_code(line.rstrip("{").strip() or line)):
            continue
        kept.append(re.sub(r"^\s*@\w+\s*", "", _TODO.sub("", line)))
    return "\n".join(kept)


def name_words(name: str) -> set[str]:
    """Lower-case words of an identifier."""
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+", name or "")}


def says_something(doc: str, name: str, min_words: int = MIN_WORDS) -> bool:
    """At least ``min_words`` words of prose that are not only the words of the function's own name."""
    words = [w.lower() for w in _WORD.findall(prose(doc))]
    if sum(1 if w.isascii() or not re.match(r"[぀-ヿ一-鿿가-힯]", w) else max(1, len(w) // 2) for w in words) < min_words:
        return False
    return bool(set(words) - name_words(name) - {name.lower()})


def documentation(content: str | None, name: str | None, language: str | None) -> str | None:
    """The documentation of a chunk's function if it says something, else null; that of short texts is kept for their copies."""
    find = _documentation_of if len(content or "") <= 4000 else _documentation_of.__wrapped__
    return find(content, name, language)


@lru_cache(maxsize=4096)
def _documentation_of(content: str | None, name: str | None, language: str | None) -> str | None:
    if not content:
        return None
    text = _newlines(content)
    function = function_span(text, language or "")
    if function is None:
        return None
    found = []
    above = attached_comment(function, comment_spans(text, language or ""))
    if above is not None:
        found.append(above.text)
    if language == "py":
        inner = docstring_span(function)
        if inner is not None:
            found.append(inner.text)
    kept = [d for d in found if says_something(d, name or "")]
    return "\n".join(kept) if kept else None


@F.pandas_udf(T.StringType())
def _documentation(content: pd.Series, name: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([documentation(c, n, k) for c, n, k in zip(content, name, language)], dtype=object)


def documented_functions(chunks: DataFrame) -> DataFrame:
    """Pairs of code and documentation: id, name, language, code, documentation.

    Only chunks of type function and method; those without documentation that says something are left out, null
    and empty contents among them. Repeated rows count each.
    """
    return (
        chunks.where(F.col("chunk_type").isin("function", "method"))
        .select("id", "name", "language", F.col("content").alias("code"))
        .withColumn("documentation", _documentation("code", "name", "language"))
        .where(F.col("documentation").isNotNull())
    )


def p2_found(spark, sf_dir):
    return documented_functions(table(spark, sf_dir, "code_chunks")).select("id")


def p2_pairs(spark, sf_dir):
    return documented_functions(table(spark, sf_dir, "code_chunks"))


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}
ORACLE: dict[str, str] = {}
