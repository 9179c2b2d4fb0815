"""Recursive-descent recogniser of ECMAScript with optional TypeScript and JSX syntax.

``parse(source, ts=..., jsx=...)`` raises ``EcmaError`` with a line number where the text does not parse and
returns the functions, methods and classes it met otherwise. It decides on grammar alone: undefined or
repeated names are no errors.
"""

from __future__ import annotations

import re
import sys
from typing import NamedTuple


class EcmaError(ValueError):
    """The text is not in the language; ``line`` counts from 1."""

    def __init__(self, message: str, line: int):
        super().__init__(f"{message} (line {line})")
        self.line = line


class EcmaDepthError(EcmaError):
    """Nested more deeply than this reader goes, which says nothing about the text."""


class _Fail(Exception):
    """A rule does not match at an offset; attempts fail often, so the line is counted only for the error that stays."""


class Declaration(NamedTuple):
    """A function, method or class: places are offsets in the text, ``owner`` is the enclosing class."""

    kind: str
    name: str
    owner: str
    start: int
    end: int


_SPACE = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*[\s\S]*?\*/)*")
_NEWLINE = re.compile(r"[\n\r  ]")
_ESC = r"\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\}"
_IDENT = rf"(?:[^\W\d]|\$|{_ESC})(?:[\w$‌‍]|{_ESC})*"
_DIGITS = r"\d(?:_?\d)*"
_TOKEN = re.compile(
    rf"(?P<id>{_IDENT})"
    rf"|(?P<num>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?"
    rf"|(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?n?)"
    r"|(?P<str>'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")"
    r"|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
    r"|(?P<tpl>`)"
    rf"|(?P<priv>#{_IDENT})"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([\w$]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:u(?!\{[0-9a-fA-F]+\}|[0-9a-fA-F]{4})|x(?![0-9a-fA-F]{2}))")
_ARROW_AHEAD = re.compile(r"[ \t]*=>")
_PARAMS_AHEAD = re.compile(r"\(\s*(?:\)|\.\.\.|[\[{@/]|[\w$]+\s*[,:=?)]|(?:public|private|protected|readonly)\s)")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$\-]*(?:(?::[A-Za-z_$][\w$\-]*)|(?:\.[A-Za-z_$][\w$]*)+)?")
_JSX_TEXT = re.compile(r"[^<>{}]*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_WORD_AHEAD = re.compile(rf"(?:[ \t]|/\*[^\n]*?\*/)*({_IDENT}|[^\s\w]|\d|$|\n|\r)")

# Reserved words of the language and operator precedences.
_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in"
    " instanceof new null return super switch this throw true try typeof var void while with".split()
)
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor get set".split())
_TARGETS = frozenset(["id", "member", "obj", "arr"])


class _Parser:
    def __init__(self, src: str, ts: bool, jsx: bool):
        self.src, self.ts, self.jsx = src, ts, jsx
        self.size = len(src)
        self.found: list[Declaration] = []
        self.owner = ""
        self.not_arrow: set[int] = set()
        self.in_function = self.in_async = self.in_generator = False
        self.no_in = False
        self.in_consequent = False
        self.no_conditional_type = False
        self.ambient = False
        self.breakable = self.loop = 0
        self.covers = 0  # object literals with '=' that have not become patterns
        self.labels: list[str] = []
        self.last_end = 0
        start = 1 if src.startswith("﻿") else 0
        if src.startswith("#!", start):
            m = _NEWLINE.search(src, start)
            start = m.start() if m else self.size
        self.e = start
        self.advance()

    # tokens

    def fail(self, message: str, at: int | None = None):
        raise _Fail(message, self.s if at is None else at)

    def advance(self):
        self.last_end = self.e
        self.scan(self.e)

    def scan(self, at: int):
        src = self.src
        s = _SPACE.match(src, at).end()
        self.nl = s > at and _NEWLINE.search(src, at, s) is not None
        self.s = s
        if s >= self.size:
            self.t, self.v, self.e = "eof", "", s
            return
        m = _TOKEN.match(src, s)
        if m is None:
            self.fail(f"unexpected character {src[s]!r}", s)
        self.t, self.v, self.e = m.lastgroup, m.group(), m.end()
        if self.t == "num":
            nxt = src[self.e : self.e + 1]
            if nxt and (nxt.isalnum() or nxt in "_$"):
                self.fail("bad number", s)
        elif self.t == "str" and "\\" in self.v and _BAD_ESCAPE.search(self.v):
            self.fail("bad escape", s)

    def save(self):
        return (self.t, self.v, self.s, self.e, self.nl, self.last_end, len(self.found))

    def back(self, state):
        self.t, self.v, self.s, self.e, self.nl, self.last_end, n = state
        del self.found[n:]

    def attempt(self, rule):
        """The rule's result, or None and no step taken where it fails."""
        state = self.save()
        flags = (self.in_function, self.in_async, self.in_generator, self.no_in, self.in_consequent, self.no_conditional_type, self.ambient, self.breakable, self.loop, self.owner, self.covers, len(self.labels))
        try:
            return rule()
        except _Fail:
            self.back(state)
            (self.in_function, self.in_async, self.in_generator, self.no_in, self.in_consequent, self.no_conditional_type, self.ambient, self.breakable, self.loop, self.owner, self.covers, n) = flags
            del self.labels[n:]
            return None

    def ahead(self) -> str:
        """The next token's text, roughly: a word, one sign, or an empty text at a line's or the text's end."""
        m = _WORD_AHEAD.match(self.src, self.e)
        return m.group(1).strip() if m else ""

    def ahead_token(self):
        state = self.save()
        self.advance()
        found = (self.t, self.v, self.nl)
        self.back(state)
        return found

    def is_p(self, v: str) -> bool:
        return self.v == v and self.t == "p"

    def is_word(self, v: str) -> bool:
        return self.v == v and self.t == "id"

    def eat(self, v: str) -> bool:
        if self.v == v and self.t in ("p", "id"):
            self.advance()
            return True
        return False

    def need(self, v: str):
        if self.v != v or self.t not in ("p", "id"):
            self.fail(f"expected {v!r}, found {self.v!r}")
        self.advance()

    def need_close_angle(self):
        if self.t != "p" or not self.v.startswith(">"):
            self.fail("expected '>'")
        self.e = self.s + 1
        self.advance()

    def end_statement(self):
        if self.is_p(";"):
            self.advance()
        elif not (self.nl or self.t == "eof" or self.is_p("}")):
            self.fail(f"unexpected {self.v!r}")

    def name(self) -> str:
        """A binding identifier."""
        if self.t != "id" or self.v in _RESERVED:
            self.fail(f"expected a name, found {self.v!r}")
        v = self.v
        self.advance()
        return v

    def word(self) -> str:
        if self.t != "id":
            self.fail(f"expected a word, found {self.v!r}")
        v = self.v
        self.advance()
        return v

    # statements

    def program(self):
        while self.t != "eof":
            self.statement(True)
        return self.found

    def block(self):
        self.need("{")
        while not self.is_p("}"):
            if self.t == "eof":
                self.fail("unclosed block")
            self.statement(True)
        self.advance()

    def statement(self, declarations: bool = False):
        t, v = self.t, self.v
        if t == "p":
            if v == "{":
                return self.block()
            if v == ";":
                return self.advance()
            if v == "@":
                start = self.s
                self.decorators()
                if self.is_word("export"):
                    return self.export(start)
                if self.is_word("abstract"):
                    self.advance()
                return self.class_(start, True)
        elif t == "id":
            rule = _STATEMENTS.get(v)
            if rule is not None:
                if rule(self, declarations) is not False:
                    return None
            elif v not in _RESERVED:
                nxt = _WORD_AHEAD.match(self.src, self.e)
                if nxt and nxt.group(1) == ":":
                    self.advance()
                    self.advance()
                    self.labels.append(v)
                    self.statement()
                    self.labels.pop()
                    return None
        self.expression()
        self.end_statement()

    def s_var(self, declarations):
        if self.v == "const" and self.ts and self.ahead() == "enum":
            self.advance()
            return self.s_enum(True)
        if not declarations and self.v != "var":
            self.fail("declaration not allowed here")
        const = self.v == "const"
        self.advance()
        self.var_list(const)
        self.end_statement()

    def s_let(self, declarations):
        nxt = self.ahead_token()
        if nxt[0] == "id" and nxt[1] not in ("in", "instanceof") or nxt[1] in ("[", "{") and nxt[0] == "p":
            return self.s_var(declarations)
        return False

    def s_using(self, declarations):
        nxt = self.ahead_token()
        if nxt[0] == "id" and nxt[1] not in ("in", "instanceof", "of", "as", "satisfies") and not nxt[2]:
            return self.s_var(True)
        return False

    def var_list(self, const=False, in_for=False):
        while True:
            start = self.s
            plain = self.t == "id"
            name = self.v if plain else ""
            self.binding()
            if self.ts and self.is_p("!"):
                self.advance()
            if self.ts and self.is_p(":"):
                self.advance()
                self.type_()
            if self.is_p("="):
                self.advance()
                n = len(self.found)
                kind = self.assign()
                if kind in ("arrow", "func") and plain:
                    whole = [d for d in self.found[n:] if d.kind == "function" and d.end == self.last_end]
                    if whole:
                        self.found.remove(whole[-1])
                    self.found.append(Declaration("function", name, self.owner, start, self.last_end))
            elif not in_for and not self.ambient and (const or not plain):
                self.fail("initialiser expected")
            if not self.is_p(","):
                return
            self.advance()

    def binding(self):
        if self.is_p("["):
            self.advance()
            while not self.is_p("]"):
                if self.is_p(","):
                    self.advance()
                    continue
                if self.is_p("..."):
                    self.advance()
                self.binding()
                if self.is_p("="):
                    self.advance()
                    self.assign_in()
                if not self.is_p("]"):
                    self.need(",")
            self.advance()
        elif self.is_p("{"):
            self.advance()
            while not self.is_p("}"):
                if self.is_p("..."):
                    self.advance()
                    self.binding()
                else:
                    word = self.t == "id"
                    bad = word and self.v in _RESERVED
                    self.property_name()
                    if self.is_p(":"):
                        self.advance()
                        self.binding()
                    elif not word or bad:
                        self.fail("expected ':'")
                    if self.is_p("="):
                        self.advance()
                        self.assign_in()
                if not self.is_p("}"):
                    self.need(",")
            self.advance()
        else:
            self.name()

    def assign_in(self):
        old, self.no_in = self.no_in, False
        kind = self.assign()
        self.no_in = old
        return kind

    def s_function(self, declarations):
        self.function(self.s, True)

    def s_async(self, declarations):
        nxt = self.ahead_token()
        if nxt[1] == "function" and not nxt[2]:
            return self.function(self.s, True)
        return False

    def function(self, start: int, declared: bool, name_needed: bool = True):
        is_async = False
        if self.is_word("async"):
            is_async = True
            self.advance()
        self.need("function")
        star = self.eat("*")
        name = ""
        if self.t == "id" and (self.v not in _RESERVED):
            name = self.name()
        elif declared and name_needed:
            self.fail("function name expected")
        at = len(self.found)
        has_body = self.function_rest(is_async, star, declared)
        if has_body:
            self.found.insert(at, Declaration("function", name, self.owner, start, self.last_end))
        return "func"

    def function_rest(self, is_async: bool, star: bool, may_lack_body: bool) -> bool:
        if self.ts and self.is_p("<"):
            self.type_params()
        saved = self.enter(is_async, star)
        self.params()
        if self.ts and self.is_p(":"):
            self.advance()
            self.return_type()
        if self.is_p("{"):
            ambient, self.ambient = self.ambient, False
            self.block()
            self.ambient = ambient
            self.leave(saved)
            return True
        self.leave(saved)
        if not (self.ts and may_lack_body):
            self.fail("function body expected")
        self.end_statement()
        return False

    def enter(self, is_async, star):
        saved = (self.in_function, self.in_async, self.in_generator, self.no_in, self.in_consequent, self.breakable, self.loop, self.labels)
        self.in_function, self.in_async, self.in_generator, self.no_in, self.in_consequent = True, is_async, star, False, False
        self.breakable = self.loop = 0
        self.labels = []
        return saved

    def leave(self, saved):
        (self.in_function, self.in_async, self.in_generator, self.no_in, self.in_consequent, self.breakable, self.loop, self.labels) = saved

    def params(self):
        self.need("(")
        while not self.is_p(")"):
            if self.is_p("@"):
                self.decorators()
            if self.ts:
                while self.t == "id" and self.v in ("public", "private", "protected", "readonly", "override"):
                    nxt = self.ahead_token()
                    if nxt[0] == "id" or nxt[1] in ("{", "["):
                        self.advance()
                    else:
                        break
            rest = self.is_p("...")
            if rest:
                self.advance()
            if self.ts and self.is_word("this"):
                self.advance()
            else:
                self.binding()
            if self.ts:
                if self.is_p("?"):
                    self.advance()
                if self.is_p(":"):
                    self.advance()
                    self.type_()
            if self.is_p("="):
                if rest:
                    self.fail("a rest parameter has no default")
                self.advance()
                self.assign_in()
            if not self.is_p(")"):
                if rest:
                    self.fail("a rest parameter must be last")
                self.need(",")
        self.advance()

    def decorators(self):
        while self.is_p("@"):
            self.advance()
            if self.is_p("("):
                self.advance()
                self.expression()
                self.need(")")
            else:
                self.word()
                while self.is_p("."):
                    self.advance()
                    self.word()
            while self.is_p("(") or self.ts and self.is_p("<"):
                if self.is_p("<"):
                    self.type_args()
                else:
                    self.arguments()

    def s_class(self, declarations):
        self.class_(self.s, True)

    def class_(self, start: int, declared: bool, name_needed: bool = True):
        self.need("class")
        name = ""
        if self.t == "id" and self.v not in ("extends", "implements") and self.v not in _RESERVED:
            name = self.name()
            if self.ts and self.is_p("<"):
                self.type_params()
        elif declared and name_needed:
            self.fail("class name expected")
        if self.is_word("extends"):
            self.advance()
            self.unary_operand()
            if self.ts and self.is_p("<"):
                self.type_args()
        if self.ts and self.is_word("implements"):
            self.advance()
            self.type_list()
        at = len(self.found)
        outer, self.owner = self.owner, name or "anonymous"
        self.need("{")
        while not self.is_p("}"):
            if self.t == "eof":
                self.fail("unclosed class")
            if self.is_p(";"):
                self.advance()
            else:
                self.member()
        self.advance()
        self.owner = outer
        self.found.insert(at, Declaration("class", name, outer, start, self.last_end))
        return "class"

    def member(self):
        start = self.s
        if self.is_p("@"):
            self.decorators()
        is_async = star = False
        words = []
        while self.t == "id" and self.v in _MODIFIERS:
            if not self.ts and self.v not in ("static", "async", "get", "set", "accessor"):
                break
            nt, nv, nnl = self.ahead_token()
            if nv in ("(", "=", ";", ":", "?", "!", "}", ",") and nt == "p" or nt == "p" and nv == "<" or nt == "eof":
                break
            if nnl and self.v in ("async", "get", "set", "accessor", "declare", "abstract", "readonly"):
                break
            if self.v == "static" and nv == "{" and nt == "p":
                self.advance()
                saved = self.enter(False, False)
                self.block()
                self.leave(saved)
                return
            words.append(self.v)
            is_async = self.v == "async"
            self.advance()
        if self.is_p("*"):
            star = True
            self.advance()
        if self.ts and self.is_p("[") and not star:
            if self.attempt(self.index_signature):
                self.end_member()
                return
        name = self.v if self.t in ("id", "priv", "str", "num") else ""
        self.property_name(private=True)
        if self.ts and (self.is_p("?") or self.is_p("!")):
            self.advance()
        if self.is_p("(") or self.ts and self.is_p("<"):
            at = len(self.found)
            owner = self.owner
            if self.function_rest(is_async, star, True):
                self.found.insert(at, Declaration("method", name.strip("'\""), owner, start, self.last_end))
            return
        if star or is_async or words and words[-1] in ("get", "set"):
            self.fail("method expected")
        if self.ts and self.is_p(":"):
            self.advance()
            self.type_()
        if self.is_p("="):
            self.advance()
            saved = self.enter(False, False)
            self.assign()
            self.leave(saved)
        self.end_member()

    def end_member(self):
        if self.ts and self.is_p(","):
            self.fail("unexpected ','")
        self.end_statement()

    def property_name(self, private=False):
        if self.t in ("id", "num", "str") or private and self.t == "priv":
            self.advance()
        elif self.is_p("["):
            self.advance()
            self.assign_in()
            self.need("]")
        else:
            self.fail(f"property name expected, found {self.v!r}")

    def s_if(self, declarations):
        while True:
            self.advance()
            self.need("(")
            self.expression()
            self.need(")")
            self.sub_statement()
            if not self.is_word("else"):
                return
            self.advance()
            if not self.is_word("if"):
                self.sub_statement()
                return

    def sub_statement(self):
        if self.t == "id" and (self.v in ("class", "const") or self.v == "function" and self.ts):
            self.fail("a statement is needed here")
        self.statement()

    def body(self):
        self.breakable += 1
        self.loop += 1
        self.sub_statement()
        self.breakable -= 1
        self.loop -= 1

    def s_for(self, declarations):
        self.advance()
        if self.is_word("await"):
            self.advance()
        self.need("(")
        done = False
        if self.is_p(";"):
            pass
        else:
            old, self.no_in = self.no_in, True
            nxt = self.ahead_token() if self.t == "id" else None
            if self.t == "id" and (self.v in ("var", "const") or self.v == "let" and (nxt[0] == "id" and nxt[1] not in ("in", "of") or nxt[1] in "[{") or self.v == "using" and nxt[0] == "id" and nxt[1] != "of"):
                const = self.v == "const"
                self.advance()
                at = self.save()
                self.binding()
                if self.is_word("of") or self.is_word("in"):
                    done = True
                else:
                    self.back(at)
                    self.var_list(const)
                    if self.is_word("in") or self.is_word("of"):
                        self.fail("bad loop head")
            else:
                kind = self.expression()
                if (self.is_word("of") or self.is_word("in")) and kind in _TARGETS:
                    done = True
            self.no_in = old
        if done:
            of = self.v == "of"
            self.advance()
            self.assign() if of else self.expression()
        else:
            self.need(";")
            if not self.is_p(";"):
                self.expression()
            self.need(";")
            if not self.is_p(")"):
                self.expression()
        self.need(")")
        self.body()

    def s_while(self, declarations):
        self.advance()
        self.need("(")
        self.expression()
        self.need(")")
        self.body()

    def s_do(self, declarations):
        self.advance()
        self.body()
        self.need("while")
        self.need("(")
        self.expression()
        self.need(")")
        if self.is_p(";"):
            self.advance()

    def s_switch(self, declarations):
        self.advance()
        self.need("(")
        self.expression()
        self.need(")")
        self.need("{")
        self.breakable += 1
        while not self.is_p("}"):
            if self.is_word("case"):
                self.advance()
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not (self.is_p("}") or self.is_word("case") or self.is_word("default")):
                if self.t == "eof":
                    self.fail("unclosed switch")
                self.statement(True)
        self.breakable -= 1
        self.advance()

    def s_try(self, declarations):
        self.advance()
        self.block()
        caught = False
        if self.is_word("catch"):
            caught = True
            self.advance()
            if self.is_p("("):
                self.advance()
                self.binding()
                if self.ts and self.is_p(":"):
                    self.advance()
                    self.type_()
                self.need(")")
            self.block()
        if self.is_word("finally"):
            self.advance()
            self.block()
        elif not caught:
            self.fail("catch or finally expected")

    def s_throw(self, declarations):
        self.advance()
        if self.nl:
            self.fail("line break after throw")
        self.expression()
        self.end_statement()

    def s_return(self, declarations):
        if not self.in_function:
            self.fail("return outside a function")
        self.advance()
        if not (self.nl or self.t == "eof" or self.is_p(";") or self.is_p("}")):
            self.expression()
        self.end_statement()

    def s_break(self, declarations):
        is_break = self.v == "break"
        self.advance()
        if self.t == "id" and not self.nl and self.v not in _RESERVED:
            if self.v not in self.labels:
                self.fail("unknown label")
            self.advance()
        elif not (self.breakable if is_break else self.loop):
            self.fail("jump outside a loop")
        self.end_statement()

    def s_debugger(self, declarations):
        self.advance()
        self.end_statement()

    def s_with(self, declarations):
        if self.ts:
            self.fail("with statement")
        self.advance()
        self.need("(")
        self.expression()
        self.need(")")
        self.statement()

    def s_import(self, declarations):
        nxt = self.ahead_token()
        if nxt[0] == "p" and nxt[1] in ("(", "."):
            return False
        self.advance()
        if self.t == "str":
            self.advance()
            self.import_attributes()
            return self.end_statement()
        if self.ts and self.is_word("type"):
            nt, nv, _ = self.ahead_token()
            if nt == "id" and nv != "from" or nv in ("{", "*"):
                self.advance()
        elif self.t == "id" and self.v in ("defer", "source") and self.ahead_token()[1] in ("*",):
            self.advance()
        if self.t == "id":
            self.name()
            if self.ts and self.is_p("="):
                self.advance()
                self.expression()
                return self.end_statement()
            if self.is_p(","):
                self.advance()
                if not (self.is_p("*") or self.is_p("{")):
                    self.fail("bad import")
        if self.is_p("*"):
            self.advance()
            self.need("as")
            self.name()
        elif self.is_p("{"):
            self.specifiers(False)
        self.need("from")
        if self.t != "str":
            self.fail("module name expected")
        self.advance()
        self.import_attributes()
        self.end_statement()

    def import_attributes(self):
        if (self.is_word("with") or self.is_word("assert") and not self.nl) and self.ahead_token()[1] == "{":
            self.advance()
            self.object_literal()

    def specifiers(self, export: bool):
        self.need("{")
        while not self.is_p("}"):
            if self.ts and self.is_word("type"):
                nt, nv, _ = self.ahead_token()
                if nt in ("id", "str") and nv != "as":
                    self.advance()
            reserved = self.t == "id" and self.v in _RESERVED
            if self.t not in ("id", "str"):
                self.fail("bad specifier")
            text = self.t == "str"
            self.advance()
            if self.is_word("as"):
                self.advance()
                if export and self.t in ("id", "str"):
                    self.advance()
                else:
                    self.name()
            elif not export and (reserved or text):
                self.fail("bad specifier")
            if not self.is_p("}"):
                self.need(",")
        self.advance()

    def s_export(self, declarations):
        return self.export(self.s)

    def export(self, start: int):
        self.advance()
        v = self.v
        if self.is_p("*"):
            self.advance()
            if self.is_word("as"):
                self.advance()
                if self.t not in ("id", "str"):
                    self.fail("name expected")
                self.advance()
            self.need("from")
            if self.t != "str":
                self.fail("module name expected")
            self.advance()
            self.import_attributes()
            return self.end_statement()
        if self.is_p("{"):
            self.specifiers(True)
            if self.is_word("from"):
                self.advance()
                if self.t != "str":
                    self.fail("module name expected")
                self.advance()
                self.import_attributes()
            return self.end_statement()
        if self.is_word("default"):
            self.advance()
            if self.is_word("function") or self.is_word("async") and self.ahead() == "function":
                self.function(start, True, False)
            elif self.is_word("class"):
                self.class_(start, True, False)
            elif self.is_p("@"):
                self.decorators()
                self.class_(start, True, False)
            elif self.ts and self.is_word("abstract") and self.ahead() == "class":
                self.advance()
                self.class_(start, True, False)
            elif self.ts and self.is_word("interface") and self.ahead_token()[0] == "id":
                self.s_interface(True)
            else:
                self.assign()
                self.end_statement()
            return None
        if self.ts:
            if self.is_p("="):
                self.advance()
                self.expression()
                return self.end_statement()
            if v == "as" and self.ahead() == "namespace":
                self.advance()
                self.advance()
                self.name()
                return self.end_statement()
            if v == "type" and self.ahead_token()[1] in ("{", "*"):
                self.advance()
                if self.is_p("*"):
                    self.advance()
                    if self.is_word("as"):
                        self.advance()
                        self.word()
                    self.need("from")
                    self.advance()
                else:
                    self.specifiers(True)
                    if self.is_word("from"):
                        self.advance()
                        self.advance()
                return self.end_statement()
            if v == "import":
                return self.s_import(True)
        if self.is_p("@"):
            self.decorators()
            if self.is_word("abstract"):
                self.advance()
            return self.class_(start, True)
        if v == "function" or v == "async" and self.ahead() == "function":
            return self.function(start, True)
        if v == "class":
            return self.class_(start, True)
        if v in ("var", "const", "let"):
            n = len(self.found)
            self.s_var(True)
            self.found[n:] = [d._replace(start=start) if d.end in (self.last_end, self.last_end - 1) and d.owner == self.owner and i == 0 else d for i, d in enumerate(self.found[n:])]
            return None
        if self.ts and v in ("interface", "type", "enum", "namespace", "module", "declare", "abstract", "global"):
            if _STATEMENTS[v](self, True) is not False:
                return None
        self.fail("bad export")

    # TypeScript declarations

    def s_interface(self, declarations):
        if not self.ts:
            return False
        nxt = self.ahead_token()
        if nxt[0] != "id" or nxt[2]:
            return False
        self.advance()
        self.name()
        if self.is_p("<"):
            self.type_params()
        if self.is_word("extends"):
            self.advance()
            self.type_list()
        self.object_type()

    def s_type(self, declarations):
        if not self.ts:
            return False
        nxt = self.ahead_token()
        if nxt[0] != "id" or nxt[2] or nxt[1] in ("in", "instanceof", "as", "satisfies"):
            return False
        self.advance()
        self.name()
        if self.is_p("<"):
            self.type_params()
        self.need("=")
        self.type_()
        self.end_statement()

    def s_enum(self, declarations):
        if not self.ts:
            self.fail("enum is a reserved word")
        self.need("enum")
        self.name()
        self.need("{")
        while not self.is_p("}"):
            self.property_name()
            if self.is_p("="):
                self.advance()
                self.assign()
            if not self.is_p("}"):
                self.need(",")
        self.advance()

    def s_namespace(self, declarations):
        if not self.ts:
            return False
        nxt = self.ahead_token()
        if nxt[0] not in ("id", "str") or nxt[2] or nxt[1] in ("in", "instanceof"):
            return False
        self.advance()
        if self.t == "str":
            self.advance()
        else:
            self.name()
            while self.is_p("."):
                self.advance()
                self.name()
        if self.is_p("{"):
            self.block()
        else:
            self.end_statement()

    def s_declare(self, declarations):
        if not self.ts:
            return False
        nxt = self.ahead_token()
        if nxt[0] != "id" or nxt[2] or nxt[1] in ("in", "instanceof", "as"):
            return False
        self.advance()
        ambient, self.ambient = self.ambient, True
        if self.is_word("global") and self.ahead_token()[1] == "{":
            self.advance()
            self.block()
        elif self.is_word("module") or self.is_word("namespace"):
            self.s_namespace(True)
        else:
            self.statement(True)
        self.ambient = ambient

    def s_abstract(self, declarations):
        if not self.ts or self.ahead() != "class":
            return False
        start = self.s
        self.advance()
        self.class_(start, True)

    # expressions

    def expression(self):
        covers = self.covers
        kind = self.assign()
        while self.is_p(","):
            self.advance()
            self.assign()
            kind = "seq"
        if not (self.t == "id" and self.v in ("of", "in")):
            self.uncovered(covers)
        else:
            self.covers = covers
        return kind

    def assign(self):
        t = self.t
        if t == "id":
            v = self.v
            if v not in _RESERVED and _ARROW_AHEAD.match(self.src, self.e):
                start = self.s
                self.name()
                return self.arrow_body(start, False)
            if v == "async" and not self.ahead_token()[2]:
                nt, nv, _ = self.ahead_token()
                if nt == "id" and nv not in ("function", "in", "instanceof", "of", "as", "satisfies"):
                    kind = self.attempt(self.async_single)
                    if kind:
                        return kind
                elif nt == "p" and (nv == "(" or self.ts and nv == "<") and self.s not in self.not_arrow:
                    at = self.s
                    kind = self.attempt(self.async_arrow)
                    if kind:
                        return kind
                    self.not_arrow.add(at)
            elif v == "yield" and self.in_generator:
                self.advance()
                if self.nl or self.t == "eof" or self.t == "p" and self.v in (")", "]", "}", ",", ";", ":") or self.is_word("in"):
                    return "yield"
                if self.is_p("*"):
                    self.advance()
                self.assign()
                return "yield"
        elif t == "p":
            if self.v == "(":
                if self.s not in self.not_arrow:
                    at = self.s
                    if _PARAMS_AHEAD.match(self.src, at):
                        kind = self.attempt(self.arrow)
                        if kind:
                            return kind
                    self.not_arrow.add(at)
            elif self.v == "<" and self.ts and self.s not in self.not_arrow:
                at = self.s
                if not self.jsx or re.match(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b)", self.src[at : at + 200]):
                    kind = self.attempt(self.generic_arrow)
                    if kind:
                        return kind
                self.not_arrow.add(at)
        covers = self.covers
        kind = self.conditional()
        if self.t == "p" and self.v in _ASSIGN:
            if self.v == "=":
                if kind not in _TARGETS:
                    self.fail("bad assignment target")
                self.covers = covers
            elif kind not in ("id", "member"):
                self.fail("bad assignment target")
            self.advance()
            right = self.assign()
            return right if right in ("arrow", "func") else "assign"
        return kind

    def uncovered(self, covers: int):
        if self.covers != covers:
            self.fail("'=' in an object literal")

    def async_single(self):
        start = self.s
        self.advance()
        self.name()
        return self.arrow_body(start, True)

    def async_arrow(self):
        start = self.s
        self.advance()
        return self.arrow(start, True)

    def generic_arrow(self):
        start = self.s
        self.type_params()
        return self.arrow(start)

    def arrow(self, start=None, is_async=False):
        start = self.s if start is None else start
        if self.ts and self.is_p("<"):
            self.type_params()
        saved = self.enter(is_async, False)
        consequent = saved[4]
        self.params()
        typed = False
        if self.ts and self.is_p(":"):
            typed = True
            self.advance()
            self.return_type()
        self.leave(saved)
        if not self.is_p("=>") or self.nl:
            self.fail("expected '=>'")
        kind = self.arrow_body(start, is_async)
        if typed and consequent and not self.is_p(":"):
            self.fail("expected ':'")
        return kind

    def arrow_body(self, start: int, is_async: bool):
        if not self.is_p("=>") or self.nl:
            self.fail("expected '=>'")
        self.advance()
        at = len(self.found)
        no_in = self.no_in
        saved = self.enter(is_async, False)
        if self.is_p("{"):
            self.block()
            self.leave(saved)
        else:
            self.no_in = no_in
            self.in_consequent = saved[4]
            self.assign()
            self.leave(saved)
        self.found.insert(at, Declaration("function", "", self.owner, start, self.last_end))
        return "arrow"

    def conditional(self):
        kind = self.binary(0)
        if self.is_p("?"):
            self.advance()
            old, self.in_consequent = self.in_consequent, True
            no_in, self.no_in = self.no_in, False
            self.assign()
            self.in_consequent, self.no_in = old, no_in
            self.need(":")
            self.assign()
            return "cond"
        return kind

    def binary(self, least: int):
        if self.t == "priv":
            self.advance()
            if not self.is_word("in"):
                self.fail("expected 'in'")
            kind = "priv"
        else:
            kind = self.unary()
        while True:
            v = self.v
            if self.t == "p" or self.t == "id":
                level = _BINARY.get(v)
                if level is None or level <= least or v == "in" and self.no_in:
                    if self.ts and self.t == "id" and v in ("as", "satisfies") and not self.nl and least < 8:
                        self.advance()
                        if self.is_word("const"):
                            self.advance()
                        else:
                            self.type_()
                        kind = "as" if kind not in ("id", "member") else kind
                        continue
                    if kind == "priv":
                        self.fail("unexpected private name")
                    return kind
                if v == "**" and kind == "unary":
                    self.fail("unary operator before '**'")
                self.advance()
                right = self.binary(level - 1 if v == "**" else level)
                if v == "??" and ("logic" in (kind, right)) or v in ("||", "&&") and "coalesce" in (kind, right):
                    self.fail("'??' mixed with logical operators")
                kind = "coalesce" if v == "??" else "logic" if v in ("||", "&&") else "bin"
            else:
                return kind

    def unary(self):
        t, v = self.t, self.v
        if t == "p":
            if v in ("!", "-", "+", "~"):
                self.advance()
                self.unary()
                return "unary"
            if v in ("++", "--"):
                self.advance()
                if self.unary() not in ("id", "member"):
                    self.fail("bad operand")
                return "update"
            if v == "<" and self.ts and not self.jsx:
                self.advance()
                if self.is_word("const"):
                    self.advance()
                else:
                    self.type_()
                self.need_close_angle()
                self.unary()
                return "as"
        elif t == "id":
            if v in ("typeof", "void", "delete"):
                self.advance()
                self.unary()
                return "unary"
            if v == "await" and (self.in_async or not self.in_function):
                nxt = self.ahead_token()
                if self.in_async or not (nxt[0] == "p" and nxt[1] in (")", ",", ";", "=", ".", "=>", ":", "]", "}")):
                    self.advance()
                    self.unary()
                    return "unary"
        kind = self.unary_operand()
        if self.t == "p" and self.v in ("++", "--") and not self.nl:
            if kind not in ("id", "member"):
                self.fail("bad operand")
            self.advance()
            return "update"
        return kind

    def unary_operand(self):
        kind = self.primary()
        if kind in ("arrow",):
            return kind
        optional = False
        while True:
            t, v = self.t, self.v
            if t == "p":
                if v == ".":
                    self.advance()
                    if self.t not in ("id", "priv"):
                        self.fail("member name expected")
                    self.advance()
                    kind = "member"
                elif v == "(":
                    self.arguments()
                    kind = "call"
                elif v == "[":
                    self.advance()
                    no_in, self.no_in = self.no_in, False
                    self.expression()
                    self.no_in = no_in
                    self.need("]")
                    kind = "member"
                elif v == "?.":
                    optional = True
                    self.advance()
                    if self.is_p("("):
                        self.arguments()
                    elif self.is_p("["):
                        self.advance()
                        self.expression()
                        self.need("]")
                    elif self.ts and self.is_p("<"):
                        self.type_args()
                        self.arguments()
                    elif self.t in ("id", "priv"):
                        self.advance()
                    else:
                        self.fail("member name expected")
                    kind = "opt"
                elif v == "!" and self.ts and not self.nl:
                    self.advance()
                    kind = kind if kind == "id" else "member"
                elif v in ("<", "<<") and self.ts:
                    if not self.attempt(self.call_type_args):
                        return "opt" if optional else kind
                    kind = "call"
                else:
                    break
            elif t == "tpl":
                self.template()
                kind = "call"
            else:
                break
        if optional:
            return "opt"
        return kind

    def call_type_args(self):
        self.type_args()
        if self.is_p("("):
            self.arguments()
            return "call"
        if self.t == "tpl":
            return "call"
        # An instantiation expression must not be followed by what can start an expression.
        if self.t in ("num", "str", "priv") or self.t == "id" and not self.nl and self.v not in ("as", "satisfies", "in", "instanceof", "of", "implements") or self.t == "p" and self.v in ("{", "[", "+", "-", "<", ">") and not self.nl:
            self.fail("not type arguments")
        return "call"

    def arguments(self):
        self.need("(")
        old, self.in_consequent = self.in_consequent, False
        no_in, self.no_in = self.no_in, False
        while not self.is_p(")"):
            if self.is_p("..."):
                self.advance()
            covers = self.covers
            self.assign()
            self.uncovered(covers)
            if not self.is_p(")"):
                self.need(",")
        self.in_consequent, self.no_in = old, no_in
        self.advance()

    def primary(self):
        t, v = self.t, self.v
        if t == "id":
            if v not in _RESERVED:
                if v == "async" and self.ahead() == "function":
                    nxt = self.ahead_token()
                    if not nxt[2]:
                        return self.function(self.s, False)
                self.advance()
                return "id"
            if v in ("this", "null", "true", "false"):
                self.advance()
                return "lit"
            if v == "function":
                return self.function(self.s, False)
            if v == "class":
                return self.class_(self.s, False)
            if v == "new":
                return self.new()
            if v == "super":
                self.advance()
                if not (self.t == "p" and self.v in ("(", ".", "[")):
                    self.fail("bad super")
                return "lit"
            if v == "import":
                self.advance()
                if self.is_p("."):
                    self.advance()
                    self.word()
                    return "lit"
                if not self.is_p("("):
                    self.fail("bad import")
                return "lit"
            self.fail(f"unexpected {v!r}")
        if t in ("num", "str"):
            self.advance()
            return "lit"
        if t == "tpl":
            self.template()
            return "tpl"
        if t == "p":
            if v == "(":
                self.advance()
                old, self.in_consequent = self.in_consequent, False
                no_in, self.no_in = self.no_in, False
                kind = self.expression()
                self.in_consequent, self.no_in = old, no_in
                self.need(")")
                return kind if kind in ("id", "member") else "paren"
            if v == "[":
                return self.array_literal()
            if v == "{":
                return self.object_literal()
            if v in ("/", "/="):
                m = _REGEX.match(self.src, self.s)
                if m is None:
                    self.fail("bad regular expression")
                flags = m.group(1)
                if len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy"):
                    self.fail("bad regular expression flags")
                self.e = m.end()
                self.advance()
                return "lit"
            if v == "<" and self.jsx:
                self.jsx_element()
                return "lit"
            if v == "@":
                start = self.s
                self.decorators()
                return self.class_(start, False)
        self.fail(f"unexpected {v or 'end'!r}")

    def new(self):
        self.advance()
        if self.is_p("."):
            self.advance()
            self.word()
            return "lit"
        if self.is_word("new"):
            self.new()
        elif self.is_word("import"):
            self.fail("bad new")
        else:
            self.primary()
        while True:
            if self.is_p("."):
                self.advance()
                if self.t not in ("id", "priv"):
                    self.fail("member name expected")
                self.advance()
            elif self.is_p("["):
                self.advance()
                self.expression()
                self.need("]")
            elif self.t == "tpl":
                self.template()
            elif self.is_p("?."):
                self.fail("optional chain in new")
            elif self.ts and self.is_p("!") and not self.nl:
                self.advance()
            else:
                break
        if self.ts and self.is_p("<"):
            self.attempt(lambda: self.type_args() or True)
        if self.is_p("("):
            self.arguments()
        return "call"

    def array_literal(self):
        self.advance()
        old, self.in_consequent = self.in_consequent, False
        no_in, self.no_in = self.no_in, False
        while not self.is_p("]"):
            if self.is_p(","):
                self.advance()
                continue
            if self.is_p("..."):
                self.advance()
            self.element()
            if not self.is_p("]"):
                self.need(",")
        self.in_consequent, self.no_in = old, no_in
        self.advance()
        return "arr"

    def element(self):
        """An element or property value; an object with defaults may yet become a pattern."""
        self.assign()

    def object_literal(self):
        self.advance()
        old, self.in_consequent = self.in_consequent, False
        no_in, self.no_in = self.no_in, False
        cover = False
        while not self.is_p("}"):
            if self.is_p("..."):
                self.advance()
                self.assign()
            else:
                cover |= self.property()
            if not self.is_p("}"):
                self.need(",")
        self.in_consequent, self.no_in = old, no_in
        self.advance()
        self.covers += cover
        return "obj"

    def property(self) -> bool:
        start = self.s
        is_async = star = False
        accessor = False
        if self.t == "id" and self.v in ("async", "get", "set"):
            nt, nv, nnl = self.ahead_token()
            if nt in ("id", "str", "num") or nt == "p" and nv in ("[", "*") and not (nv == "*" and self.v != "async"):
                is_async = self.v == "async"
                accessor = not is_async
                self.advance()
        if self.is_p("*"):
            star = True
            self.advance()
        word = self.t == "id"
        v = self.v
        self.property_name()
        if self.is_p("(") or self.ts and self.is_p("<"):
            at = len(self.found)
            if self.function_rest(is_async, star, False):
                self.found.insert(at, Declaration("property", v, self.owner, start, self.last_end))
            return False
        if star or is_async or accessor:
            self.fail("method expected")
        if self.is_p(":"):
            self.advance()
            self.element()
            return False
        if not word or v in _RESERVED:
            self.fail(f"unexpected {self.v!r}")
        if self.is_p("="):
            self.advance()
            self.assign()
            return True
        return False

    def template(self):
        at = self.e
        while True:
            m = _TEMPLATE.match(self.src, at)
            at = m.end()
            if at >= self.size:
                self.fail("unclosed template", self.s)
            if self.src[at] == "`":
                self.e = at + 1
                self.advance()
                return
            self.e = at + 2
            self.advance()
            old, self.in_consequent = self.in_consequent, False
            no_in, self.no_in = self.no_in, False
            self.expression()
            self.in_consequent, self.no_in = old, no_in
            if not self.is_p("}"):
                self.fail("expected '}'")
            at = self.e

    # JSX

    def jsx_element(self):
        """From '<' on; the token after the element is read at the end."""
        self.e = self.jsx_at(self.s)
        self.advance()

    def skip(self, at: int) -> int:
        return _SPACE.match(self.src, at).end()

    def jsx_at(self, at: int) -> int:
        src = self.src
        open_at = at
        at = self.skip(at + 1)
        tag = ""
        if src[at : at + 1] != ">":
            m = _JSX_NAME.match(src, at)
            if m is None:
                self.fail("element name expected", at)
            tag = m.group()
            at = self.skip(m.end())
            if self.ts and src[at : at + 1] == "<":
                self.scan(at)
                self.type_args()
                at = self.s
            while True:
                c = src[at : at + 1]
                if c == ">":
                    break
                if c == "/":
                    at = self.skip(at + 1)
                    if src[at : at + 1] != ">":
                        self.fail("expected '>'", at)
                    return at + 1
                if c == "{":
                    at = self.jsx_braces(at, True)
                    at = self.skip(at)
                    continue
                m = _JSX_NAME.match(src, at)
                if m is None or "." in m.group():
                    self.fail("attribute expected", at)
                at = self.skip(m.end())
                if src[at : at + 1] == "=":
                    at = self.skip(at + 1)
                    c = src[at : at + 1]
                    if c == "{":
                        at = self.jsx_braces(at, False)
                    elif c == "<":
                        at = self.jsx_at(at)
                    else:
                        m = _JSX_STRING.match(src, at)
                        if m is None:
                            self.fail("attribute value expected", at)
                        at = m.end()
                    at = self.skip(at)
        at += 1
        while True:
            at = _JSX_TEXT.match(src, at).end()
            c = src[at : at + 1]
            if c == "{":
                inner = self.skip(at + 1)
                at = inner + 1 if src[inner : inner + 1] == "}" else self.jsx_braces(at, None)
            elif c == "<":
                inner = self.skip(at + 1)
                if src[inner : inner + 1] == "/":
                    inner = self.skip(inner + 1)
                    m = _JSX_NAME.match(src, inner)
                    closing = m.group() if m else ""
                    inner = self.skip(m.end() if m else inner)
                    if closing != tag or src[inner : inner + 1] != ">":
                        self.fail(f"closing tag of {tag!r} expected", inner)
                    return inner + 1
                at = self.jsx_at(at)
            else:
                self.fail("unclosed element" if not c else f"unexpected {c!r} in element text", at if c else open_at)

    def jsx_braces(self, at: int, spread) -> int:
        """``spread``: True if '...' is needed, False if not allowed, None if either will do."""
        self.e = at + 1
        self.advance()
        if self.is_p("..."):
            if spread is False:
                self.fail("unexpected '...'")
            self.advance()
        elif spread:
            self.fail("expected '...'")
        saved = self.no_in, self.in_consequent
        self.no_in = self.in_consequent = False
        self.expression()
        self.no_in, self.in_consequent = saved
        if not self.is_p("}"):
            self.fail("expected '}'")
        return self.e

    # types

    def type_params(self):
        self.need("<")
        while True:
            while self.t == "id" and self.v in ("const", "in", "out") and self.ahead_token()[0] == "id":
                self.advance()
            self.name()
            if self.is_word("extends"):
                self.advance()
                self.type_()
            if self.is_p("="):
                self.advance()
                self.type_()
            if self.is_p(","):
                self.advance()
                if self.t == "p" and self.v.startswith(">"):
                    break
                continue
            break
        self.need_close_angle()

    def type_args(self):
        if self.is_p("<<"):
            self.e = self.s + 1
            self.advance()
        else:
            self.need("<")
        while True:
            self.type_()
            if self.is_p(","):
                self.advance()
                continue
            break
        self.need_close_angle()

    def type_list(self):
        while True:
            self.type_()
            if not self.is_p(","):
                return
            self.advance()

    def return_type(self):
        if self.is_word("asserts"):
            nxt = self.ahead_token()
            if nxt[0] == "id" and not nxt[2]:
                self.advance()
                self.advance()
                if self.is_word("is"):
                    self.advance()
                    self.type_()
                return
        if self.t == "id":
            nxt = self.ahead_token()
            if nxt[1] == "is" and nxt[0] == "id" and not nxt[2]:
                self.advance()
                self.advance()
        self.type_()

    def type_(self):
        t, v = self.t, self.v
        if t == "p" and v == "<" or t == "id" and v == "new" or t == "id" and v == "abstract" and self.ahead() == "new":
            if v == "abstract":
                self.advance()
            if self.is_word("new"):
                self.advance()
            if self.is_p("<"):
                self.type_params()
            self.params()
            self.need("=>")
            return self.return_type()
        if t == "p" and v == "(":
            if self.s not in self.not_arrow or True:
                if self.attempt(self.function_type):
                    return None
        self.union()
        if self.is_word("extends") and not self.nl and not self.no_conditional_type:
            self.advance()
            old, self.no_conditional_type = self.no_conditional_type, True
            self.type_()
            self.no_conditional_type = False
            self.need("?")
            self.type_()
            self.need(":")
            self.type_()
            self.no_conditional_type = old
        return None

    def function_type(self):
        saved = self.enter(False, False)
        self.params()
        self.leave(saved)
        self.need("=>")
        self.return_type()
        return True

    def union(self):
        if self.t == "p" and self.v in ("|", "&"):
            self.advance()
        while True:
            self.type_operator()
            if self.t == "p" and self.v in ("|", "&"):
                self.advance()
                if self.is_p("(") and self.attempt(self.function_type):
                    return
                continue
            return

    def type_operator(self):
        while self.t == "id" and self.v in ("keyof", "unique", "readonly", "infer"):
            nt, nv, _ = self.ahead_token()
            if not (nt in ("id", "str", "num", "tpl") or nt == "p" and nv in ("(", "[", "{")) or nt == "id" and nv in ("extends", "is"):
                break
            infer = self.v == "infer"
            self.advance()
            if infer:
                self.name()
                if self.is_word("extends"):
                    state = self.save()
                    old, self.no_conditional_type = self.no_conditional_type, True
                    self.advance()
                    try:
                        self.union()
                        if self.is_p("?") and not old:
                            self.back(state)
                    except _Fail:
                        self.back(state)
                    self.no_conditional_type = old
                return
        self.type_primary()
        while self.is_p("[") and not self.nl:
            self.advance()
            if not self.is_p("]"):
                self.type_()
            self.need("]")

    def type_primary(self):
        t, v = self.t, self.v
        old, self.no_conditional_type = self.no_conditional_type, self.no_conditional_type
        if t == "id":
            if v == "typeof":
                self.advance()
                if self.is_word("import"):
                    self.import_type()
                else:
                    self.word()
                    while self.is_p("."):
                        self.advance()
                        if self.t not in ("id", "priv"):
                            self.fail("name expected")
                        self.advance()
                if self.is_p("<") and not self.nl:
                    self.type_args()
            elif v == "import":
                self.import_type()
            elif v in _RESERVED and v not in ("this", "null", "true", "false", "void"):
                self.fail(f"unexpected {v!r} in a type")
            else:
                self.advance()
                while self.is_p("."):
                    self.advance()
                    self.word()
                if self.is_p("<") and not self.nl or self.is_p("<<") and not self.nl:
                    self.type_args()
        elif t in ("str", "num"):
            self.advance()
        elif t == "tpl":
            self.template_type()
        elif t == "p" and v == "-":
            self.advance()
            if self.t != "num":
                self.fail("number expected")
            self.advance()
        elif t == "p" and v == "{":
            self.no_conditional_type = False
            if not self.attempt(self.mapped_type):
                self.object_type()
        elif t == "p" and v == "[":
            self.no_conditional_type = False
            self.tuple_type()
        elif t == "p" and v == "(":
            self.advance()
            self.no_conditional_type = False
            self.type_()
            self.need(")")
        else:
            self.fail(f"type expected, found {v!r}")
        self.no_conditional_type = old

    def import_type(self):
        self.advance()
        self.need("(")
        self.type_()
        if self.is_p(","):
            self.advance()
            self.object_literal()
        self.need(")")
        while self.is_p("."):
            self.advance()
            self.word()
        if self.is_p("<"):
            self.type_args()

    def template_type(self):
        at = self.e
        while True:
            at = _TEMPLATE.match(self.src, at).end()
            if at >= self.size:
                self.fail("unclosed template", self.s)
            if self.src[at] == "`":
                self.e = at + 1
                self.advance()
                return
            self.e = at + 2
            self.advance()
            self.type_()
            if not self.is_p("}"):
                self.fail("expected '}'")
            at = self.e

    def tuple_type(self):
        self.advance()
        while not self.is_p("]"):
            if self.is_p("..."):
                self.advance()
            if self.t == "id":
                nt, nv, _ = self.ahead_token()
                if nt == "p" and nv == ":":
                    self.advance()
                    self.advance()
                elif nt == "p" and nv == "?":
                    state = self.save()
                    self.advance()
                    self.advance()
                    if self.is_p(":"):
                        self.advance()
                    else:
                        self.back(state)
            self.type_()
            if self.is_p("?"):
                self.advance()
            if not self.is_p("]"):
                self.need(",")
        self.advance()

    def mapped_type(self):
        self.need("{")
        if self.t == "p" and self.v in ("+", "-"):
            self.advance()
            if not self.is_word("readonly"):
                self.fail("expected 'readonly'")
        if self.is_word("readonly"):
            self.advance()
        self.need("[")
        self.name()
        self.need("in")
        self.type_()
        if self.is_word("as"):
            self.advance()
            self.type_()
        self.need("]")
        if self.t == "p" and self.v in ("+", "-"):
            self.advance()
        self.eat("?")
        if self.is_p(":"):
            self.advance()
            self.type_()
        if self.t == "p" and self.v in (";", ","):
            self.advance()
        self.need("}")
        return True

    def index_signature(self):
        self.need("[")
        self.name()
        self.need(":")
        self.type_()
        self.need("]")
        if self.is_p(":"):
            self.advance()
            self.type_()
        return True

    def object_type(self):
        self.need("{")
        while not self.is_p("}"):
            self.type_member()
            if self.t == "p" and self.v in (";", ","):
                self.advance()
            elif not (self.nl or self.is_p("}")):
                self.fail(f"unexpected {self.v!r} in a type")
        self.advance()

    def type_member(self):
        if self.is_p("(") or self.is_p("<"):
            return self.signature()
        if self.is_word("new") and self.ahead_token()[1] in ("(", "<"):
            self.advance()
            return self.signature()
        while self.t == "id" and self.v in ("readonly", "get", "set"):
            nt, nv, _ = self.ahead_token()
            if nt in ("id", "str", "num") or nt == "p" and nv == "[":
                self.advance()
            else:
                break
        if self.is_p("[") and self.attempt(self.index_signature):
            return None
        self.property_name()
        if self.is_p("?"):
            self.advance()
        if self.is_p("(") or self.is_p("<"):
            return self.signature()
        if self.is_p(":"):
            self.advance()
            self.type_()
        return None

    def signature(self):
        if self.is_p("<"):
            self.type_params()
        self.params()
        if self.is_p(":"):
            self.advance()
            self.return_type()


_STATEMENTS = {
    "var": _Parser.s_var, "const": _Parser.s_var, "let": _Parser.s_let, "using": _Parser.s_using, "function": _Parser.s_function, "async": _Parser.s_async,
    "class": _Parser.s_class, "if": _Parser.s_if, "for": _Parser.s_for, "while": _Parser.s_while, "do": _Parser.s_do, "switch": _Parser.s_switch,
    "try": _Parser.s_try, "throw": _Parser.s_throw, "return": _Parser.s_return, "break": _Parser.s_break, "continue": _Parser.s_break,
    "debugger": _Parser.s_debugger, "with": _Parser.s_with, "import": _Parser.s_import, "export": _Parser.s_export, "interface": _Parser.s_interface,
    "type": _Parser.s_type, "enum": _Parser.s_enum, "namespace": _Parser.s_namespace, "module": _Parser.s_namespace, "declare": _Parser.s_declare,
    "abstract": _Parser.s_abstract,
}


def parse(source: str, *, ts: bool = False, jsx: bool = False) -> list[Declaration]:
    """Declarations of a text in order of their start; ``EcmaError`` where it does not parse. An empty text parses."""
    limit = sys.getrecursionlimit()
    if limit < 60_000:
        sys.setrecursionlimit(60_000)
    try:
        return _Parser(source, ts, jsx).program()
    except _Fail as problem:
        message, at = problem.args
        raise EcmaError(message, source.count("\n", 0, at) + 1) from None
    except RecursionError:
        raise EcmaDepthError("nested too deeply", 1) from None
    finally:
        sys.setrecursionlimit(limit)
