"""Syntax of Go files and function bodies: which functions a text calls by bare name, and what a file declares.

Tokens come from one pattern, with semicolons where a line ends a statement. A recursive descent then checks the grammar
and notes calls and top-level declarations on the way; no tree is kept. Text that the grammar does not take gives nothing.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# The language's own words and operators.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDING = frozenset("break continue fallthrough return ++ -- ) ] }".split())
PRECEDENCE = {"||": 1, "&&": 2, **dict.fromkeys("== != < <= > >=".split(), 3), **dict.fromkeys("+ - | ^".split(), 4), **dict.fromkeys("* / % << >> & &^".split(), 5)}
ASSIGNING = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
UNARY = frozenset("+ - ! ^ & * <- ~".split())

_ESCAPE = r"\\(?:[abfnrtv\\{}]|x[0-9A-Fa-f]{{2}}|[0-7]{{3}}|u[0-9A-Fa-f]{{4}}|U[0-9A-Fa-f]{{8}})"
_TOKEN = re.compile(
    r"(?P<space>[ \t\r]+)|(?P<line>\n|//[^\n]*)|(?P<comment>/\*.*?\*/)|(?P<name>[^\W\d]\w*)"
    + r"|(?P<number>0[xX][0-9A-Fa-f_]*\.?[0-9A-Fa-f_]*(?:[pP][+-]?[0-9_]+)?i?|0[bBoO][0-7_]+i?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?i?)"
    + r"|(?P<string>`[^`]*`|\"(?:[^\"\\\n]|" + _ESCAPE.format('"') + r")*\"|'(?:[^'\\\n]|" + _ESCAPE.format("'") + r")')"
    + r"|(?P<sign><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])",
    re.S,
)


class NotGo(ValueError):
    """Text that the grammar does not take."""


class Declared(NamedTuple):
    kind: str
    name: str
    position: int


def tokens(text: str) -> list[tuple[str, str, int]]:
    """`(kind, text, position)`: kind is the token itself for signs and keywords, else name, literal or end."""
    out: list[tuple[str, str, int]] = []
    at, open_line = 0, False

    def end_line(where: int) -> None:
        if open_line:
            out.append((";", "\n", where))

    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise NotGo(f"no token at {at}")
        kind, found = m.lastgroup, m[0]
        if kind == "line" or (kind == "comment" and "\n" in found):
            end_line(at)
            open_line = False
        elif kind not in ("space", "comment"):
            word = found in KEYWORDS if kind == "name" else kind == "sign"
            out.append((found if word else "name" if kind == "name" else "literal", found, at))
            open_line = not word or found in ENDING
        at = m.end()
    end_line(at)
    out.append(("end", "", at))
    return out


class Reader:
    """One pass over the tokens of a file. What an expression is made of is told by a short word: name, dotted, index, literal type, call, other."""

    def __init__(self, text: str):
        self.tokens = tokens(text)
        self.at = 0
        self.clause = False  # in the head of a statement with a body, where a brace begins that body
        self.calls: list[tuple[int, str]] = []
        self.declared: list[Declared] = []

    # --- tokens ---
    @property
    def now(self) -> str:
        return self.tokens[self.at][0]

    def take(self, *kinds: str) -> bool:
        if self.now in kinds:
            self.at += 1
            return True
        return False

    def need(self, kind: str) -> str:
        if self.now != kind:
            raise NotGo(f"{kind} expected at {self.tokens[self.at][2]}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def ends(self, *closing: str) -> None:
        """A statement or entry ends: with a semicolon, or before a closing bracket."""
        if self.now not in closing:
            self.need(";")

    def attempt(self, *ways):
        """The first of several readings that fits."""
        kept = self.at, self.clause, len(self.calls)
        for way in ways[:-1]:
            try:
                return way()
            except NotGo:
                self.at, self.clause = kept[:2]
                del self.calls[kept[2] :]
        return ways[-1]()

    def inside(self, read, *args):
        """`read` within brackets, where composite literals may stand again."""
        kept, self.clause = self.clause, False
        out = read(*args)
        self.clause = kept
        return out

    def listed(self, read, closing: str) -> list:
        """Entries with commas between them, one after the last allowed, up to a closing bracket."""
        out = []
        while self.now != closing:
            out.append(read())
            if not self.take(","):
                break
        self.need(closing)
        return out

    # --- types ---
    def may_be_type(self) -> bool:
        return self.now in ("name", "*", "[", "(", "map", "chan", "<-", "func", "struct", "interface")

    def type_(self) -> str:
        if self.now == "name":
            return self.named_type()
        if self.take("*"):
            self.type_()
        elif self.take("("):
            self.type_()
            self.need(")")
        elif self.take("["):
            if self.now != "]":
                self.inside(lambda: self.take("...") or self.expression())
            self.need("]")
            self.type_()
            return "literal type"
        elif self.take("map"):
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
            return "literal type"
        elif self.take("chan"):
            self.take("<-")
            self.type_()
        elif self.take("<-"):
            self.need("chan")
            self.type_()
        elif self.take("func"):
            self.signature()
        elif self.take("struct"):
            self.need("{")
            while not self.take("}"):
                self.attempt(self.fields, self.embedded)
                self.take("literal")
                self.ends("}")
            return "literal type"
        elif self.take("interface"):
            self.need("{")
            while not self.take("}"):
                self.attempt(self.method, self.constraint)
                self.ends("}")
        else:
            raise NotGo(f"type expected at {self.tokens[self.at][2]}")
        return "type"

    def named_type(self) -> str:
        self.need("name")
        kind = "name"
        if self.take("."):
            self.need("name")
            kind = "dotted"
        if self.now == "[" and self.tokens[self.at + 1][0] != "]":
            self.at += 1
            self.inside(self.listed, self.type_, "]")
            kind = "index"
        return kind

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type_()
            if not self.take("|"):
                return

    def method(self) -> None:
        self.need("name")
        if self.now != "(":
            raise NotGo("no method")
        self.signature()

    def fields(self) -> None:
        self.names()
        self.type_()
        if self.now not in (";", "}", "literal"):
            raise NotGo("no field")

    def embedded(self) -> None:
        if self.take("("):
            self.embedded()
            self.need(")")
        else:
            self.take("*")
            self.named_type()

    def signature(self) -> None:
        self.parameters()
        if self.now == "(":
            self.parameters()
        elif self.may_be_type():
            self.type_()

    def parameters(self) -> None:
        self.need("(")
        given = self.inside(self.listed, self.parameter, ")")
        if "named" in given and ("typed" in given or given[-1] == "name"):
            raise NotGo("named and unnamed parameters")

    def parameter(self) -> str:
        def alone() -> str:
            start = self.at
            if self.take("..."):
                self.type_()
                return "typed"
            kind = self.type_()
            if self.now not in (",", ")"):
                raise NotGo("more follows")
            return "name" if kind == "name" and self.at == start + 1 else "typed"

        def named() -> str:
            self.need("name")
            self.take("...")
            self.type_()
            return "named"

        return self.attempt(alone, named)

    def type_parameters(self) -> None:
        self.need("[")

        def entry() -> None:
            self.names()
            self.constraint()

        if not self.inside(self.listed, entry, "]"):
            raise NotGo("no type parameters")

    def names(self) -> list[tuple[str, int]]:
        out = []
        while True:
            out.append((self.tokens[self.at][1], self.tokens[self.at][2]))
            self.need("name")
            if not self.take(","):
                return out

    # --- expressions ---
    def expression(self, above: int = 0) -> str:
        kind = self.unary()
        while PRECEDENCE.get(self.now, 0) > above:
            level = PRECEDENCE[self.now]
            self.at += 1
            self.expression(level)
            kind = "other"
        return kind

    def expressions(self) -> list[str]:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def unary(self) -> str:
        if self.now == "<-" and self.tokens[self.at + 1][0] == "chan":
            return self.attempt(self.primary, self.received)
        if self.now in UNARY:
            return self.received()
        return self.primary()

    def received(self) -> str:
        self.at += 1
        self.unary()
        return "other"

    def operand(self) -> str:
        if self.take("literal"):
            return "other"
        if self.take("name"):
            return "name"
        if self.take("("):
            self.inside(self.expression)
            self.need(")")
            return "other"
        if self.take("func"):
            self.signature()
            if self.now == "{":
                self.inside(self.block)
                return "other"
            return "type"
        return self.type_()

    def primary(self) -> str:
        start, kind = self.at, self.operand()
        while True:
            if self.take("."):
                if self.take("("):
                    if not self.take("type"):
                        self.type_()
                    self.need(")")
                    kind = "other"
                else:
                    self.need("name")
                    kind = "dotted" if kind in ("name", "dotted") else "other"
            elif self.now == "[":
                self.at += 1
                self.inside(self.index)
                kind = "index" if kind in ("name", "dotted") else "other"
            elif self.take("("):
                if kind == "name":
                    self.calls.append((start, self.tokens[start][1]))
                self.inside(self.listed, self.argument, ")")
                kind = "call"
            elif self.now == "{" and (kind == "literal type" or (kind in ("name", "dotted", "index") and not self.clause)):
                self.at += 1
                self.inside(self.listed, self.element, "}")
                kind = "other"
            else:
                return kind

    def argument(self) -> None:
        self.expression()
        self.take("...")

    def index(self) -> None:
        if self.now != ":":
            self.expression()
        if self.now == ":":
            colons = 0
            while colons < 2 and self.take(":"):
                colons += 1
                if self.now not in (":", "]"):
                    self.expression()
                elif colons == 2 or self.now == ":":
                    raise NotGo("a part of the slice is missing")
        else:
            while self.take(",") and self.now != "]":
                self.type_()
        self.need("]")

    def element(self) -> None:
        def value() -> None:
            if self.take("{"):
                self.listed(self.element, "}")
            else:
                self.expression()

        value()
        if self.take(":"):
            value()

    # --- statements ---
    def block(self) -> None:
        self.need("{")
        self.statements("}")
        self.need("}")

    def body(self) -> None:
        self.clause = False
        self.block()

    def statements(self, *closing: str) -> None:
        while self.now not in closing:
            self.statement()
            self.ends(*closing)

    def simple(self, ranges: bool = False) -> str:
        """What the statement is: expression, label, range or other."""
        if ranges and self.take("range"):
            self.expression()
            return "range"
        given = self.expressions()
        if self.now in ASSIGNING:
            self.at += 1
            if ranges and self.tokens[self.at - 1][1] in ("=", ":=") and self.take("range"):
                self.expression()
                return "range"
            self.expressions()
            return "other"
        if len(given) > 1:
            raise NotGo("one expression expected")
        if self.take("++", "--"):
            return "other"
        if self.take("<-"):
            self.expression()
            return "other"
        return "label" if given[0] == "name" and self.now == ":" else "expression"

    def statement(self) -> None:
        word = self.now
        if word in ("const", "var", "type"):
            self.declaration(top=False)
        elif word in ("go", "defer"):
            self.at += 1
            if self.expression() != "call":
                raise NotGo("a call expected")
        elif self.take("return"):
            if self.now not in (";", "}"):
                self.expressions()
        elif self.take("break", "continue", "goto"):
            self.take("name")
        elif self.take("fallthrough"):
            pass
        elif word == "{":
            self.block()
        elif word in ("if", "for", "switch", "select"):
            kept, self.clause = self.clause, word != "select"
            self.at += 1
            getattr(self, f"{word}_")()
            self.clause = kept
        elif word not in (";", "}"):
            if self.simple() == "label":
                self.need(":")
                if self.now != "}":
                    self.statement()

    def if_(self) -> None:
        kind = "none" if self.now == ";" else self.simple()
        if self.take(";"):
            kind = self.simple()
        if kind != "expression":
            raise NotGo("a condition expected")
        self.body()
        if self.take("else"):
            if self.take("if"):
                self.clause = True
                self.if_()
            else:
                self.body()

    def for_(self) -> None:
        kind = "none" if self.now in ("{", ";") else self.simple(ranges=True)
        if kind != "range" and self.take(";"):
            if self.now != ";" and self.simple() != "expression":
                raise NotGo("a condition expected")
            self.need(";")
            if self.now != "{":
                self.simple()
        elif kind not in ("none", "range", "expression"):
            raise NotGo("a condition expected")
        self.body()

    def switch_(self) -> None:
        if self.now not in ("{", ";"):
            self.simple()
        if self.take(";") and self.now != "{":
            self.simple()
        self.cases(lambda: self.expressions())

    def select_(self) -> None:
        self.cases(lambda: self.simple())

    def cases(self, head) -> None:
        self.clause = False
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                head()
            else:
                self.need("default")
            self.need(":")
            self.statements("case", "default", "}")

    # --- declarations ---
    def declaration(self, top: bool) -> None:
        word = self.now
        self.at += 1
        if self.take("("):
            while not self.take(")"):
                self.entry(word, top)
                self.ends(")")
        else:
            self.entry(word, top)

    def entry(self, word: str, top: bool) -> None:
        if word == "type":
            names = [(self.tokens[self.at][1], self.tokens[self.at][2])]
            self.need("name")

            def generic() -> None:
                self.type_parameters()
                self.take("=")
                self.type_()

            def plain() -> None:
                self.take("=")
                self.type_()

            self.attempt(generic, plain) if self.now == "[" else plain()
        else:
            names = self.names()
            if self.now != "=" and (word == "var" or self.may_be_type()):
                self.type_()
            if self.take("="):
                self.expressions()
        if top:
            self.declared += [Declared(word, n, at) for n, at in names]

    def function(self) -> None:
        self.need("func")
        kind = "func"
        if self.now == "(":
            self.parameters()
            kind = "method"
        self.declared.append(Declared(kind, self.tokens[self.at][1], self.tokens[self.at][2]))
        self.need("name")
        if self.now == "[":
            self.type_parameters()
        self.signature()
        if self.now == "{":
            self.block()

    def file(self) -> Reader:
        self.need("package")
        self.declared.append(Declared("package", self.tokens[self.at][1], self.tokens[self.at][2]))
        self.need("name")
        self.ends("end")
        while self.take("import"):
            if self.take("("):
                while not self.take(")"):
                    self.imported()
                    self.ends(")")
            else:
                self.imported()
            self.ends("end")
        while self.now != "end":
            if self.now == "func":
                self.function()
            elif self.now in ("const", "var", "type"):
                self.declaration(top=True)
            else:
                raise NotGo("a declaration expected")
            self.ends("end")
        return self

    def imported(self) -> None:
        self.take("name") or self.take(".")
        self.need("literal")


def read_file(text: str) -> Reader | None:
    """A whole file, or None if it is not Go."""
    try:
        return Reader(text).file()
    except (NotGo, RecursionError):
        return None


def read_snippet(text: str) -> Reader | None:
    """A piece of a file: with or without its package line, or statements of a function's body."""
    whole = text if text.strip().startswith("package ") else f"package p\n{text}"
    return read_file(whole) or read_file(f"package p\nfunc _() {{\n{text}\n}}\n")


def exported_calls(text: str) -> list[str]:
    """Exported names of three letters or more that a snippet calls without a selector, in order of first use."""
    got = read_snippet(text)
    return list(dict.fromkeys(n for _, n in sorted(got.calls) if len(n.encode()) >= 3 and n[0].isupper())) if got else []


def declarations(text: str) -> list[Declared]:
    """The package, and top-level functions, methods, types, variables and constants of a file; none of a file that does not parse."""
    got = read_file(text)
    return got.declared if got else []
