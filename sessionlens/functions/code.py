"""What a piece of source text calls, declares and imports: Python and TypeScript by patterns, Go by its grammar.

For patterns, comments and strings are blanked first, in place, so positions and line ends stay. Patterns then find names.
Each function handles one text; Spark deals the texts out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from . import go_syntax

# Words of the languages, and names that are always there.
PYTHON_WORDS = """False None True and as assert async await break class continue def del elif else except finally for from global if
import in is lambda nonlocal not or pass raise return try while with yield""".split()
PYTHON_BUILTINS = """print len range open isinstance issubclass super type dict list set tuple frozenset str int float bool bytes bytearray
complex object property staticmethod classmethod enumerate zip map filter sorted reversed sum min max abs round pow divmod hex oct bin chr ord
repr format vars dir id hash iter next callable getattr setattr hasattr delattr globals locals exec eval compile input help exit quit all any
slice memoryview Exception ValueError TypeError KeyError IndexError AttributeError RuntimeError StopIteration NotImplementedError
FileNotFoundError OSError IOError ImportError ModuleNotFoundError ZeroDivisionError ArithmeticError AssertionError NameError UnboundLocalError
PermissionError TimeoutError KeyboardInterrupt GeneratorExit StopAsyncIteration EOFError SystemExit SystemError UnicodeError
UnicodeDecodeError UnicodeEncodeError OverflowError FloatingPointError BufferError MemoryError RecursionError ReferenceError ConnectionError
BrokenPipeError InterruptedError IsADirectoryError NotADirectoryError ProcessLookupError ChildProcessError BlockingIOError IndentationError
TabError SyntaxWarning Warning DeprecationWarning UserWarning RuntimeWarning SyntaxError FutureWarning PendingDeprecationWarning ImportWarning
BytesWarning ResourceWarning EnvironmentError LookupError ConnectionAbortedError ConnectionResetError ConnectionRefusedError""".split()
SCRIPT_WORDS = """return if else for while do switch case default break continue new delete typeof instanceof in of void this super try catch
finally throw yield await async import export from as static get set class extends with debugger null true false undefined""".split()
SCRIPT_BUILTINS = """Object Array Promise Map Set WeakMap WeakSet Symbol Proxy Reflect RegExp Error TypeError RangeError SyntaxError
ReferenceError EvalError URIError Number String Boolean Date Function ArrayBuffer Int8Array Uint8Array Uint8ClampedArray Int16Array Uint16Array
Int32Array Uint32Array Float32Array Float64Array BigInt64Array BigUint64Array DataView Intl BigInt JSON Math parseInt parseFloat isNaN isFinite
encodeURIComponent decodeURIComponent encodeURI decodeURI setTimeout setInterval clearTimeout clearInterval structuredClone fetch btoa atob
queueMicrotask require describe it test expect beforeEach afterEach beforeAll afterAll Request Response Headers URL URLSearchParams FormData
Blob File FileReader EventSource WebSocket AbortController AbortSignal ReadableStream WritableStream TransformStream TextEncoder TextDecoder
Worker MessageChannel MessagePort Event EventTarget CustomEvent performance crypto process globalThis Buffer""".split()

ALWAYS = {"python": frozenset(PYTHON_WORDS + PYTHON_BUILTINS), "typescript": frozenset(SCRIPT_WORDS + SCRIPT_BUILTINS)}
DECLARING = {"python": ("def", "class"), "typescript": ("function", "class")}
_S = r"[\t\n\f\r ]"
#: Comments and strings of a language, the longest opening first; what is not closed runs to the end.
MASKS = {
    "python": re.compile(r"#[^\n]*|" + "|".join(rf"{q}(?:\\.|(?!{q}).)*(?:{q}|\Z)" for q in ('"""', "'''", '"', "'")), re.S),
    "typescript": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|" + "|".join(rf"{q}(?:\\.|(?!{q}).)*(?:{q}|\Z)" for q in ("`", '"', "'")), re.S),
}
NAME = {"python": r"[A-Za-z_]\w*", "typescript": r"[A-Za-z_$]\w*"}


def _rx(*patterns: str) -> tuple[re.Pattern, ...]:
    return tuple(re.compile(p.replace(r"\s", _S), re.A | re.M) for p in patterns)


P, T = NAME["python"], NAME["typescript"]
#: One declared name each.
SINGLE = {
    "python": _rx(rf"\bdef\s+({P})\s*\(", rf"\bclass\s+({P})", rf"\b({P})\s*=[^=]", rf"\bas\s+({P})\b"),
    "typescript": _rx(rf"\bfunction\s*\*?\s+({T})\s*(?:<[^>]*>)?\s*\(", rf"\b(?:const|let|var)\s+({T})\s*=", rf"\bclass\s+({T})"),
}
#: A list of bound names each.
LISTS = {
    "python": _rx(rf"\bfor\s+({P}(?:\s*,\s*{P})*)\s+in\b", rf"^\s*({P}(?:\s*,\s*{P})+)\s*=[^=]"),
    "typescript": _rx(r"\b(?:const|let|var)\s*\[([^\[\]]*)\]\s*=", r"\b(?:const|let|var)\s*\{([^{}]*)\}\s*="),
}
#: Import forms: groups hold single names or lists.
IMPORTS = {
    "python": _rx(r"^\s*from\s+[\w.]+\s+import\s+(\([^)]*\)|[^\n]+)"),
    "typescript": _rx(rf"\bimport\s+(?:type\s+)?({T})\s*(?:,\s*\{{([^}}]*)\}})?\s*from\b", r"\bimport\s*(?:type\s+)?\{([^}]*)\}\s*from\b", rf"\bimport\s*\*\s*as\s+({T})\s*from\b", r"\b(?:const|let|var)\s*\{([^}]*)\}\s*=\s*require\(", rf"\b(?:const|let|var)\s+({T})\s*=\s*require\("),
}
PLAIN_IMPORT = _rx(r"^\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?")[0]
WILDCARD = _rx(r"^\s*from\s+[\w.]+\s+import\s+\*")[0]
#: Parameter lists.
PARAMETERS = {
    "python": _rx(rf"\bdef\s+{P}\s*\(([^()]*)\)", r"\blambda\s+([^:]*):"),
    "typescript": _rx(r"\(([^()]*)\)\s*=>", rf"\b({T})\s*=>", r"\bfunction\s*\*?\s*[A-Za-z_$]*\s*\(([^()]*)\)"),
}
CALL = _rx(r"\b([A-Za-z_$][A-Za-z0-9_$]*)\s*\(")[0]
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*", re.A)


def mask(text: str, language: str) -> str:
    """`text` with comments and strings as spaces; line ends stay."""
    return MASKS[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int) -> int:
    """Where the bracket at `at` closes, or -1."""
    pair = {"(": ")", "[": "]", "{": "}"}
    depth = 0
    for m in re.compile(rf"[{re.escape(text[at] + pair[text[at]])}]").finditer(text, at):
        depth += 1 if m[0] == text[at] else -1
        if not depth:
            return m.start()
    return -1


def opens_block(text: str, close: int) -> bool:
    """A body follows the bracket at `close`, at once or after a type within 200 signs."""
    rest = re.compile(r"[ \t\r\n]*").match(text, close + 1).end()
    if text[rest : rest + 1] != ":":
        return text[rest : rest + 1] == "{"
    depth = 0
    for i in range(rest + 1, min(len(text), rest + 200)):
        c = text[i]
        depth = max(0, depth + (c in "<([") - (c in ">)]"))
        if c == ";" or (c == "\n" and not depth and text[i + 1 : i + 2] == "\n"):
            return False
        if c == "{" and not depth:
            return True
    return False


def parts(text: str) -> list[str]:
    """Split at commas outside brackets."""
    out, depth, held = [], 0, ""
    for c in text:
        depth += (c in "([{<") - (c in ")]}>" and depth > 0)
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [p.strip() for p in [*out, held]]


def bound(text: str) -> list[str]:
    """Names that a list of parameters, imports or destructured parts binds: after `as` or `:` where renamed, before a default."""
    out = []
    for p in parts(text.strip().removeprefix("(").removesuffix(")")):
        p = p.removeprefix("type ").strip().lstrip("*. ")
        if p[:1] in "{[" and p[:1]:
            end = closing(p, 0)
            out += bound(p[1:end]) if end > 0 else []
            continue
        for piece in ([re.split(r"\s+as\s+", p)[-1]] if " as " in p else [x.split("=")[0] for x in p.split(":", 1)]):
            name = piece.strip().rstrip("?")
            if _IDENT.fullmatch(name):
                out.append(name)
    return out


def calls(masked: str) -> list[tuple[str, int, bool]]:
    """`(name, start, declares)` of every `name(` that is not a member; `declares` if a body follows its brackets."""
    out = []
    for m in CALL.finditer(masked):
        before = masked[: m.start()].rstrip(" \t") if masked[m.start() - 1 : m.start()] in (" ", "\t", ".") else masked[m.start() - 1 : m.start()]
        if before.endswith("."):
            continue
        end = closing(masked, m.end() - 1)
        out.append((m[1], m.start(), end >= 0 and opens_block(masked, end)))
    return out


def imports(masked: str, language: str) -> tuple[list[str], bool]:
    """Names that a file imports, and whether it imports all of something."""
    if language == "python" and WILDCARD.search(masked):
        return [], True
    out = [n for rx in IMPORTS[language] for m in rx.finditer(masked) for g in m.groups() if g for n in bound(g)]
    if language == "python":
        out += [m[2] or m[1].split(".")[0] for m in PLAIN_IMPORT.finditer(masked)]
    return out, False


def declarations(text: str, language: str) -> Iterator[tuple[str, str, int | None]]:
    """`(kind, name, position)` of every name that a file binds, imports included; Go's are those of its top level, by kind and place."""
    if language == "go":
        yield from go_syntax.declarations(text)
    else:
        yield from (("name", n, None) for n in declared(text, language))


def declared(text: str, language: str) -> list[str]:
    """Every name that a file of a language read by patterns binds, imports included."""
    m = mask(text, language)
    out = {x[1] for rx in SINGLE[language] for x in rx.finditer(m)} | {n for rx in LISTS[language] for x in rx.finditer(m) for n in bound(x[1])}
    return sorted(out | {n for n, _, d in calls(m) if d} | set(imports(m, language)[0]))


def candidates(text: str, language: str) -> list[str]:
    """Bare calls of a snippet in first-seen order: three letters or more, no builtin, no declaration, no parameter of its own."""
    if language == "go":
        return go_syntax.exported_calls(text)
    m = mask(text, language)
    found = calls(m)
    local = {n for rx in PARAMETERS[language] for x in rx.finditer(m) for n in bound(x[1])}
    if language == "typescript":
        local |= {n for _, at, d in found if d for o in [m.index("(", at)] for n in bound(m[o + 1 : closing(m, o)])}
    out = dict.fromkeys(n for n, at, d in found if len(n) >= 3 and not d and n not in ALWAYS[language] and not re.search(rf"(?:^|[^\w$])(?:{'|'.join(DECLARING[language])})[ \t]*$", m[max(0, at - 40) : at]))
    return [n for n in out if n not in local]


def imported(text: str, language: str) -> tuple[list[str], bool]:
    return imports(mask(text, language), language) if language != "go" else ([], False)
