"""Chunks of source files: definitions by syntax, else by separators.

Python files are read with the ``ast`` module. Languages with braces are read by a
scanner that knows comments and strings and finds definitions before their braces;
it gives rows of the same form as a grammar would, not the same nodes.
"""

from __future__ import annotations

import ast
import re

from tessera.chunking import languages
from tessera.chunking.prose import Chunk, markdown, rst
from tessera.chunking.refine import packed


def _python(text: str) -> list[Chunk]:
    lines, out = text.split("\n"), []

    def walk(node: ast.AST, parent: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if isinstance(node, ast.ClassDef) else "function"
                out.append(Chunk("\n".join(lines[first - 1 : child.end_lineno]), first, child.end_lineno, "code", "python", [], child.name, kind, parent))
                walk(child, child.name if is_class else parent)
            else:
                walk(child, parent)

    walk(ast.parse(text), "")
    return out


_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_TYPE = re.compile(r"\b(class|interface|enum|struct|trait|impl|abstract|namespace|module|mod|object)\s+([A-Za-z_]\w*)")
_FUNCTION = re.compile(r"\b(?:function|func|fn|def|fun)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")
_METHOD = re.compile(r"([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:[\w:<>,\s.&*\[\]-]*)$")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "new", "match", "loop", "with"}
_KIND = {"interface": "interface", "trait": "interface", "enum": "enum", "abstract": "abstract"}


def _braces(text: str, language: str) -> list[Chunk]:
    plain = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out: list[Chunk] = []
    stack: list[tuple[int, str, str, str] | None] = []
    last = 0
    for m in re.finditer(r"[{};]", plain):
        if m[0] == "{":
            head = plain[last : m.start()]
            found = None
            if t := list(_TYPE.finditer(head)):
                found = (_KIND.get(t[-1][1], "class"), t[-1][2])
            elif f := list(_FUNCTION.finditer(head)):
                found = ("function", f[-1][1])
            elif (x := _METHOD.search(head.rstrip())) and x[1] not in _NOT_METHODS:
                found = ("method", x[1])
            parent = next((s[2] for s in reversed(stack) if s and s[1] in ("class", "interface", "enum", "abstract")), "")
            if found:
                kind = "method" if found[0] == "function" and parent else found[0]
                stack.append((last + len(head) - len(head.lstrip()), kind, found[1], parent))
            else:
                stack.append(None)
        elif m[0] == "}" and stack:
            if s := stack.pop():
                a, b = text.count("\n", 0, s[0]) + 1, text.count("\n", 0, m.end()) + 1
                out.append(Chunk(text[s[0] : m.end()], a, b, "code", language, [], s[2], s[1], s[3]))
        last = m.end()
    return sorted(out, key=lambda c: (c.start_line, -c.end_line))


def separators(language: str | None) -> list[str]:
    own = languages.STARTS.get(languages.RECURSIVE_NAMES.get((language or "").lower(), ""), [])
    return [*(f"\n{s} " if s[-1].isalnum() else f"\n{s}" for s in own), "\n\n", "\n", " ", ""]


def _split(text: str, seps: list[str], size: int) -> list[str]:
    """Pieces of at most ``size`` that give ``text`` when joined; each starts with the
    separator it was cut at."""
    if len(text) <= size:
        return [text] if text else []
    at = next(k for k, s in enumerate(seps) if s == "" or s in text)
    sep = seps[at]
    if not sep:
        return [text[k : k + size] for k in range(0, len(text), size)]
    parts = text.split(sep)
    out = []
    for k, part in enumerate(parts):
        part = (sep if k else "") + part
        out += [part] if len(part) <= size else _split(part, seps[at + 1 :], size)
    return [p for p in out if p]


def recursive(text: str, language: str | None = None, size: int = 1000, overlap: int = 200) -> list[Chunk]:
    """Text cut at the coarsest separator that helps, then merged up to ``size`` with
    at most ``overlap`` characters shared by neighbours."""
    out: list[Chunk] = []
    pieces = _split(text, separators(language), size)
    held: list[str] = []
    n, begin = 0, 0
    for piece in [*pieces, None]:
        if held and (piece is None or n + len(piece) > size):
            whole = "".join(held)
            content = whole.strip()
            if content:
                first = begin + len(whole) - len(whole.lstrip())
                a = text.count("\n", 0, first) + 1
                out.append(Chunk(content, a, a + content.count("\n"), "code", language or ""))
            while held and (n > overlap or (piece is not None and n + len(piece) > size)):
                n -= len(held[0])
                begin += len(held.pop(0))
        if piece is not None:
            held.append(piece)
            n += len(piece)
    return out


def browser(text: str, size: int = 1000, overlap: int = 200, least: int = 11) -> list[Chunk]:
    """Lines packed up to ``size``; as many lines overlap as ``overlap`` characters
    are at the mean length of the chunk's lines (none if that is less than one).
    Chunks of fewer than ``least`` characters are dropped."""
    lines, out, lo = text.split("\n"), [], 0
    while lo < len(lines):
        hi, n = lo, 0
        while hi < len(lines) and (hi == lo or n + len(lines[hi]) + 1 <= size):
            n += len(lines[hi]) + 1
            hi += 1
        content = "\n".join(lines[lo:hi])
        if len(content.strip()) >= least:
            out.append(Chunk(content, lo + 1, hi, "code"))
        back = min(int(overlap / max(1.0, n / (hi - lo))), hi - lo - 1)
        lo = hi - back if hi < len(lines) else hi
    return out


def refine(chunks: list[Chunk], size: int = 2500) -> list[Chunk]:
    """Chunks longer than ``size`` packed by lines; the parts keep what was known."""
    out = []
    for c in chunks:
        if len(c.content) <= size:
            out.append(c)
            continue
        lines = c.content.split("\n")
        for lo, hi in packed(lines, size):
            part = "\n".join(lines[lo:hi]).strip()
            if part:
                out.append(Chunk(part, c.start_line + lo, c.start_line + hi - 1, c.content_type, c.language, c.heading_path, c.symbol, c.kind, c.parent))
    return out


def _gaps(text: str, chunks: list[Chunk]) -> list[Chunk]:
    """The chunks with the lines between and after the outermost ones."""
    lines, out, at = text.split("\n"), [], 1
    for c in sorted(chunks, key=lambda c: (c.start_line, -c.end_line)):
        if c.start_line > at:
            between = "\n".join(lines[at - 1 : c.start_line - 1])
            if between.strip():
                out.append(Chunk(between, at, c.start_line - 1, "code", c.language))
        out.append(c)
        at = max(at, c.end_line + 1)
    rest = "\n".join(lines[at - 1 :])
    if rest.strip():
        out.append(Chunk(rest, at, len(lines), "code", chunks[0].language if chunks else ""))
    return out


def code(text: str, language: str, size: int = 2500, gaps: bool = False) -> list[Chunk]:
    """Definitions of a file, nested ones by themselves too. Without syntax for the
    language, or where it can't be read, the recursive chunker; a file without a
    definition is one chunk. ``gaps`` also gives the lines outside definitions."""
    lang = (language or "").lower()
    if lang in ("md", "markdown"):
        return markdown(text, size)
    if lang in ("rst", "restructuredtext"):
        return rst(text, size)
    if lang not in languages.SYNTAX_LANGUAGES:
        return recursive(text, language)
    try:
        found = _python(text) if lang in ("py", "python") else _braces(text, lang)
    except (SyntaxError, ValueError, RecursionError):
        return recursive(text, language)
    if not found:
        return refine([Chunk(text, 1, text.count("\n") + 1, "code", lang)], size)
    return refine(_gaps(text, found) if gaps else found, size)
