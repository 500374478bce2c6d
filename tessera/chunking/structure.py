"""Imports and class heritage of source files."""

from __future__ import annotations

import ast
import re

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def python_imports(text: str) -> list[str]:
    """``import a, b.c`` gives the modules; ``from m import x`` gives ``m.x``, relative
    modules with their dots. Each once, in order; none if the file can't be read."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            out += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            out += [base if a.name == "*" else f"{base}{'' if base.endswith('.') else '.'}{a.name}" for a in node.names]
    return list(dict.fromkeys(out))


def type_name(text: str) -> str | None:
    """The last part of a dotted type without its type arguments; null for anything
    that isn't one name."""
    out, deep = [], 0
    for c in text.strip():
        if c == "<":
            deep += 1
        elif c == ">":
            deep -= 1
            if deep < 0:
                return None
        elif not deep:
            if c.isspace():
                return None
            out.append(c)
    name = "".join(out).split(".")[-1]
    return name if not deep and _IDENT.match(name) else None


_CLASS = re.compile(r"(?m)^[ \t]*(?:[a-z@]\w*[ \t]+)*(?:class|interface)[ \t]+([A-Za-z_]\w*)(?:<[^{]*?>)?([^{;]*)")
_ABSTRACT = re.compile(r"(?m)^[ \t]*(?:[a-z@]\w*[ \t]+)*abstract[ \t]+([A-Za-z_]\w*)(?:<[^{(]*?>)?[ \t]*\(([^)]*)\)([^{]*)")
_TYPEDEF = re.compile(r"(?m)^[ \t]*(?:[a-z@]\w*[ \t]+)*typedef[ \t]+([A-Za-z_]\w*)(?:<[^=]*?>)?[ \t]*=[ \t]*([A-Za-z_][\w.]*(?:<[^;\n]*>)?)[ \t]*;?[ \t]*$")


def _listed(text: str) -> list[str]:
    parts, deep, last = [], 0, 0
    for k, c in enumerate(text):
        deep += (c == "<") - (c == ">")
        if c == "," and not deep:
            parts.append(text[last:k])
            last = k + 1
    names = (type_name(p) for p in [*parts, text[last:]])
    return [n for n in names if n]


def heritage(text: str, language: str) -> list[tuple[str, str | None, list[str]]]:
    """``(class, base, interfaces)`` of each class of a file."""
    if language in ("python", "py"):
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        return [(n.name, type_name(ast.unparse(n.bases[0])) if n.bases else None, []) for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
    out = []
    for m in _CLASS.finditer(text):
        tail = re.sub(r"\s+", " ", m[2])
        base = re.search(r"\bextends ((?:(?!\bimplements\b).)+)", tail)
        own = re.findall(r"\bimplements ((?:(?!\bimplements\b|\bextends\b).)+)", tail)
        bases = _listed(base[1]) if base else []
        out.append((m[1], bases[0] if bases else None, [n for x in own for n in _listed(x)]))
    return out


def abstracts(text: str) -> list[tuple[str, list[str]]]:
    """``(abstract, related types)``: the underlying type, then ``from`` and ``to``."""
    out = []
    for m in _ABSTRACT.finditer(text):
        related = [m[2], *re.findall(r"\b(?:from|to)\s+([A-Za-z_][\w.]*(?:<[^{]*?>)?)", m[3])]
        out.append((m[1], list(dict.fromkeys(n for n in map(type_name, related) if n))))
    return out


def aliases(text: str) -> list[tuple[str, str]]:
    """``(alias, type)`` of type definitions that name another type."""
    return [(m[1], n) for m in _TYPEDEF.finditer(text) if (n := type_name(m[2]))]
