"""Sections and examples of Markdown and reStructuredText files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.chunking.refine import packed

_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})\s*([^\s`]*)")
_ATX = re.compile(r"^\s{0,3}(#{1,3})\s+(.*?)\s*#*\s*$")
_SETEXT = re.compile(r"^\s{0,3}(=+|-+)\s*$")
_RULE = re.compile(r"^([!-/:-@\[-`{-~])\1{2,}\s*$")
_DIRECTIVE = re.compile(r"^(\s*)\.\.\s+(?:code-block|sourcecode|code)::\s*(\S*)\s*$")


@dataclass
class Chunk:
    """Lines ``start_line`` to ``end_line`` (1-based) of a file."""

    content: str
    start_line: int
    end_line: int
    content_type: str = "doc"
    language: str = ""
    heading_path: list[str] = field(default_factory=list)
    symbol: str = ""
    kind: str = ""
    parent: str = ""


class _Sections:
    """Collects the lines of the section that is open."""

    def __init__(self, size: int):
        self.size, self.path, self.out, self.lines, self.first = size, [], [], [], 1

    def line(self, text: str, number: int) -> None:
        if not self.lines:
            self.first = number
        self.lines.append(text)

    def close(self) -> None:
        if any(x.strip() for x in self.lines):
            for lo, hi in packed(self.lines, self.size):
                part = "\n".join(self.lines[lo:hi])
                if part.strip():
                    self.out.append(Chunk(part, self.first + lo, self.first + hi - 1, "doc", "", [p for p in self.path if p]))
        self.lines = []

    def heading(self, level: int, title: str) -> None:
        self.path = (self.path + [""] * level)[: level - 1] + [title]

    def example(self, lines: list[str], first: int, language: str) -> None:
        for lo, hi in packed(lines, self.size):
            self.out.append(Chunk("\n".join(lines[lo:hi]), first + lo, first + hi - 1, "code_example", language, [p for p in self.path if p]))


def _whole(text: str, lines: list[str]) -> list[Chunk]:
    return [Chunk(text, 1, len(lines))]


def markdown(text: str, size: int = 2500) -> list[Chunk]:
    """Sections of the first three heading levels (marked or underlined); fenced
    blocks are examples in the language of their info string, an unclosed one too.
    A file without either is one chunk."""
    lines, s = text.split("\n"), _Sections(size)
    k = 0
    while k < len(lines):
        line = lines[k]
        if m := _FENCE.match(line):
            s.close()
            end = next((j for j in range(k + 1, len(lines)) if lines[j].lstrip().startswith(m[1])), len(lines))
            s.example(lines[k + 1 : end] or [""], k + 2, m[2])
            k = end + 1
            continue
        if m := _ATX.match(line):
            s.close()
            s.heading(len(m[1]), m[2])
        elif k + 1 < len(lines) and line.strip() and (m := _SETEXT.match(lines[k + 1])):
            s.close()
            s.heading(1 if m[1][0] == "=" else 2, line.strip())
            s.line(line, k + 1)
            k += 1
            line = lines[k]
        s.line(line, k + 1)
        k += 1
    s.close()
    return s.out or _whole(text, lines)


def rst(text: str, size: int = 2500) -> list[Chunk]:
    """Sections whose level is the order in which their underline marks first occur;
    the indented bodies of code directives are examples."""
    lines, s, marks = text.split("\n"), _Sections(size), []
    k = 0
    while k < len(lines):
        line = lines[k]
        if m := _DIRECTIVE.match(line):
            s.close()
            deep, j = len(m[1]), k + 1
            while j < len(lines) and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip()) > deep):
                j += 1
            body = list(range(k + 1, j))
            while body and (not lines[body[0]].strip() or re.match(r"\s*:\w[\w-]*:", lines[body[0]])):
                body.pop(0)
            while body and not lines[body[-1]].strip():
                body.pop()
            if body:
                own = [lines[i] for i in body]
                cut = min(len(x) - len(x.lstrip()) for x in own if x.strip())
                s.example([x[cut:] for x in own], body[0] + 1, m[2])
            k = j
            continue
        if k + 1 < len(lines) and line.strip() and not _RULE.match(line) and (m := _RULE.match(lines[k + 1])) and len(lines[k + 1].rstrip()) >= len(line.rstrip()):
            s.close()
            if m[1] not in marks:
                marks.append(m[1])
            s.heading(marks.index(m[1]) + 1, line.strip())
            s.line(line, k + 1)
            k += 1
            line = lines[k]
        s.line(line, k + 1)
        k += 1
    s.close()
    return s.out or _whole(text, lines)
