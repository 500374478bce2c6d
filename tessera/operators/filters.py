"""Predicates: ignore patterns, a filter language, symbol filters.

Patterns and filter strings are compiled once on the driver to a Column, so what
runs is a plain predicate that Catalyst can push to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import basename

# Extensions and patterns that hold without any setting.
DEFAULT_EXTENSIONS = ".ts .tsx .js .jsx .py .java .cpp .c .h .hpp .cs .go .rs .php .rb .swift .kt .scala .m .mm .md .markdown .ipynb".split()
DEFAULT_IGNORES = "node_modules/** dist/** build/** out/** target/** coverage/** .nyc_output/** .vscode/** .idea/** *.swp *.swo .git/** .svn/** .hg/** .cache/** __pycache__/** .pytest_cache/** logs/** tmp/** temp/** *.log .env .env.* *.local *.min.js *.min.css *.min.map *.bundle.js *.bundle.css *.chunk.js *.vendor.js *.polyfills.js *.runtime.js *.map".split()
SYMBOL_EXTENSIONS = ".hx .ts .tsx .js .jsx .py .java .cs .go .rs .rb .swift .kt .scala .cpp .c .h .hpp .dart .php".split()


def glob_regex(pattern: str) -> str:
    """``*`` stands for any characters, slashes too; everything else for itself."""
    return "".join(".*" if c == "*" else re.escape(c) for c in pattern)


def ignore_regex(pattern: str) -> str:
    """A pattern as a regex over a path or one of its folders.

    A slash at the end asks for a folder, at any depth unless the pattern starts
    with one; a slash at the start ties it to the root; a pattern with a slash meets
    the whole path, any other the last name of the path or of a folder above it."""
    pattern = pattern.strip()
    rooted, folder = pattern.startswith("/"), pattern.endswith("/")
    body = glob_regex(pattern.strip("/"))
    if folder:
        return f"^(?:{body})(?:/|$)" if rooted else f"(?:^|/)(?:{body})(?:/|$)"
    if rooted or "/" in pattern.strip("/"):
        return f"^(?:{body})(?:/|$)"
    return f"(?:^|/)(?:{body.replace('.*', '[^/]*')})(?:/|$)"


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Hidden segments, and paths that a pattern meets or that lie below one."""
    out = path.rlike(r"(?:^|/)\.")
    for p in patterns:
        if p.strip() and not p.lstrip().startswith("#"):
            out = out | path.rlike(ignore_regex(p))
    return out


def effective(path: Column, extensions: Sequence[Iterable[str]] = (), ignores: Sequence[Iterable[str]] = ()) -> Column:
    """Files of all extension sources without those of all ignore sources; the
    defaults always count, and nothing is kept between calls."""
    wanted = {*DEFAULT_EXTENSIONS, *(x for s in extensions for x in s)}
    unwanted = dict.fromkeys([*DEFAULT_IGNORES, *(x for s in ignores for x in s)])
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1).isin(*sorted(wanted)) & ~ignored(path, unwanted)


def valid_extensions(values: Iterable[str]) -> list[str]:
    """Trimmed extensions; one without a dot or with white space is an error."""
    out = [v.strip() for v in values if v.strip()]
    for v in out:
        if not v.startswith(".") or re.search(r"\s", v):
            raise ValueError(f"not an extension: {v!r}")
    return out


def with_extensions(column: Column, values: Iterable[str] | None) -> Column:
    own = valid_extensions(values or [])
    return column.isin(*own) if own else F.lit(True)


def in_categories(path: Column, categories: Iterable[str] | None) -> Column:
    """Paths below any of the categories. The name is literal (an underscore is no
    wildcard), and the test reaches the scan as a prefix test."""
    own = list(dict.fromkeys(c.strip().strip("/") for c in categories or [] if c.strip().strip("/")))
    for c in own:
        if not re.fullmatch(r"[A-Za-z0-9._/-]+", c):
            raise ValueError(f"not a category: {c!r}")
    out = F.lit(not own)
    for c in own:
        out = out | F.startswith(path, F.lit(c + "/"))
    return out


def safe_id(column: Column) -> Column:
    return column.rlike("^[A-Za-z0-9_-]+$")


def escaped(value: str) -> str:
    """A value as it stands within double quotes in the filter language."""
    return value.replace("\\", "\\\\").replace('"', '\\"')


_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<op>==|!=|<=|>=|<|>|\(|\)|\[|\]|,)|(?P<word>[A-Za-z_][A-Za-z0-9_]*))""")


def compiled(filter_text: str) -> Column:
    """A filter string as a Column: ``==``, ``!=``, ``<`` and so on, ``in [..]``,
    ``like`` with ``%``, ``and``, ``or``, ``not`` and parentheses. A blank filter
    lets every row through."""
    tokens, at = [], 0
    text = filter_text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at : at + 10]!r} in the filter")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek() -> tuple[str, str]:
        return tokens[place]

    def take(*wanted: str) -> tuple[str, str]:
        nonlocal place
        token = tokens[place]
        if wanted and token[1].lower() not in wanted:
            raise ValueError(f"expected {' or '.join(wanted)}, found {token[1]!r}")
        place += 1
        return token

    def value():
        kind, raw = take()
        if kind == "text":
            return re.sub(r"\\(.)", r"\1", raw[1:-1])
        if kind == "number":
            return float(raw) if "." in raw else int(raw)
        raise ValueError(f"expected a value, found {raw!r}")

    def comparison() -> Column:
        if peek()[1] == "(":
            take("(")
            out = either()
            take(")")
            return out
        if peek()[1].lower() == "not":
            take("not")
            return ~comparison()
        kind, name = take()
        if kind != "word":
            raise ValueError(f"expected a column, found {name!r}")
        column, op = F.col(name), take()[1].lower()
        if op == "in":
            take("[")
            items = []
            while peek()[1] != "]":
                items.append(value())
                if peek()[1] == ",":
                    take(",")
            take("]")
            return column.isin(*items) if items else F.lit(False)
        if op == "like":
            return column.rlike("^" + "".join(".*" if c == "%" else re.escape(c) for c in value()) + "$")
        other = F.lit(value())
        table = {"==": column == other, "!=": column != other, "<=": column <= other, ">=": column >= other, "<": column < other, ">": column > other}
        if op not in table:
            raise ValueError(f"unknown comparison {op!r}")
        return table[op]

    def both() -> Column:
        out = comparison()
        while peek()[1].lower() == "and":
            take("and")
            out = out & comparison()
        return out

    def either() -> Column:
        out = both()
        while peek()[1].lower() == "or":
            take("or")
            out = out | both()
        return out

    if peek()[0] == "end":
        return F.lit(True)
    out = either()
    take("")
    return out


def symbol_filter(class_name: Column, method_name: Column, symbol: Column, parent: Column, path: Column, class_known: Column, method_known: Column) -> Column:
    """Rows that a qualified name may mean: never if the class is unknown; the exact
    method within the class or a file named after the class if the method is known;
    only the file otherwise."""
    named = F.regexp_extract(basename(path), r"^(.*?)(?:\.[^.]*)$", 1) == class_name
    listed = F.regexp_extract(basename(path), r"(\.[^.]*)$", 1).isin(*SYMBOL_EXTENSIONS)
    exact = (symbol == method_name) & (parent == class_name)
    by_file = F.when(method_known, named & listed & (symbol == method_name)).otherwise(named & listed)
    return F.coalesce(class_known & (F.when(method_known, exact).otherwise(False) | by_file), F.lit(False))


def is_test_file(path: Column) -> Column:
    """Whether a word of the path says that it is a test."""
    return F.arrays_overlap(F.split(F.lower(path), "[ _/.]"), F.array(*map(F.lit, ("test", "tests", "testing"))))
