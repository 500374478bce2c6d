"""Symbols and structure in text: mentions, definitions, imports, heritage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.query_text import L, QUALIFIED, R
from tessera.functions.text import trimmed, without_call

# Words that are never a symbol.
STOP_WORDS = (
    "true false null none undefined self this super class function def fn interface enum typedef abstract return import from as if else for "
    "while try catch throw new delete const let var public private protected static async await "
    "type and module val struct trait impl union mod func fun proc method protocol record namespace package rec mutable inline open include in of with where"
).split()

# Keywords before a defined name, and type definitions of the ML family.
DEFINITION = rf"{L}(?:class|function|func|proc|method|protocol|def|fn|interface|enum|typedef|abstract|type|module|val|struct|trait|impl|union|mod|record|namespace|package)\s+([A-Za-z_][A-Za-z0-9_]*)"
ML_TYPE = rf"{L}(?:type|and)\s+([A-Za-z_][A-Za-z0-9_]*)\s*="
CODE_SPAN = r"`([^`\n]{1,120})`"
_NAME = r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*$"


def is_symbol(token: Column) -> Column:
    """Whether a token is a plain or dotted name of two characters or more that
    isn't a stop word."""
    return token.rlike(_NAME) & (F.length(token) >= 2) & ~F.lower(token).isin(*STOP_WORDS)


def mentioned_symbols(text: Column) -> Column:
    """Qualified names, then names in code spans, each once, as first seen."""
    names = F.regexp_extract_all(text, F.lit(QUALIFIED), F.lit(0))
    spans = F.transform(F.regexp_extract_all(text, F.lit(CODE_SPAN), F.lit(1)), lambda s: without_call(trimmed(s)))
    return F.array_distinct(F.filter(F.concat(names, spans), is_symbol))


def in_vocabulary(name: Column, vocabulary: Column) -> Column:
    """Whether a name, or a part of a dotted name, is in the vocabulary array."""
    return F.array_contains(vocabulary, name) | F.arrays_overlap(F.split(name, r"\."), vocabulary)


def defined_names(code: Column) -> Column:
    """Names after definition keywords, then names of type definitions."""
    a = F.regexp_extract_all(code, F.lit(DEFINITION), F.lit(1))
    b = F.regexp_extract_all(code, F.lit(ML_TYPE), F.lit(1))
    return F.array_distinct(F.filter(F.concat(a, b), is_symbol))


# Patterns of import lines by language; group 1 is the module.
IMPORTS = {
    "javascript": r"""(?m)^import\s+(?:[^'"\n;]*?\sfrom\s+)?['"]([^'"\s]+)['"]""",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z_][A-Za-z0-9_.]*(?:\.\*)?)\s*;",
    "haxe": r"(?m)^\s*(?:import|using)\s+([A-Za-z_][A-Za-z0-9_.]*(?:\.\*)?)",
}
_IMPORT_LANGUAGE = {"javascript": "javascript", "js": "javascript", "typescript": "javascript", "ts": "javascript", "java": "java", "haxe": "haxe", "hx": "haxe"}


def imports(code: Column, language: Column) -> Column:
    """Modules that a file imports, each once, in order; none for other languages.
    Python files are read by ``chunking.structure``."""
    out = F.array().cast("array<string>")
    for name, kind in _IMPORT_LANGUAGE.items():
        found = F.array_distinct(F.filter(F.regexp_extract_all(code, F.lit(IMPORTS[kind]), F.lit(1)), lambda m: ~m.rlike(r"\s")))
        out = F.when(language == name, found).otherwise(out)
    return out


def patch_files(patch: Column) -> Column:
    """Files that a unified diff changes, each once."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^--- a/(.+)$"), F.lit(1)))


__all__ = ["CODE_SPAN", "DEFINITION", "IMPORTS", "L", "ML_TYPE", "R", "STOP_WORDS", "defined_names", "imports", "in_vocabulary", "is_symbol", "mentioned_symbols", "patch_files"]
