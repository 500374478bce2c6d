"""Query understanding: intent, lexical form, comparisons, names, rewriting.

Everything is a Column expression over the text of a query, so a batch of queries
is classified in one projection. Word borders are written as lookarounds over ASCII
word characters, because ``\\b`` of Java also sees letters beyond ASCII as words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import trimmed, word_count

L, R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Shapes that mark code in a query.
CAMEL = rf"{L}[a-z]+[A-Z][a-zA-Z0-9]*{R}"
PASCAL = rf"{L}[A-Z][a-z]+[A-Z][a-zA-Z0-9]*{R}"
SNAKE = rf"{L}[a-z][a-z0-9]*_[a-z0-9_]+{R}"
QUALIFIED = rf"{L}[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+{R}"
CODE_SHAPES = {
    "camel": CAMEL,
    "pascal": PASCAL,
    "snake": SNAKE,
    "qualified": QUALIFIED,
    "metadata": r"@:[A-Za-z_][A-Za-z0-9_]*",
    "decorator": r"(?:^|\s)@[A-Za-z_][A-Za-z0-9_]*",
    "call": r"[A-Za-z_][A-Za-z0-9_]*\s*\(",
    "punctuation": r"::|->|=>|<<|>>|\+\+|--|&&|\|\|",
    "sigil": r"(?:^|\s)[A-Z][a-zA-Z0-9_]*<[^>]+>",
    "type_parameter": r"[A-Za-z_][A-Za-z0-9_]*<[A-Z][A-Za-z0-9_,\s]*>",
}

# What makes a query a comparison.
COMPARISONS = {
    "vs": rf"(?i){L}vs(?:\.(?=[A-Za-z0-9_])|{R})",
    "versus": rf"(?i){L}versus{R}",
    "compared": rf"(?i){L}compared to{R}",
    "difference": rf"(?i){L}difference between{R}",
    "compare": rf"(?i){L}compare\s+[A-Za-z0-9_]+\s+(?:and|to){R}",
}

# Triggers that a comparison is split at, in the order they are tried.
SPLITS = [
    rf"(?is)^(.*?){L}vs{R}(.*)$",
    rf"(?is)^(.*?){L}versus{R}(.*)$",
    rf"(?is)^(.*?){L}compared\s+to{R}(.*)$",
    rf"(?i){L}difference\s+between\s+(.+?)\s+and\s+(.+)",
    r"(?isu)^(.*?)(?:^|\s)против(?:\s|$)(.*)$",
    r"(?iu)разница\s+между\s+(.+?)\s+и\s+(.+)",
    r"(?iu)чем\s+(.+?)\s+отличается\s+от\s+(.+)",
    r"(?iu)отличие\s+(.+?)\s+от\s+(.+)",
    rf"(?i){L}(?:compare|comparing){R}\s+(.+?)\s+(?:and|with|to)\s+(.+)",
]
MOST_SIDE_WORDS = 6

# Abbreviations and their long forms.
ABBREVIATIONS = {
    "cfg": ["config", "configuration"],
    "auth": ["authentication"],
    "db": ["database"],
    "lib": ["library"],
    "repo": ["repository"],
    "init": ["initialize", "initializer"],
    "impl": ["implementation"],
}

# Pool weights by intent, and channel weights by lexical form.
INTENT_WEIGHTS = {"code": (1.5, 1.0), "doc": (1.0, 1.3), "mixed": (1.0, 1.0)}
CHANNEL_WEIGHTS = {"identifier": (0.6, 0.8, 1.0), "descriptive": (1.0, 0.5, 0.3), "mixed": (1.0, 0.6, 0.4)}
SHAPES = ("single", "comparison", "concept", "howto")


def code_shapes(q: Column) -> dict[str, Column]:
    """One flag for each code shape."""
    return {k: q.rlike(p) for k, p in CODE_SHAPES.items()}


def code_signal(q: Column) -> Column:
    t, out = trimmed(q), F.lit(False)
    for p in CODE_SHAPES.values():
        out = out | t.rlike(p)
    return F.coalesce(out, F.lit(False))


def plain_words(q: Column) -> Column:
    """Words of three letters or more that aren't shaped like names. In a query of
    at most two such words a capitalised one counts as a name."""
    words = F.regexp_extract_all(q, F.lit(rf"{L}[A-Za-z]{{3,}}{R}"), F.lit(0))
    name = lambda w: w.rlike(CAMEL) | w.rlike(PASCAL)
    kept = F.filter(words, lambda w: ~name(w) & ~(w.rlike("^[A-Z]") & (F.size(words) <= 2)))
    return F.coalesce(F.size(kept), F.lit(0)).cast("long")


def doc_signal(q: Column) -> Column:
    return plain_words(trimmed(q)) >= 3


def lexical_form(q: Column) -> Column:
    """``identifier``, ``descriptive`` or ``mixed``."""
    t = trimmed(F.coalesce(q, F.lit("")))
    code = t.rlike(CAMEL) | t.rlike(PASCAL) | t.rlike(SNAKE) | t.rlike(QUALIFIED)
    words = plain_words(F.regexp_replace(t, QUALIFIED, " "))
    return F.when(code & (words < 3), "identifier").when(~code & (words >= 3), "descriptive").otherwise("mixed")


def intent(q: Column) -> Column:
    return F.when(code_signal(q) & ~doc_signal(q), "code").when(~code_signal(q) & doc_signal(q), "doc").otherwise("mixed")


def _pick(key: Column, table: dict[str, tuple], at: int) -> Column:
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v[at])))]), key)


def intent_weights(name: Column, table: dict[str, tuple] | None = None) -> tuple[Column, Column]:
    """Weights of the code and the prose pool. A weight of ``table`` that is
    negative or no number falls back to the default."""
    good = lambda x, d: x if isinstance(x, (int, float)) and 0 <= x < float("inf") else d
    own = {k: tuple(good(x, d) for x, d in zip((table or {}).get(k, v), v, strict=True)) for k, v in INTENT_WEIGHTS.items()}
    return _pick(name, own, 0), _pick(name, own, 1)


def channel_weights(form: Column) -> tuple[Column, Column, Column]:
    """Weights of the dense, learned-sparse and keyword channels."""
    return tuple(_pick(form, CHANNEL_WEIGHTS, k) for k in range(3))


def is_comparison(q: Column) -> Column:
    out = F.lit(False)
    for p in COMPARISONS.values():
        out = out | q.rlike(p)
    return F.coalesce(out, F.lit(False))


def comparison_sides(q: Column) -> Column:
    """``struct<left,right>`` of a comparison, or null: the first trigger whose both
    sides have one to six words."""
    pairs = F.array(*(F.struct(F.regexp_extract(q, p, 1).alias("left"), F.regexp_extract(q, p, 2).alias("right")) for p in SPLITS))
    pairs = F.transform(pairs, lambda s: F.struct(trimmed(s["left"]).alias("left"), trimmed(s["right"]).alias("right")))
    fits = lambda s: word_count(s).between(1, MOST_SIDE_WORDS)
    return F.get(F.filter(pairs, lambda s: fits(s["left"]) & fits(s["right"])), F.lit(0))


def shape(q: Column, hint: Column | None = None) -> Column:
    """A valid hint, else ``comparison`` or ``single``."""
    own = F.when(is_comparison(q), "comparison").otherwise("single")
    return own if hint is None else F.coalesce(F.when(hint.isin(*SHAPES), hint), own)


_PART = "[A-Za-z_][A-Za-z0-9_]*"


def qualified_name(q: Column) -> Column:
    """``struct<class_name,method_name>`` of a query that is one qualified name with
    one kind of separator, or null."""

    def named(t: Column) -> Column:
        whole = F.lit(False)
        for sep in (r"\.", "::", "/"):
            whole = whole | t.rlike(f"^{_PART}(?:{sep}{_PART})+$")
        parts = F.split(t, r"\.|::|/", -1)
        return F.when(whole, F.struct(F.get(parts, F.size(parts) - 2).alias("class_name"), F.get(parts, F.size(parts) - 1).alias("method_name")))

    return F.get(F.transform(F.array(trimmed(q)), named), F.lit(0))


def code_tokens(q: Column) -> Column:
    """Words of letters, digits and underscores of any script."""
    return F.regexp_extract_all(q, F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0))


# Name styles, as whole words.
_STYLES = {
    "camel": "^[a-z]+(?:[A-Z][a-zA-Z0-9]*)+$",
    "pascal": "^[A-Z][a-z]+(?:[A-Z][a-zA-Z0-9]*)+$",
    "snake": "^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$",
    "kebab": "^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$",
}


def case_variants(name: Column) -> Column:
    """The other styles of a name in the order snake, kebab, camel, Pascal; empty
    for a word without a style."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.split(F.lower(F.regexp_replace(spaced, "[_-]", " ")), " ", -1)
    title = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    pascal = F.array_join(title, "")
    made = F.array(F.array_join(parts, "_"), F.array_join(parts, "-"), F.concat(F.get(parts, F.lit(0)), F.array_join(F.slice(title, 2, F.greatest(F.size(title) - 1, F.lit(0))), "")), pascal)
    styled = F.lit(False)
    for p in _STYLES.values():
        styled = styled | name.rlike(p)
    return F.when(styled, F.array_distinct(F.filter(made, lambda v: v != name))).otherwise(F.array().cast("array<string>"))


def abbreviation_forms(q: Column) -> Column:
    """Long forms of the abbreviations in a query that it doesn't hold already, in
    the order of the words."""
    words = F.transform(F.regexp_extract_all(q, F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0)), F.lower)
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    forms = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))
    low = F.lower(q)
    present = lambda f: F.regexp_like(low, F.concat(F.lit(L), f, F.lit(R)))
    return F.array_distinct(F.filter(forms, lambda f: ~present(f)))


def sparse_extras(q: Column) -> Column:
    """Words that rewriting adds to the keyword channel: case variants of the named
    words, then long forms."""
    words = F.regexp_extract_all(q, F.lit(r"[A-Za-z][A-Za-z0-9_-]*"), F.lit(0))
    variants = F.flatten(F.transform(words, case_variants))
    return F.array_distinct(F.concat(variants, abbreviation_forms(q)))
