"""Scalar functions over text, paths, ids and dates, as Column expressions.

White space is the regex class of Java and RE2 (``[ \\t\\n\\r\\f\\v]``) on both sides of
every comparison, and words are ASCII unless a function says otherwise, so that
results don't depend on the engine's Unicode tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[ \t\n\r\f\x0B]"


def trimmed(s: Column) -> Column:
    """Without white space at both ends (tabs and line ends included)."""
    return F.regexp_replace(s, rf"^{_BLANK}+|{_BLANK}+$", "")


def truncated(s: Column, n: int) -> Column:
    """The first ``n`` characters and ``...`` if there were more."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def truncated_lines(s: Column, n: int) -> Column:
    """The first ``n`` lines and a note of how many more there were."""
    lines = F.split(s, "\n", -1)
    more = F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n... "), (F.size(lines) - n).cast("string"), F.lit(" more lines"))
    return F.when(F.size(lines) > n, more).otherwise(s)


def without_slash(s: Column) -> Column:
    """Without one leading slash."""
    return F.regexp_replace(s, "^/", "")


def relative_to(path: Column, root: Column) -> Column:
    """The path below ``root``, or the path itself if it isn't there."""
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(inside, F.substr(path, F.length(root) + 2)).otherwise(path)


def relative_to_first(path: Column, *roots: Column) -> Column:
    """Relative to the first root that covers the path."""
    out = path
    for root in reversed(roots):
        out = F.when(F.startswith(path, F.concat(root, F.lit("/"))), relative_to(path, root)).otherwise(out)
    return out


def is_below(path: Column, root: Column) -> Column:
    """Whether the path is ``root`` or lies below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def embedder_input(s: Column, max_tokens: int) -> Column:
    """A space for an empty text; otherwise at most four characters a token."""
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(" ")).otherwise(F.substring(s, 1, 4 * max_tokens))


def case_segments(s: Column) -> Column:
    """Segments of a camel- or Pascal-case name; runs of capitals stay together."""
    a = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.split(F.regexp_replace(a, "([a-z0-9])([A-Z])", "$1 $2"), " ", -1)


def word_count(s: Column) -> Column:
    """Tokens between white space; 0 for a blank text."""
    t = trimmed(s)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, rf"{_BLANK}+", -1))).cast("long")


def without_call(s: Column) -> Column:
    """Without call parentheses at the end."""
    return F.regexp_replace(s, rf"{_BLANK}*\([^)]*\){_BLANK}*$", "")


def unquoted(s: Column) -> Column:
    """Without one quote mark at each end."""
    return F.regexp_replace(s, "^[\"'`]|[\"'`]$", "")


def line_count(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_of(s: Column, part: Column) -> Column:
    """The 1-based line on which ``part`` first starts; null if it doesn't occur."""
    at = F.instr(s, part)
    return F.when(at > 0, line_count(F.substr(s, F.lit(1), at - 1)))


def token_estimate(s: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.length(s) / 4).cast("long")


def percentage(part: Column, whole: Column) -> Column:
    """Percent with one decimal; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / whole, 1))


def day_bucket(s: Column) -> Column:
    """UTC day of an ISO time given as text; ``unknown-date`` if it is none."""
    fast = F.nullif(F.regexp_extract(s, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T", 1), F.lit(""))
    slow = F.date_format(F.try_to_timestamp(s), "yyyy-MM-dd")
    return F.coalesce(fast, slow, F.lit("unknown-date"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last dot and what follows it in the file name, or nothing; a leading dot
    doesn't start an extension."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)


def package_key(path: Column) -> Column:
    """The folders of a path joined by dots; null for a file at the root."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    folders = F.regexp_replace(p, "/?[^/]*$", "")
    return F.when(folders == "", None).otherwise(F.regexp_replace(folders, "/+", "."))


def chunk_id(path: Column, position: Column) -> Column:
    return F.concat(path, F.lit("_chunk_"), position.cast("string"))


def short_hash(s: Column, n: int = 8) -> Column:
    """The first ``n`` hexadecimal digits of the MD5."""
    return F.substring(F.md5(s), 1, n)


def sparse_map(indices: Column, values: Column) -> Column:
    """A map of the pairs; the shorter array decides how many."""
    n = F.least(F.size(indices), F.size(values))
    return F.map_from_arrays(F.slice(indices, 1, n), F.slice(values, 1, n))


def compact(parts: Column) -> Column:
    """Without null and empty elements."""
    return F.filter(parts, lambda x: x.isNotNull() & (x != ""))


def heading_slug(s: Column) -> Column:
    """Anchor of a heading: lower case, without punctuation, hyphens for spaces."""
    plain = F.regexp_replace(F.lower(s), r"[^a-z0-9 _-]", "")
    return F.regexp_replace(F.trim(plain), " +", "-")


def collection_name(path: Column, domain: Column, split: bool = True) -> Column:
    """Table name of an indexed root: one for both domains, or one for each."""
    h = short_hash(path)
    if not split:
        return F.concat(F.lit("hybrid_v3_code_chunks_"), h)
    return F.concat(F.lit("hybrid_v6_"), domain, F.lit("_"), h)


def domain_of(content_type: Column) -> Column:
    """``prose`` for documentation and its examples, else ``code``."""
    return F.when(content_type.isin("doc", "code_example"), "prose").otherwise("code")


def clamped_bytes(s: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""
    raw = F.encode(s, "UTF-8")
    prefixes = [F.try_validate_utf8(F.substring(raw, 1, max(most - k, 0)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(s) <= most, s).otherwise(F.coalesce(*prefixes))


def clamped_array(items: Column, most: int) -> Column:
    """The longest prefix whose JSON text is within ``most`` bytes."""
    sizes = F.transform(items, lambda x: F.octet_length(x) + 3)
    running = F.aggregate(sizes, F.struct(F.lit(1).alias("sum"), F.lit(0).alias("n")), lambda a, s: F.struct((a["sum"] + s).alias("sum"), (a["n"] + F.when(a["sum"] + s <= most, 1).otherwise(0)).alias("n")), lambda a: a["n"])
    return F.slice(items, 1, running)


def prefixed_id(prefix: str, payload: Column) -> Column:
    """A prefix and a UUID made of the payload, so that a record written again keeps its
    id."""
    h = F.md5(F.concat(F.lit(f"{prefix}:"), payload))
    return F.concat(F.lit(f"{prefix}_"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def progress_percent(phase: Column, done: Column, total: Column) -> Column:
    """0 when an index run is asked for, 5 when its files are listed, then 10 to 100 with
    the files done."""
    part = F.when(total <= 0, F.lit(100)).otherwise(F.least(F.lit(100), 10 + F.floor(90 * done / total)))
    return F.when(phase == "asked", 0).when(phase == "listed", 5).otherwise(part).cast("long")
