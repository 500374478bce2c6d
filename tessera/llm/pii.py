"""Information-theoretic sanitisation with DataFrame functions only.

Base spans are the matches of four patterns (leftmost, non-overlapping for each
kind, failing matches dropped). They are the protected entities. The corpus then
tells how strongly a term reveals one of them, and also the broader class that its
value belongs to (the domain of an address, the first half of an IP, the issuer of a
card, the first digits of a number), so that rare values don't silence the estimate:
with document frequencies over all documents, ``PMI(term, entity) / IC(entity)`` is 1
where the term never occurs without the entity and 0 where the two are independent.
A term near an entity (``window`` words to either side) whose share passes
``generalise`` is replaced in the documents that hold the entity by the class of its
shape (``[NAME]``, ``[CODE]``, ``[WORD]``), which many more terms share. That holds
for a rare name beside one number as well: it points to that document and thereby to
the number. A term is removed from ``remove`` on, where at least ``least_texts``
different texts show it; one text may be chance, and exact copies are one text. As
that number is one of its own, copies added to the corpus never cancel what other
documents show.

The patterns are written so that Java's engine neither backtracks nor recurses
(possessive loops, starts only where a run starts), which keeps them linear in
the length of the text; positions come from the lengths of the pieces between the
matches, summed in blocks. They count code points.

Null texts count as empty and have no span. Rows with a null id get base spans only.
Repeated rows each get the same result; where rows share an id but not the text, each
is judged by the entities of its own text. Of terms with several entities the strongest
one decides. Texts of any length are read whole. An empty table gives no rows.
Columns that are added for the work start with ``__`` and are dropped again.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
_GUARD = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){15}", "phone": r"\+[0-9]"}
_TERM = r"\p{L}(?:[\p{L}\p{N}_'’-]*+)"
#: Matches that are summed at once, so that a text with many stays linear.
_BLOCK = 256


@dataclass(frozen=True)
class Disclosure:
    """Limits of the disclosure rule."""

    window: int = 8
    reach: int = 240
    remove: float = 0.95
    generalise: float = 0.85
    least_texts: int = 3
    least_letters: int = 3


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.size(F.filter(F.split(value, r"\."), lambda p: ~F.regexp_replace(p, r"^0+", "").rlike(r"^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?$"))) == 0
    if kind == "phone":
        return F.length(digits).between(8, 15)
    back = F.reverse(F.split(F.when(F.length(digits).between(16, 19), digits).otherwise("1"), ""))
    twice = F.transform(back, lambda d, k: F.when(k % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.length(digits).between(16, 19) & (F.aggregate(twice, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0)


def _located(text: Column, pattern: str, guard: str | None, keep) -> Column:
    """``array<struct<start,end,value>>`` of the matches that ``keep`` accepts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    each = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("len"), m.alias("value")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / _BLOCK).cast("int")), lambda b: F.slice(each, b * _BLOCK + 1, _BLOCK))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, e: a + e["gap"] + e["len"]))
    at = F.aggregate(
        sums,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )
    kind = "array<struct<start:int,end:int,value:string>>"
    # Only what is kept is appended: the arrays stay short where many matches aren't.
    one = lambda a, e: F.array(F.struct((a["at"] + e["gap"]).alias("start"), (a["at"] + e["gap"] + e["len"]).alias("end"), e["value"].alias("value")))
    inside = lambda x, base: F.aggregate(
        x,
        F.struct(base.alias("at"), F.array().cast(kind).alias("out")),
        lambda a, e: F.struct((a["at"] + e["gap"] + e["len"]).alias("at"), F.when(keep(e), F.concat(a["out"], one(a, e))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )
    out = F.flatten(F.zip_with(blocks, at, inside))
    some = text.rlike(guard) if guard else F.lit(True)
    return F.when(some & (F.regexp_count(text, F.lit(pattern)) > 0), out).otherwise(F.array().cast(kind))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind as ``array<struct<start,end,value>>``."""
    text = F.coalesce(text, F.lit(""))
    keep = lambda k: lambda m: _valid(k, m["value"])
    return {k: _located(text, _PATTERN[k], _GUARD[k], keep(k)) for k in KINDS}


def _said(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _terms(part: Column) -> Column:
    return F.regexp_extract_all(F.lower(part), F.lit(_TERM), F.lit(0))


def _terms_of(sql: str) -> str:
    return f'regexp_extract_all(lower({sql}), r"{_TERM}", 0)'


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


#: SQL for the broader class of a value, by kind.
_BROADER = {
    "email": "substring_index(lower(s.value), '@', -1)",
    "ip": "substring_index(s.value, '.', 2)",
    "card": "substring(regexp_replace(s.value, '[^0-9]', ''), 1, 6)",
    "phone": "substring(regexp_replace(s.value, '[^0-9]', ''), 1, 4)",
}


def scanned(df: DataFrame, rules: Disclosure, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, th, held, text, email, ip, card, phone)`` of each row, written once: the
    base spans, each with its entity, the entity's class and the terms around it.
    Only rows that hold a span carry their text, so the later steps move no other."""
    text = F.coalesce(F.col(_name(text_col)), F.lit(""))
    found = df.select(F.col(_name(id_col)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    for k, v in base_spans(F.col("text")).items():
        found = found.withColumn(f"found_{k}", v)

    def around(kind: str) -> Column:
        left = _terms_of(f"substring(text, greatest(s.start - {rules.reach}, 0) + 1, s.start - greatest(s.start - {rules.reach}, 0))")
        right = _terms_of(f"substring(text, s.end + 1, {rules.reach})")
        return F.expr(f"""transform(found_{kind}, s -> named_struct('start', s.start, 'end', s.end, 'entities', array(concat('{kind}:', lower(s.value)), concat('{kind} of ', {_BROADER[kind]})), 'l', {left}, 'r', {right}))""")

    cut = lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["entities"].alias("entities"),
        F.array_distinct(F.concat(F.slice(F.reverse(s["l"]), 1, rules.window), F.slice(s["r"], 1, rules.window))).alias("terms"),
    )
    held = sum((F.size(f"found_{k}") for k in KINDS), F.lit(0)) > 0
    return staged(found.select("doc", "th", held.alias("held"), F.when(held, F.col("text")).alias("text"), *(F.transform(around(k), cut).alias(k) for k in KINDS)), "pii-spans")


def disclosing_terms(df: DataFrame, scan: DataFrame, rules: Disclosure, text_col: str = "text") -> DataFrame:
    """``(entity, term, texts, share)`` of the pairs beyond ``rules.generalise``.

    Texts without an entity only add to the document frequencies. Counts are
    combined before each shuffle, so a common entity or term is a few rows there."""
    hits = scan.where(F.col("doc").isNotNull()).select("doc", "th", F.explode(F.concat(*KINDS)).alias("s"))
    near = hits.select("doc", "th", "s.terms", F.explode("s.entities").alias("entity")).select("doc", "th", "entity", F.explode("terms").alias("term")).where(F.length("term") >= rules.least_letters)
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("doc").alias("n_te"), F.count_distinct("th").alias("texts"))
    entities = near.groupBy("entity").agg(F.count_distinct("doc").alias("n_e"))
    # The documents with the term near any entity bound its frequency from below;
    # a pair that can't pass with this bound needs no count over the corpus.
    about = near.groupBy("term").agg(F.count_distinct("doc").alias("n_near"))
    n = df.count()
    most = F.col("n_te") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1 - rules.generalise)) * 1.000001
    pairs = staged(pairs.join(entities, "entity").where(F.col("n_e") < n).join(about, "term").where(F.col("n_near") <= most).drop("n_near"), "pii-pairs")
    words = df.select(F.explode(F.array_distinct(_terms(F.coalesce(F.col(_name(text_col)), F.lit(""))))).alias("term"))
    # Counted before the join: each task sends a term once, however common it is.
    freq = words.groupBy("term").agg(F.count("*").alias("n_t"))
    share = F.log2(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log2(n / F.col("n_e"))
    return pairs.join(freq, "term").select("entity", "term", "texts", share.alias("share")).where(F.col("share") >= rules.generalise)


def term_spans(df: DataFrame, scan: DataFrame, rules: Disclosure, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, th, terms)``: spans of the disclosing terms in the rows that hold
    their entity. Rows meet their terms by a merge at every size, and only rows with
    a base span take part, so no other text is shuffled."""
    found = staged(disclosing_terms(df, scan, rules, text_col), "pii-terms")
    rows = scan.where(F.col("held") & F.col("doc").isNotNull())
    holds = rows.select("doc", "th", F.explode(F.concat(*KINDS)).alias("s")).select("doc", "th", F.explode("s.entities").alias("entity")).distinct()
    gone = (F.col("share") >= rules.remove) & (F.col("texts") >= rules.least_texts)
    own = holds.join(found, "entity").groupBy("doc", "th", "term").agg(F.max(gone).alias("gone")).groupBy("doc", "th").agg(F.map_from_entries(F.collect_list(F.struct("term", "gone"))).alias("own"))
    # A given number of partitions isn't merged: the work here is on words, not bytes.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("doc", "th", "text").repartition(parts, "doc", "th").join(own.hint("merge"), ["doc", "th"])
    hit = _located(F.col("text"), rf"(?iu){_TERM}", None, lambda m: F.map_contains_key(F.col("own"), F.lower(m["value"])))
    shape = lambda s: F.when(F.try_element_at(F.col("own"), F.lower(s["value"])), "").when(s["value"].rlike(r"\p{N}"), "[CODE]").when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    marked = F.transform(hit, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), shape(s).alias("label")))
    return staged(rows.select("doc", "th", marked.alias("terms")).distinct(), "pii-term-spans")


_NONE = "array<struct<start:int,end:int,label:string>>"
_SPANS = "array<struct<start:int,end:int,value:string>>"


def digests(df: DataFrame, rules: Disclosure | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    rules = rules or Disclosure()
    df = df.select(_name(id_col), _name(text_col))
    scan = scanned(df, rules, id_col, text_col)
    spans = scan.select("doc", "th", "held", *KINDS)
    found = spans.where("held").join(term_spans(df, scan, rules, id_col, text_col).hint("merge"), ["doc", "th"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(_NONE)))
    found = found.unionByName(spans.where("NOT held").withColumn("terms", F.array().cast(_NONE)))
    said = F.concat(*(_said(F.col(k), k) for k in KINDS))
    return found.select(
        F.col("doc").alias(id_col), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(said, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(said, _said(F.col("terms"), "term")), ",").alias("spans"), F.size("terms").cast("long").alias("n_term"),
    )


def find(df: DataFrame, rules: Disclosure | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's columns with ``__email``, ``__ip``, ``__card``, ``__phone`` (arrays
    of ``start, end, value``) and ``__terms`` (of ``start, end, label``)."""
    rules = rules or Disclosure()
    text = F.coalesce(F.col(_name(text_col)), F.lit(""))
    own = {f"__{k}": v for k, v in base_spans(text).items()}
    more = term_spans(df, scanned(df, rules, id_col, text_col), rules, id_col, text_col).select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("terms").alias("__terms"))
    # Texts that no guard matches hold no span and needn't meet the terms.
    some = functools.reduce(Column.__or__, (text.rlike(g) for g in _GUARD.values()))
    out = df.where(some).withColumns(own).withColumn("__own", F.xxhash64(text))
    out = out.join(more.hint("merge"), (F.col(_name(id_col)) == F.col("__doc")) & (F.col("__own") == F.col("__th")), "left")
    out = out.withColumn("__terms", F.coalesce("__terms", F.array().cast(_NONE))).drop("__doc", "__th", "__own")
    rest = df.where(~some).withColumns({k: F.array().cast(_SPANS) for k in own}).withColumn("__terms", F.array().cast(_NONE))
    return out.unionByName(rest)


def sanitised(df: DataFrame, rules: Disclosure | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with spans replaced in the text: ``[EMAIL]`` and so on, the class of
    a generalised term, nothing for a removed one. Where spans overlap, their
    union gets the label of the first. A null text stays null."""
    found = find(df, rules, id_col, text_col)
    kind = "array<struct<start:int,end:int,label:string>>"
    label = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("label"))
    labelled = [F.transform(F.col(f"__{k}"), label(k)) for k in KINDS]
    labelled.append(F.col("__terms"))
    spans = F.array_sort(F.concat(*labelled))
    merged = F.aggregate(
        spans,
        F.array().cast(kind),
        lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"]).alias("end"), F.try_element_at(a, F.lit(-1))["label"].alias("label"))))).otherwise(F.concat(a, F.array(s))),
    )
    out = found.withColumn("__all", merged)
    pieces = F.expr(f"transform(__all, (s, k) -> concat(substring({_name(text_col)}, (CASE WHEN k = 0 THEN 0 ELSE __all[k - 1].end END) + 1, s.start - (CASE WHEN k = 0 THEN 0 ELSE __all[k - 1].end END)), s.label))")
    tail = F.expr(f"substring({_name(text_col)}, __all[size(__all) - 1].end + 1)")
    out = out.withColumn(text_col, F.when(F.size("__all") == 0, F.col(_name(text_col))).otherwise(F.concat(F.array_join(pieces, ""), tail)))
    return out.drop("__all", "__terms", *(f"__{k}" for k in KINDS))
