"""DuckDB SQL for the training-data queries that SQL can express.

Each statement computes its result from the tables in its own way: whole sets and
whole windows are compared, without signatures, hashes of shingles or archives.
"""

from __future__ import annotations

from tessera.llm.quality import LineRules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of other bytes than these.
_WORD = r"[^\x20\x09-\x0D]+"
#: What strips and splits a line.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _count(text: str, characters: str) -> str:
    """SQL for how often any of the characters occurs."""
    listed = characters.replace("'", "''")
    return f"length({text}) - length(translate({text}, '{listed}', ''))"


def near_duplicates(words: int = 2, percent: int = 80) -> str:
    """Pairs of documents by the shingles that they share, closed by recursion."""
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) END AS s FROM split
), sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL
), near AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)
), links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reached AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reached JOIN links ON a = r)
SELECT doc_id, n AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM sizes JOIN reached ON d = doc_id GROUP BY doc_id, n
"""


def repeated_strings(least: int = 200) -> str:
    """Every window of every text, as hexadecimal digits."""
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, n, b, substring(h, {2 * least} * b + 1, {4 * least}) AS part FROM (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, length(h) // {2 * least})) AS b FROM t)),
windows AS (
  SELECT doc_id, {least} * b + j AS pos, md5(substring(part, 2 * j + 1, {2 * least})) AS k FROM (SELECT doc_id, n, b, part, unnest(range(0, {least})) AS j FROM blocks) WHERE {least} * b + j <= n - {least}
),
again AS (SELECT doc_id, pos FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
steps AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {least} THEN 0 ELSE 1 END AS fresh FROM again),
numbered AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM steps),
runs AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + {least} AS hi FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
gone AS (
  SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS tail, string_agg(substring(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS left_hex
  FROM gaps JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(left_hex, '') || substring(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)
"""


def archived() -> str:
    """What the records of the archives must say."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, strlen(body) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substring(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


def line_rules(rules: LineRules | None = None) -> str:
    """Counts of whole texts, and the verdict from each line by itself."""
    r = rules or LineRules()
    trailing = "".join("\\" + c if c in ")]}'\"" else c for c in r.trailing).replace("'", "''")
    closing = "".join("\\" + c if c in ".?!" else c for c in r.closing)
    boilerplate = r.boilerplate.replace("'", "''")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM t),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {r.window - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {r.window - 2})) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {r.window})) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM t),
later AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM lines) WHERE k > 1 AND regexp_matches(line, '{_WORD}') GROUP BY doc_id),
stripped AS (SELECT doc_id, regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS s FROM lines),
parts AS (SELECT doc_id, s, len(list_filter(regexp_split_to_array(s, '{_SPACE}+'), lambda x: x <> '')) AS n, length(regexp_replace(s, '{_SPACE}', '', 'g')) AS chars FROM stripped WHERE s <> ''),
counted AS (SELECT doc_id, s, n, chars, {_count("s", r.separators)} AS bars, {_count("s", r.symbols)} AS marks, (length(s) - length(replace(s, '!!', ''))) // 2 AS shouts FROM parts),
failed AS (
  SELECT doc_id, count(*) AS n, sum(chars)::BIGINT AS lost FROM counted
  WHERE (bars > 0 AND 3 * bars >= n) OR (marks > 1 AND 2 * marks >= n) OR 2 * shouts >= n + 1 OR NOT regexp_matches(s, '[{closing}][{trailing}]*$') OR regexp_matches(s, '{boilerplate}')
  GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, '')) AS word_chars, {_count("text", "#*$%&|<>")} AS n_symbols, coalesce(later.n, 0) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, coalesce(failed.n, 0) AS n_failed_lines, coalesce(lost, 0) AS lost_chars
  FROM words LEFT JOIN later USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN failed USING (doc_id)
)
SELECT *, n_words < {r.least_words} OR 100 * n_repeat_words > {r.most_repeat} * n_words AS base_failed,
  NOT (n_words < {r.least_words} OR 100 * n_repeat_words > {r.most_repeat} * n_words) AND 100 * lost_chars <= {r.most_lost} * word_chars AS kept FROM counts
"""


ORACLES: dict[str, str] = {"op6_quality": line_rules(), "op7_warc": archived(), "op9_neardup": near_duplicates(), "op10_substring": repeated_strings()}
