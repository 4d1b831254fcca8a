"""DuckDB SQL with the rows of those queries that SQL can express: operators 1, 2, 4, 6 and 11.

The others have none: 3, 7 and 13 need the tokenizer's merges, 5 and 8 Spark's hashes and floating-point
battery, 9 and 10 trained weights; 12 would compare every word of a text with every other.
"""

from __future__ import annotations

from .decontaminate import WINDOW
from .quality_rules import COUNTS, MARKS, MAX_REPEAT_PCT, MIN_WORDS, RULES, STOP_WORDS, SYMBOLS, Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _holds(r: Rule) -> str:
    bounds = ["true"]
    if r.at_least is not None:
        bounds.append(f"100 * {r.numerator} >= {r.at_least} * {r.denominator}")
    if r.at_most is not None:
        bounds.append(f"100 * {r.numerator} <= {r.at_most} * {r.denominator}")
    return f"({' AND '.join(bounds)})"


def _count(text: str, chars: str) -> str:
    return f"length({text}) - length(translate({text}, '{chars}', ''))"


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d)),
g AS (
  SELECT r, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g
  FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) AS o(k) GROUP BY r),
by_word AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
    count(*) FILTER (lower(trim(w, '.,;:!?')) IN ({_STOP})) AS n_stop_words
  FROM w GROUP BY r),
lines AS (
  SELECT r, x, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r, x),
by_line AS (
  SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines, sum(n * length(x)) AS line_chars, sum((n - 1) * length(x)) AS dup_line_chars,
    sum(n) FILTER (substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•')) AS n_bullet_lines,
    sum(n) FILTER (ends_with(rtrim(x, ' '), '...')) AS n_ellipsis_lines
  FROM lines GROUP BY r),
counts AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    {_count("t", SYMBOLS)} AS n_symbols, {_count("t", MARKS)} AS n_marks, {_count("t", "!")} AS n_exclamations, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(n_stop_words, 0) AS n_stop_words,
    {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("n_lines", "n_dup_lines", "line_chars", "dup_line_chars", "n_bullet_lines", "n_ellipsis_lines"))}
  FROM d LEFT JOIN by_word USING (r) LEFT JOIN by_line USING (r) LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
    concat_ws(',', {", ".join(f"CASE WHEN NOT {_holds(r)} THEN '{r.name}' END" for r in RULES)}) AS failed_rules
  FROM counts)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM judged
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (
  SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i
  FROM (SELECT r, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM d WHERE text IS NOT NULL)),
g AS (
  SELECT DISTINCT r, array_to_string(s, ' ') AS g
  FROM (SELECT r, i, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM w)
  WHERE len(s) = 4 OR i = 1),
class AS (SELECT r, md5(string_agg(g, chr(10) ORDER BY g)) AS h, count(*) AS n FROM g GROUP BY r),
named AS (SELECT h, min(doc_id) AS least, min(r) AS r, min(n) AS n FROM class JOIN d USING (r) WHERE doc_id IS NOT NULL GROUP BY h),
sets AS (SELECT h, g FROM named JOIN g USING (r)),
pair AS (SELECT x.h AS a, y.h AS b, count(*) AS common FROM sets AS x JOIN sets AS y ON x.g = y.g AND x.h < y.h GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN named AS s ON s.h = a JOIN named AS t ON t.h = b WHERE 100 * common >= 80 * (s.n + t.n - common)
  UNION SELECT m, h FROM (SELECT doc_id, h, min(h) OVER (PARTITION BY doc_id) AS m FROM class JOIN d USING (r) WHERE doc_id IS NOT NULL) WHERE h <> m),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach AS r JOIN edge AS e ON r.b = e.a),
found AS (SELECT a AS h, min(least) AS c FROM reach JOIN named ON named.h = b GROUP BY a)
SELECT doc_id, coalesce(class.n, 0) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(least(c, named.least), named.least, doc_id) END AS component_id,
  coalesce(doc_id = coalesce(least(c, named.least), named.least, doc_id), true) AS kept
FROM d LEFT JOIN class USING (r) LEFT JOIN named USING (h) LEFT JOIN found USING (h)
"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS first FROM p),
m AS (SELECT *, first IS NOT NULL AND coalesce(page_id < first, true) AS again FROM f)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM m
"""

_SPLIT = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NOT NULL THEN {_SPLIT} END AS words FROM documents),
runs AS (
  SELECT r, i, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s
  FROM (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d)),
item AS (SELECT item_id, {_SPLIT} AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, len(s) AS n, array_to_string(s, ' ') AS g
  FROM (
    SELECT item_id, i, list(w) OVER (PARTITION BY b ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s
    FROM (SELECT item_id, row_number() OVER () AS b, words FROM item), LATERAL (SELECT unnest(words) AS w, generate_subscripts(words, 1) AS i))
  WHERE len(s) = {WINDOW} OR i = 1),
lengths AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT r, i, n, item_id
  FROM (SELECT r, i, n, array_to_string(s[1:n], ' ') AS g FROM runs JOIN lengths ON len(s) >= n) JOIN windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM found, range({WINDOW}) AS o(k) WHERE k < n GROUP BY r),
who AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found) GROUP BY r)
SELECT doc_id, coalesce(len(words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN who USING (r)
"""

#: Lists of tokens instead of bitvectors; the restored text is read off the output.
FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x
  FROM documents),
h AS (
  SELECT doc_id, t, w, len(w) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4
  FROM d),
c AS (
  SELECT doc_id, t, n, w[1:least(h1 % (n + 1), h2 % (n + 1))] AS p, w[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))] AS m,
    w[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:] AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
j AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(p, ''), '') AS p, coalesce(array_to_string(m, ''), '') AS m, coalesce(array_to_string(s, ''), '') AS s
  FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM j)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN split_part(o[4:], '<S>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(o, '<P>', 2), '<M>', 1) || split_part(o, '<M>', 2) || split_part(o[4:], '<P>', 1) END) AS restored_sha256
FROM o
"""

ORACLE_SQL = {"op1_quality_rules": QUALITY, "op2_near_dedup": NEAR_DUPLICATES, "op4_warc_segments": ARCHIVES, "op6_decontaminate": CONTAMINATION, "op11_fill_in_middle": FILL_IN_MIDDLE}
