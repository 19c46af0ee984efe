"""DuckDB SQL for the queries of this package that SQL can express over whole tables.

Written from the contracts, not from the operators: lines within one edit are
found by comparing lines that share a half, near duplicates by joining exact
shingles, snapshots by comparing whole prefixes.
"""

from . import quality

ORACLES: dict[str, str] = {}

_CLASSES = ["c_lower", "c_upper", "c_digit", "c_blank", "c_symbol", "c_other", "c_beyond"]
_WORDS = [f"w_{i}" for i in range(quality.N_COMMON)] + ["w_other"]


def _jsd(p: list[str], q: list[str]) -> str:
    half = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    terms = [half.format(a=f"({x})", b=f"({y})") for a, b in zip(p, q) for x, y in ((a, b), (b, a))]
    return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0))"


def _judged(refs: str) -> str:
    chars = _jsd([f"c.{x} / c.n_chars" for x in _CLASSES], [f"r.{x}" for x in _CLASSES])
    words = _jsd([f"c.{x} / c.n_words" for x in _WORDS], [f"r.{x}" for x in _WORDS])
    return (f"SELECT c.*, CASE WHEN n_chars >= {quality.MIN_CHARS} AND r.lang_key IS NOT NULL THEN {chars} END AS chars_distance, "
            f"CASE WHEN n_words >= {quality.MIN_WORDS} AND r.lang_key IS NOT NULL THEN {words} END AS words_distance "
            f"FROM counts c LEFT JOIN {refs} r ON r.lang_key IS NOT DISTINCT FROM coalesce(c.lang, chr(1))")


def _refs(rows: str, where: str) -> str:
    shares = [f"sum({c}) / sum({' + '.join(group)}) AS {c}" for group in (_CLASSES, _WORDS) for c in group]
    return f"SELECT coalesce(lang, chr(1)) AS lang_key, {', '.join(shares)} FROM {rows} WHERE {where} GROUP BY ALL"


def _count(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


_common = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in quality.COMMON_WORDS.items())
_found = ", ".join(f"len(list_filter(ws, lambda x: x = common[{i + 1}])) AS w_{i}" for i in range(quality.N_COMMON))
_sum = " + ".join(f"w_{i}" for i in range(quality.N_COMMON))

ORACLES["op8_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             CASE lang {_common} END AS common FROM d),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
counts AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         n_words - ({_sum}) AS w_other, c_symbol AS n_symbols,
         n_chars - c_lower - c_upper - c_digit - c_blank - c_symbol - c_beyond AS c_other, n_chars - c_blank AS word_chars
  FROM (SELECT w.r, doc_id, lang, len(ws) AS n_words, coalesce(rep.n_repeat_words, 0) AS n_repeat_words,
               len(ls) - len(list_distinct(ls)) AS n_dup_lines, length(t) AS n_chars,
               {_count('[a-z]')} AS c_lower, {_count('[A-Z]')} AS c_upper, {_count('[0-9]')} AS c_digit,
               {_count('[' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]')} AS c_blank, {_count('[#*$%&|<>]')} AS c_symbol,
               {_count('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} AS c_beyond, {_found}
        FROM w LEFT JOIN rep ON rep.r = w.r)),
refs1 AS ({_refs('counts', 'NOT base_failed')}),
first AS ({_judged('refs1')}),
refs2 AS ({_refs('first', f'NOT base_failed AND coalesce(greatest(chars_distance, words_distance), 0) <= {quality.TRIM}')}),
last AS ({_judged('refs2')})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(chars_distance > {quality.FAR_CHARS}
         OR (chars_distance > {quality.ODD_CHARS} AND words_distance > {quality.ODD_WORDS}), false) AS kept,
       round(chars_distance, 6) AS chars_distance, round(words_distance, 6) AS words_distance
FROM last
"""

ORACLES["op10_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.b AS component_id, d.doc_id = c.b AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) c ON c.a = d.doc_id
"""

ORACLES["op9_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT *, upper(sha1(h)) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS newest,
             array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
               [instr('0123456789ABCDEF', hex[i])]), '') AS bits FROM x)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT)
         + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)]), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM g
"""

ORACLES["op4_chat_formatting"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, row_number() OVER w AS size, string_agg(role || chr(1) || text || chr(2), '') OVER w AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
e AS (SELECT conv_id, max(size) AS n_turns, arg_max(prefix, size) AS whole FROM p GROUP BY 1),
one AS (SELECT min(conv_id) AS conv_id, n_turns, whole FROM e GROUP BY n_turns, whole),
inner_p AS (SELECT DISTINCT p.prefix FROM p JOIN e ON e.conv_id = p.conv_id WHERE p.size < e.n_turns),
stays AS (SELECT conv_id, n_turns FROM one WHERE whole NOT IN (SELECT prefix FROM inner_p))
SELECT s.conv_id, s.n_turns, 0 AS part,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), ''
                  ORDER BY turn NULLS FIRST, role, text) AS text
FROM t JOIN stays s ON s.conv_id = t.conv_id GROUP BY 1, 2
"""

ORACLES["op2_line_dedup"] = r"""
WITH l AS (SELECT doc_id, i AS no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
words AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT line, min((doc_id, no)) AS first, length(line) AS n FROM words GROUP BY line),
h AS (SELECT line, first, m, left(line, m // 2) AS a, right(line, m - m // 2) AS b FROM (SELECT *, unnest([n, n - 1]) AS m FROM u WHERE n >= 20)),
near AS (SELECT DISTINCT x.line FROM h x JOIN h y ON x.m = y.m AND x.a = y.a AND y.first < x.first WHERE levenshtein(x.line, y.line) <= 1
         UNION SELECT DISTINCT x.line FROM h x JOIN h y ON x.m = y.m AND x.b = y.b AND y.first < x.first WHERE levenshtein(x.line, y.line) <= 1),
kept AS (SELECT l.doc_id, l.no, l.line FROM l LEFT JOIN u ON u.line = l.line
         WHERE u.line IS NULL OR (u.first = (l.doc_id, l.no) AND l.line NOT IN (SELECT line FROM near))),
out AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY no) AS text FROM kept GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text,
       coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
       coalesce(len(string_split(d.text, chr(10))) - coalesce(o.n, 0), 0) AS n_dropped
FROM documents d LEFT JOIN out o ON o.doc_id = d.doc_id
"""
