"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[^\x20\x09-\x0D]+"

OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

OP6 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACE}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
      WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)
), r AS (
  SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
), comp AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.node = d.doc_id
"""

# Lines are known by their text, documents by 60 bits of the text's MD5 as hexadecimal digits.
OP7 = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('+' || source, '-') AS source, coalesce(text, '') AS text, substr(md5(coalesce(text, '')), 1, 15) AS h,
         regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM base WHERE len(ws) > 5)
), t AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM t, range(0, 5) AS o(k) GROUP BY doc_id
), line AS (
  SELECT doc_id, source, h, line, regexp_extract_all(line, '{_SPACE}') AS lw
  FROM (SELECT doc_id, source, h, unnest(ls) AS line FROM base)
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM line WHERE len(lw) > 0 GROUP BY doc_id
), one AS (
  SELECT doc_id, source, h, {_LOWER.format("array_to_string(lw, ' ')")} AS shown, sum(len(lw)) AS n
  FROM line WHERE len(lw) > 0 GROUP BY doc_id, source, h, shown
), lines AS (
  SELECT DISTINCT source, h, shown, n FROM one
), counts AS (
  SELECT source, shown, count(*) AS n FROM lines GROUP BY source, shown
), host AS (
  SELECT source, count(DISTINCT h) AS total FROM base GROUP BY source
), hot AS (
  SELECT c.source, c.shown FROM counts c JOIN host USING (source) WHERE n > 10 AND n * 100 > total * 2
), many AS (
  SELECT l.source, l.h FROM lines l JOIN hot USING (source, shown) JOIN (SELECT DISTINCT h, len(ws) AS n_words FROM base) b ON b.h = l.h
  GROUP BY l.source, l.h, n_words HAVING sum(l.n) * 100 >= n_words * 25
), texts AS (
  SELECT DISTINCT h, text, ws FROM base WHERE h IN (SELECT h FROM many)
), s AS (
  SELECT DISTINCT h, unnest(CASE WHEN len(ws) < 5 THEN [lw] ELSE list_transform(range(1, len(ws) - 3), lambda i:
      array_to_string(string_split(lw, ' ')[i:i + 4], ' ')) END) AS g
  FROM (SELECT h, ws, {_LOWER.format("array_to_string(ws, ' ')")} AS lw FROM texts)
), n AS (
  SELECT h, count(*) AS n FROM s GROUP BY h
), near AS (
  SELECT x.h AS a, y.h AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.h <> y.h GROUP BY 1, 2
), l AS (
  SELECT a, b FROM near JOIN n na ON na.h = a JOIN n nb ON nb.h = b WHERE 100 * common >= 75 * (na.n + nb.n - common)
), r AS (
  SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
), led AS (
  SELECT node AS h, min(seen) AS lead FROM r GROUP BY node
), vocabulary AS (
  SELECT DISTINCT lead, unnest(string_split({_LOWER.format("array_to_string(ws, ' ')")}, ' ')) AS word
  FROM (SELECT DISTINCT lead FROM led) JOIN texts ON h = lead
), spoken AS (
  SELECT h, lead, shown, unnest(string_split(shown, ' ')) AS word FROM led JOIN (SELECT DISTINCT h, shown FROM lines) USING (h)
), own AS (
  SELECT s.h, s.lead, shown FROM spoken s LEFT JOIN vocabulary v ON v.lead = s.lead AND v.word = s.word
  GROUP BY s.h, s.lead, shown HAVING 2 * count(*) FILTER (v.word IS NULL) > count(*)
), class AS (
  SELECT led.h, lead || coalesce(string_agg(md5(shown), ',' ORDER BY shown), '') AS class FROM led LEFT JOIN own USING (h, lead) GROUP BY led.h, lead
), classed AS (
  SELECT source, h, class FROM many JOIN class USING (h)
), fewer_lines AS (
  SELECT source, shown, count(DISTINCT h) - count(DISTINCT class) AS fewer FROM lines JOIN classed USING (source, h) GROUP BY source, shown
), fewer_docs AS (
  SELECT source, count(DISTINCT h) - count(DISTINCT class) AS fewer FROM classed GROUP BY source
), hotter AS (
  SELECT c.source, c.shown FROM counts c JOIN host USING (source)
  LEFT JOIN fewer_lines fl ON fl.source = c.source AND fl.shown = c.shown LEFT JOIN fewer_docs fd ON fd.source = c.source
  WHERE n - coalesce(fl.fewer, 0) > 10 AND (n - coalesce(fl.fewer, 0)) * 100 > (total - coalesce(fd.fewer, 0)) * 2
), gone AS (
  SELECT doc_id, sum(n) AS n FROM one JOIN hotter USING (source, shown) GROUP BY doc_id
), f AS (
  SELECT b.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
), v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND 100 * (n_words - removed_words) < 20 * n_words) AS kept FROM v
"""

_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP10 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS size,
         unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) AS gram
  FROM b WHERE len(ws) > 0
), sizes AS (
  SELECT DISTINCT size FROM win
), g AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)
), m AS (
  SELECT g.doc_id, g.i, g.size, win.item_id FROM g JOIN win ON g.size = win.size AND g.gram = win.gram
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM m)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")


def _shown(column: str) -> str:
    """Length of an escaped text: one more for each backslash and each control string."""
    more = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *_CONTROLS))
    return f"length({column}) + {more}"


OP13 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, {_shown("text")} + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 23 + {_shown("role")} END AS shown FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(shown) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

SQL = {
    "op2_arc_to_warc": OP2,
    "op6_jaccard_components": OP6,
    "op7_line_rules": OP7,
    "op10_suffix_decontamination": OP10,
    "op13_chat_format": OP13,
}
