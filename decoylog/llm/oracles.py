"""The operators that SQL can express, as DuckDB SQL over the same tables.

Left out are those that it cannot: learned models (op1, op2), robust scatter
(op10), byte-level codes (op6, op7, op12) and the similarity graph of op3.
"""

from decoylog.llm.license_scan import EQUIVALENT
from decoylog.llm.license_texts import KNOWN, WHOLE

OP4 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n,
         array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i
        FROM b WHERE len(ws) > 0)),
pos AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM w, (SELECT DISTINCT n FROM win))),
hit AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM pos p JOIN win w USING (n, win)),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(len(w.ws), 0) AS BIGINT) AS n_words,
       coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

OP8 = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
f AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (
  SELECT line, length(line) AS n, doc_id, pos FROM f WHERE nth = 1 AND length(line) >= 20),
c AS (
  SELECT s.line AS a, r.line AS b, s.n,
         (s.doc_id, s.pos) AS at_a, (r.doc_id, r.pos) AS at_b
  FROM d s JOIN d r ON left(s.line, s.n // 2) = left(r.line, s.n // 2) AND r.n = s.n
  WHERE s.line <> r.line
  UNION SELECT s.line, r.line, s.n, (s.doc_id, s.pos), (r.doc_id, r.pos)
  FROM d s JOIN d r ON left(s.line, s.n // 2) = left(r.line, s.n // 2) AND r.n = s.n + 1
  UNION SELECT s.line, r.line, s.n, (s.doc_id, s.pos), (r.doc_id, r.pos)
  FROM d s JOIN d r ON right(s.line, s.n - s.n // 2) = right(r.line, s.n - s.n // 2) AND r.n = s.n
  WHERE s.line <> r.line
  UNION SELECT s.line, r.line, s.n, (s.doc_id, s.pos), (r.doc_id, r.pos)
  FROM d s JOIN d r ON right(s.line, s.n - s.n // 2) = right(r.line, s.n - s.n // 2)
    AND r.n = s.n + 1),
near AS (
  SELECT * FROM c WHERE len(list_filter(range(0, n + 1), lambda k:
    left(a, k) = left(b, k) AND (
      (length(b) = n AND k < n AND right(a, n - k - 1) = right(b, n - k - 1))
      OR (length(b) = n + 1 AND right(a, n - k) = right(b, n - k))))) > 0),
late AS (SELECT greatest(at_a, at_b) AS place FROM near),
gone AS (
  SELECT doc_id, pos FROM f
  WHERE nth > 1 OR (doc_id, pos) IN (SELECT place FROM late)),
per AS (
  SELECT doc_id, count(*) AS n_removed,
         string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed
  FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(string_split(t.text, chr(10))), 0) AS BIGINT) AS n_lines,
       coalesce(p.n_removed, 0) AS n_removed, coalesce(p.removed, '') AS removed
FROM documents t LEFT JOIN per p USING (doc_id)
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPELLINGS = ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in EQUIVALENT.items())
_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN.items())
_WHOLE = ", ".join(f"({_quoted(name)}, {_quoted(digest)})" for name, digest in WHOLE.items())
_COPYRIGHT = (
    r"(?m)^[^\p{L}\p{N}\n(©]*"
    r"(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|©|[0-9]{4})|\(c\)[^\p{L}\p{N}\n]*[0-9]{4}|©)[^\n]*$"
    r"|(?m)^[^\p{L}\p{N}\n]*all rights reserved\.?[ \t]*$"
)
OP9 = f"""
WITH texts AS (
  SELECT 'document' AS role, NULL AS name, doc_id, row_number() OVER () AS row, text FROM documents
  UNION ALL SELECT 'known', name, NULL, NULL, text FROM (VALUES {_KNOWN}) k(name, text)),
lines AS (
  SELECT *, regexp_replace(regexp_replace(lower(text), '\\r\\n?', chr(10), 'g'),
    {_quoted(_COPYRIGHT)}, ' ', 'g') AS form FROM texts),
signs AS (
  SELECT *, replace(regexp_replace(regexp_replace(form, 'https?://(www\\.)?', '', 'g'),
    '[''‘’`](s\\b)', '\\1', 'g'), '&', ' and ') AS plain FROM lines),
words AS (
  SELECT *, string_split(trim(regexp_replace(plain, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS ws
  FROM signs),
forms AS (
  SELECT *, array_to_string(list_transform(ws, lambda w:
    coalesce(MAP {{{_SPELLINGS}}}[w], w)), ' ') AS canonical FROM words),
digests AS (SELECT *, CASE WHEN canonical <> '' THEN sha256(canonical) END AS digest FROM forms),
known AS (
  SELECT digest, min(name) AS license_id FROM digests
  WHERE role = 'known' AND digest IS NOT NULL GROUP BY digest
  UNION ALL SELECT w.digest, w.name FROM (VALUES {_WHOLE}) w(name, digest))
SELECT d.doc_id, d.digest, k.license_id FROM digests d LEFT JOIN known k USING (digest)
WHERE d.role = 'document'
"""

OP11 = r"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a)
  SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links,
       least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(r.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN reach r ON r.a = e.vec_id
"""

OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM t),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, array_to_string(u[1 : lo], '') AS pre, array_to_string(u[lo + 1 : hi], '') AS mid,
         array_to_string(u[hi + 1 : n], '') AS suf
  FROM f)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

SQL = {
    "op4_decontamination": OP4,
    "op8_line_dedup": OP8,
    "op9_license_scan": OP9,
    "op11_embedding_links": OP11,
    "op13_fill_middle": OP13,
}
