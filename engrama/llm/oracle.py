"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3, "op6_line_dedup": OP6, "op8_decontaminate": OP8, "op12_conversation_repair": op12()}


def op12() -> str:
    """The damage by a table-driven CRC-32, the programme as a recursion over rows that carries the best cost and audit of each last role, and the repaired turns read off the audit."""
    more = lambda s, cost, letters: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || {letters}}} END"
    least = lambda *options: f"list_sort([{', '.join(options)}], 'ASC', 'NULLS LAST')[1]"
    gone = lambda s: more(s, "3", "'D'")

    def stays(role: str, before: dict[str, int]) -> str:
        letter, own = f"CASE WHEN r.initial = '{role}' THEN 'K' ELSE 'R' END", f"CASE WHEN r.initial = '{role}' THEN r.cut ELSE r.cut + 2 END"
        options = [f"CASE WHEN NOT r.forced THEN {more(f'p.{s}', f'{2 * n} + {own}', repr('I' * n) + ' || ' + letter)} END" for s, n in before.items()]
        return least(gone(f"p.s_{role}"), *options)

    kept = f"CASE WHEN NOT r.forced AND r.initial = 's' THEN {more('p.s_', 'r.cut', repr('K'))} END"
    empty = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR))"
    return rf"""WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    [4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS h FROM keyed, crc),
harmed AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (SELECT unnest([1, 2]) AS copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
said AS (SELECT *, left(role, 1) AS initial, md5(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || strlen(role) || ':' || role || ':' || text) AS d FROM harmed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, d) AS i FROM said),
placed AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open FROM numbered),
r AS (SELECT *, blank OR again AS forced, CASE WHEN open THEN 1 ELSE 0 END AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
p AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS s_, {empty} AS s_s, {empty} AS s_u, {empty} AS s_a FROM r
  UNION ALL
  SELECT p.conv_id, r.i, {gone('p.s_')}, {least(gone('p.s_s'), kept)}, {stays('u', {'s_': 0, 's_s': 0, 's_u': 1, 's_a': 0})}, {stays('a', {'s_': 1, 's_s': 1, 's_u': 0, 's_a': 1})}
  FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1),
done AS (
  SELECT conv_id, {least("s_", more("s_s", "4", "'II'"), more("s_u", "2", "'I'"), "s_a")} AS w FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last FROM p) WHERE last = 1),
letter AS (SELECT conv_id, generate_subscripts(string_split(w.a, ''), 1) AS j, unnest(string_split(w.a, '')) AS e FROM done WHERE w.a <> ''),
item AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS m FROM letter),
turned AS (
  SELECT item.conv_id, j, e, m, role, text, bool_or(m = 1 AND e = 'K' AND initial = 's') OVER (PARTITION BY item.conv_id) AS system
  FROM item LEFT JOIN r ON item.e <> 'I' AND r.conv_id IS NOT DISTINCT FROM item.conv_id AND r.i = item.i WHERE e <> 'D'),
fixed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (m - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h
  FROM turned GROUP BY conv_id),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (open AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM c.conv_id"""


OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""

OP6 = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line,
         unnest(string_split(coalesce(text, ''), chr(10))) AS s
  FROM documents),
w AS (SELECT doc_id, line, list_distinct(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS t FROM l),
x AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS r, doc_id, line, t, len(t) AS n FROM w WHERE len(t) >= 1),
tok AS (SELECT r, n, unnest(t) AS tok FROM x),
df AS (SELECT tok, count(*) AS c FROM tok GROUP BY tok),
rare AS (
  SELECT r, n, tok, row_number() OVER (PARTITION BY r ORDER BY c, tok) AS i FROM tok JOIN df USING (tok)),
pre AS (SELECT r, n, tok FROM rare WHERE i <= n - ceil(0.8 * n - 1e-9) + 1),
cand AS (
  SELECT DISTINCT p.r AS later, q.r AS earlier
  FROM pre p JOIN pre q ON p.tok = q.tok AND q.r < p.r AND q.n >= 0.8 * p.n - 1e-9 AND p.n >= 0.8 * q.n - 1e-9),
pair AS (
  SELECT later, len(list_intersect(a.t, b.t)) AS k, a.n + b.n AS s
  FROM cand JOIN x a ON a.r = later JOIN x b ON b.r = earlier),
gone AS (SELECT DISTINCT later AS r FROM pair WHERE k >= 0.8 * (s - k) - 1e-9),
per AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone JOIN x USING (r) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN per USING (doc_id)
"""

OP8 = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bg AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
dg AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bg))),
hit AS (SELECT dg.r, dg.i, dg.n, bg.item_id FROM dg JOIN bg USING (n, g)),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
