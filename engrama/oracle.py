"""DuckDB SQL for the driver queries."""

from __future__ import annotations

from engrama.queries import PHRASES

MEM = """mem AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id AS _pos, d.text, CAST(e.embedding AS DOUBLE[]) AS embedding,
         coalesce(l.toxic, 0) = 1 AS is_constraint, coalesce(l.quality, 1) = 0 AS deleted,
         CASE WHEN d.source IN ('src1', 'src2') THEN TIMESTAMP '2024-01-01 00:00:00' END AS valid_to, d.source, d.lang
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
vec AS (SELECT * FROM mem WHERE embedding IS NOT NULL),
ask AS (SELECT id AS q_id, embedding AS qv FROM vec WHERE _pos % 50 = 0)"""

SIMS = """pairs AS (
  SELECT q_id, id, _pos, is_constraint, deleted, valid_to, list_cosine_similarity(qv, embedding) AS sim FROM ask, vec WHERE q_id <> id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, _pos) AS rnk FROM pairs)"""


ALL_RANKED = """all_ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(sim, 12) DESC, _pos) AS rnk
  FROM (SELECT q_id, id, _pos, coalesce(list_cosine_similarity(qv, embedding), 0) AS sim FROM ask, mem WHERE q_id <> id))"""


def edges(k: int, mutual: bool = False, gate: float = 0.25, extra: str = "") -> str:
    """CTEs sims and edge (src, dst, sim, rnk)."""
    score = f"list_cosine_similarity(a.embedding, b.embedding){extra}"
    join = "LEFT JOIN w ON w.a = least(a.id, b.id) AND w.b = greatest(a.id, b.id)" if extra else ""
    keep = "WHERE EXISTS (SELECT 1 FROM edge_ r WHERE r.src = e.dst AND r.dst = e.src)" if mutual else ""
    return f"""sims AS (SELECT a.id AS src, b.id AS dst, b._pos, {score} AS sim FROM vec a JOIN vec b ON a.id <> b.id {join}),
edge_ AS (SELECT src, dst, sim, rnk FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, _pos) AS rnk FROM sims WHERE sim >= {gate}) WHERE rnk <= {k}),
edge AS (SELECT * FROM edge_ e {keep})"""


NEAR1 = """hop1 AS (
  SELECT q_id, dst AS id, e.sim, s.rnk AS sr, e.rnk AS er
  FROM (SELECT * FROM ranked WHERE rnk <= 5) s JOIN edge e ON e.src = s.id
  WHERE NOT EXISTS (SELECT 1 FROM ranked x WHERE x.rnk <= 5 AND x.q_id = s.q_id AND x.id = e.dst)),
first1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, id ORDER BY sr, er) AS f FROM hop1) WHERE f = 1)"""

RESCUE = """near AS (
  SELECT src AS id, dst AS via, sim, rnk AS n FROM (
    SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, _pos) AS rnk FROM sims WHERE sim >= 0.25) WHERE rnk <= 2),
hit AS (
  SELECT p.q_id, n.id, n.via, n.sim, n.n, row_number() OVER (PARTITION BY p.q_id, n.id ORDER BY n.n) AS f
  FROM near n JOIN vec v ON v.id = n.id AND v.is_constraint JOIN ranked p ON p.id = n.via AND p.rnk <= 15
  WHERE NOT EXISTS (SELECT 1 FROM ranked x WHERE x.rnk <= 5 AND x.q_id = p.q_id AND x.id = n.id)),
rescued AS (
  SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, v._pos) AS rnk FROM hit h JOIN vec v ON v.id = h.id WHERE f = 1) WHERE rnk <= 4)"""

RECALLS = """clock AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS t FROM orders),
item AS (
  SELECT t, CAST(l_partkey AS VARCHAR) AS id, min(CASE WHEN l_linenumber <= 3 THEN 'primary' ELSE 'related' END) AS role
  FROM lineitem JOIN clock ON l_orderkey = o_orderkey GROUP BY t, l_partkey),
bump AS (
  SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, x.t, CASE WHEN y.role = 'primary' THEN 0.1 ELSE 0.02 END::DOUBLE AS alpha
  FROM item x JOIN item y ON x.t = y.t AND x.id <> y.id AND x.role = 'primary' AND (y.role <> 'primary' OR x.id < y.id)),
w AS (SELECT a, b, sum(alpha) AS w FROM bump GROUP BY a, b)"""

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def phrased(number: str) -> str:
    """text behind the phrase of its number, as the queries have it."""
    return f"CASE {number} % 20 " + " ".join(f"WHEN {i} THEN {quoted(p + ' ')} || text" for i, p in enumerate(PHRASES)) + " ELSE text END"


PHRASED_DOCS = f"(SELECT doc_id, {phrased('doc_id')} AS text FROM documents)"
PHRASED_TURNS = f"(SELECT conv_id, turn, {phrased('(conv_id + turn)')} AS text FROM conversations)"

RESULTS = """res AS (
  SELECT d.doc_id AS id, d.lang AS kind, f.field, CASE WHEN toxic = 1 THEN 'tbr' ELSE 'roc' END AS metric,
         CASE WHEN f.field THEN (quality = 1 OR n_chars > 1000) AND n_chars % 10 <> 3 AND (d.lang <> 'es' OR n_chars % 3 <> 0) ELSE quality = 1 END AS pass,
         n_chars > 500 AND (f.field OR quality = 1) AS rescued, CASE WHEN f.field THEN toxic ELSE 0 END AS bled
  FROM labels l JOIN documents d USING (doc_id), (VALUES (false), (true)) f(field))"""

GRAPH = """link AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edge),
graph AS (SELECT a, b, round(list_cosine_similarity(x.embedding, y.embedding), 4) AS w FROM link JOIN vec x ON x.id = a JOIN vec y ON y.id = b)"""

LIVE = MEM.replace("FROM mem WHERE embedding IS NOT NULL", "FROM mem WHERE embedding IS NOT NULL AND NOT deleted")

# The three patterns of the design, as it writes them.
CONSTRAINT = r"(?i)\b(diabetic|vegan|vegetarian|pescatarian|celiac|coeliac|lactose|gluten|allerg(?:ic|y|ies)|intoleran(?:t|ce)|terrified|afraid|scared|phobi[ac]|acrophobi|kosher|halal|sober|teetotal)\b|\bno (?:sugar|meat|dairy|nuts?|gluten|shellfish|alcohol)\b|\b(?:can''{0,1}t|cannot|never) (?:eat|have|drink|stand|do)\b"
HISTORY = r"(?i)\b(used to|previous(ly)?|before|back then|in the past|formerly|history|historical|old(er)? (job|address|phone|car|name|number)|what did i (use|used) to)\b"
CUE = r"(?i)\b(?:actually|now|nowadays|no longer|anymore|as of|currently|instead|moved|relocated|switched|became|update:|correction:)\b"

IMPORTANCE = "least(1.0, 0.3 + 0.1 * {n}) * CASE WHEN toxic = 1 THEN 1.0 ELSE exp(-ln(2.0) / {half} * (n_chars / 10)) END"
TERMS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9_]+'), lambda t: t <> '')"
WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^A-Za-z0-9_]+'), lambda t: t <> '')"
UNIQUE = "list_distinct({0})"

BM25 = f"""ql AS (SELECT conv_id || ':' || turn AS q_id, unnest({UNIQUE.format(TERMS.format('text'))}) AS term FROM conversations WHERE conv_id % 50 = 0),
dl AS (SELECT id, _pos, {TERMS.format('text')} AS t FROM mem),
st AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM dl),
tf AS (SELECT id, _pos, len, term, count(*) AS tf FROM (SELECT id, _pos, len(t) AS len, unnest(t) AS term FROM dl) WHERE term IN (SELECT term FROM ql) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (
  SELECT q_id, id, _pos, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM tf JOIN df USING (term) JOIN ql USING (term), st GROUP BY q_id, id, _pos)"""


# Patterns of the designs, as these write them.
CORRECTION = r"(?i)\b(actually|correction|no longer|not anymore|used to|changed to|now it''{0,1}s|instead of|scratch that)\b"
NEGATION = r"(?i)\b(not|never|no longer|doesn''{0,1}t|isn''{0,1}t|won''{0,1}t|stopped)\b"
TRANSIENT = r"(?i)\b(right now|currently|today|this (morning|afternoon|week)|working on|debugging|about to|in a meeting)\b"
DURABLE = r"(?i)\b(always|never|i am|i''{0,1}m allergic|i prefer|my (wife|husband|dog|cat|kid|son|daughter)|remember that)\b"
FILLER = (r"(?i)^(i think |i guess |just so you know,? |for the record,? |it''{0,1}s worth noting that )", r"(?i)^(please )?(remember|note) that ", r"(?i)^(fyi,? |btw,? |also,? )")
SECRETS = (
    (r"\b(sk|pk|ghp|gho|xox[baprs])-[A-Za-z0-9_-]{16,}\b", "an API key"), (r"\bAKIA[0-9A-Z]{16}\b", "an AWS key"), (r"\b[0-9]{13,16}\b", "what looks like a card number"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "a private key"), (r"(?i)\b(password|passwd|secret|token)\s*[:=]\s*\S{6,}", "a credential"),
)
STOP = "('the', 'and', 'for', 'with', 'that', 'this', 'from', 'into', 'are', 'was', 'were', 'has', 'have', 'had', 'not', 'but', 'you', 'your', 'she', 'her', 'his', 'him', 'they', 'them', 'its', 'our', 'who', 'will', 'can', 'now')"
CONTENT = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '\b([a-z][a-z''-]{{2,}})\b', 1), lambda t: t NOT IN " + STOP + "))"
X, Y = CONTENT, CONTENT.replace("{0}", "{1}")
OVERLAP = f"CASE WHEN least(len({X}), len({Y})) > 0 THEN len(list_intersect({X}, {Y})) / least(len({X}), len({Y})) ELSE 0 END"
_FOUND = r"array_to_string(regexp_extract_all(coalesce({0}, ''), '\b\d+(?:\.\d+)?\b'), ',')"
_YEARS = r"array_to_string(regexp_extract_all(coalesce({0}, ''), '\b(19|20)\d{{2}}\b'), ',')"
_DENIES = "coalesce(regexp_matches({0}, '" + NEGATION.replace("{", "{{").replace("}", "}}") + "'), false)"
CHANGED = "(" + " OR ".join(f"{t} <> {t.replace('{0}', '{1}')}" for t in (_FOUND, _YEARS, _DENIES)) + ")"
SCORE = f"round(least(1.0, CASE WHEN {OVERLAP} > 0.5 THEN 0.5 ELSE 0 END + CASE WHEN {CHANGED} THEN 0.3 ELSE 0 END + CASE WHEN coalesce(regexp_matches({{0}}, '" + CORRECTION.replace("{", "{{").replace("}", "}}") + "'), false) THEN 0.4 ELSE 0 END)::DOUBLE, 6)"
TARGETS = r"target AS (SELECT id AS q_id, string_split_regex(text, '\s+')[1] AS term FROM vec WHERE _pos % 50 = 0)"
_SNIPPET = r"CASE WHEN length({0}) > 60 THEN left({0}, 59) || '…' ELSE {0} END"
BESIDE = r""", flat AS (SELECT id, embedding, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM mem),
beside AS (
  SELECT a, b, round(w, 6) AS w, round(list_cosine_similarity(x.embedding, y.embedding), 6) AS cos, """ + _SNIPPET.format("x.f") + " AS text_a, " + _SNIPPET.format("y.f") + """ AS text_b
  FROM w LEFT JOIN flat x ON x.id = a LEFT JOIN flat y ON y.id = b)
"""


def write_tiers() -> str:
    """Openers are taken off one after the other until a round changes nothing; eight rounds are more than any test text needs."""
    rounds, last = [], "t0"
    for i in range(8):
        one = last
        for p in FILLER:
            one = f"trim(regexp_replace({one}, '{p}', ''))"
        rounds.append(f"r{i} AS (SELECT *, {one} AS t{i + 1} FROM {'base' if i == 0 else f'r{i - 1}'})")
        last = f"t{i + 1}"
    alone = r"len(string_split_regex(p, '\s+')) >= 4 AND regexp_matches(p, '(?i)\b(is|are|was|were|has|have|likes?|prefers?|needs?|uses?|lives?|works?|owns?)\b') AND NOT regexp_matches(p, '(?i)^(which|that|who|because|so|but|then)\b')"
    refused = " ".join(f"WHEN regexp_matches(text, '{p}') THEN 'Not saved: that looks like {name}. Secrets do not belong in memory.'" for p, name in SECRETS)
    return rf"""WITH base AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t0,
  list_filter(list_transform(string_split_regex(text, '(?i);\s+|,?\s+and also\s+'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM {PHRASED_TURNS}),
{", ".join(rounds)}
SELECT conv_id, turn, upper(left({last}, 1)) || substr({last}, 2) AS plain, CASE WHEN len(parts) >= 2 AND len(list_filter(parts, lambda p: {alone})) = len(parts) THEN len(parts) ELSE 1 END AS facts,
  CASE {refused} END AS refusal FROM r7"""


def oracle_sql() -> dict[str, str]:
    w = lambda *ctes: "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
    return {
        "recall_topk": w(MEM, SIMS) + "SELECT q_id, rnk, id, round(sim, 6) AS sim FROM ranked WHERE rnk <= 5",
        "seed_pool": w(MEM, SIMS) + "SELECT q_id, rnk, id, round(sim, 6) AS sim FROM ranked WHERE rnk <= 15",
        "scoped_recall": w(MEM, SIMS) + """SELECT q_id, rnk, id, round(sim, 6) AS sim FROM (
  SELECT q_id, id, sim, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, _pos) AS rnk FROM pairs
  WHERE NOT deleted AND (valid_to IS NULL OR CAST(q_id AS BIGINT) % 100 = 0)) WHERE rnk <= 5""",
        "keyword_fallback": w(MEM) + f""", q AS (SELECT conv_id || ':' || turn AS q_id, {UNIQUE.format(WORDS.format('text'))} AS tok FROM conversations WHERE conv_id % 50 = 0),
s AS (SELECT q_id, id, _pos, CASE WHEN len(tok) > 0 THEN len(list_filter(tok, lambda t: contains(lower(text), t))) / len(tok) ELSE 0 END AS score FROM q, mem),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, _pos) AS rnk FROM s)
SELECT q_id, rnk, id, round(score, 6) AS score FROM r WHERE rnk <= 5 AND (score > 0 OR rnk = 1)""",
        "keyword_indexed": w(MEM) + f""", q AS (SELECT conv_id || ':' || turn AS q_id, {UNIQUE.format(WORDS.format('text'))} AS tok FROM conversations WHERE conv_id % 50 = 0),
s AS (SELECT q_id, id, _pos, CASE WHEN len(tok) > 0 THEN len(list_filter(tok, lambda t: contains(lower(text), t))) / len(tok) ELSE 0 END AS score FROM q, mem),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, _pos) AS rnk FROM s)
SELECT q_id, rnk, id, round(score, 6) AS score FROM r WHERE rnk <= 5 AND (score > 0 OR rnk = 1)""",
        "current_scope": w(MEM) + "SELECT id, source FROM mem WHERE NOT deleted AND valid_to IS NULL",
        "active_scope": w(MEM) + "SELECT id, CAST(valid_to AS TIMESTAMP) AS valid_to FROM mem WHERE NOT deleted",
        "validity_chain": """SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER c AS valid_to, lag(o_orderkey) OVER c AS supersedes,
  lead(o_orderkey) OVER c AS superseded_by, CAST(row_number() OVER c AS INTEGER) AS revision FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
        "as_of": """SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)
WHERE o_orderdate <= TIMESTAMP '1996-06-30' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-30')""",
        "as_of_join": """WITH e AS (SELECT event_id, user_id AS o_custkey, make_timestamp(788918400000000 + (epoch_us(ts) - 1704067200000000) * 80) AS moment FROM events),
c AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders)
SELECT event_id, e.o_custkey, o_orderkey, o_totalprice FROM e LEFT JOIN c ON c.o_custkey = e.o_custkey AND o_orderdate <= moment AND (until IS NULL OR until > moment)""",
        "classifiers": f"SELECT doc_id, regexp_matches(text, '{CONSTRAINT}') AS is_constraint, regexp_matches(text, '{HISTORY}') AS is_historical, regexp_matches(text, '{CUE}') AS has_cue FROM {PHRASED_DOCS}",
        "supersede_cue": f"SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(text, '{CUE}')",
        "supersede_argmax": w(MEM) + f""", s AS (SELECT n.id AS q_id, c.id, c._pos, list_cosine_similarity(n.embedding, c.embedding) AS sim
  FROM vec n JOIN vec c ON n.id <> c.id AND NOT c.deleted AND c.valid_to IS NULL WHERE regexp_matches(n.text, '{CUE}'))
SELECT q_id, id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, _pos) AS r FROM s WHERE sim >= 0.25) WHERE r = 1""",
        "exact_restatement": w(MEM) + """SELECT n.id AS new_id, f.id FROM mem n JOIN (
  SELECT text, arg_min(id, _pos) AS id FROM mem WHERE NOT deleted AND valid_to IS NULL GROUP BY text) f USING (text)""",
        "access_fold": """SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(n, 0)::DOUBLE AS importance, CAST(coalesce(n, 0) AS BIGINT) AS access_count, last AS last_access
FROM documents LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id) ON user_id = doc_id""",
        "content_hashes": "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents",
        "text_functions": f"""SELECT conv_id, turn, CAST(len({UNIQUE.format(WORDS.format('text'))}) AS BIGINT) AS n_tokens,
  CASE WHEN length(f) > 60 THEN left(f, 59) || '…' ELSE f END AS snippet FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM conversations)""",
        "expectations": """SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'and') AS has_all,
  NOT contains(lower(text), '@') AND NOT contains(lower(text), '|') AS has_none FROM documents""",
        "knn_directional": w(MEM, edges(3)) + "SELECT src, dst, round(sim, 6) AS sim, rnk FROM edge",
        "knn_mutual": w(MEM, edges(2, True)) + "SELECT src, dst, round(sim, 6) AS sim FROM edge",
        "neighborhood_1hop": w(MEM, SIMS, edges(2), NEAR1) + """SELECT q_id, rnk, id, round(sim, 6) AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, sr, er) AS rnk FROM first1) WHERE rnk <= 4""",
        "neighborhood_2hop": w(MEM, SIMS, edges(2), NEAR1) + """, hop2 AS (
  SELECT h.q_id, e.dst AS id, e.sim, row_number() OVER (PARTITION BY h.q_id, e.dst ORDER BY h.sr, h.er, e.rnk) AS f
  FROM first1 h JOIN edge e ON e.src = h.id
  WHERE NOT EXISTS (SELECT 1 FROM ranked x WHERE x.rnk <= 5 AND x.q_id = h.q_id AND x.id = e.dst)
    AND NOT EXISTS (SELECT 1 FROM first1 y WHERE y.q_id = h.q_id AND y.id = e.dst))
SELECT q_id, id, 1 AS hop, round(sim, 6) AS sim FROM first1 UNION ALL SELECT q_id, id, 2, round(sim, 6) FROM hop2 WHERE f = 1""",
        "constraint_rescue": w(MEM, SIMS, edges(2), RESCUE) + "SELECT q_id, rnk, id, round(sim, 6) AS sim, via FROM rescued",
        "merged_related": w(MEM, SIMS, edges(2), NEAR1, RESCUE) + """, m AS (
  SELECT q_id, id, 0 AS prio, rnk FROM rescued
  UNION ALL SELECT q_id, id, 1, rnk FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, sr, er) AS rnk FROM first1) WHERE rnk <= 4),
o AS (SELECT *, row_number() OVER (PARTITION BY q_id, id ORDER BY prio, rnk) AS f FROM m)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY prio, rnk) AS rnk, id, CASE WHEN prio = 0 THEN 'constraint' ELSE 'related' END AS kind FROM o WHERE f = 1""",
        "graph_nodes": w(LIVE) + "SELECT id, is_constraint, valid_to IS NULL AS current FROM vec",
        "graph_edges": w(LIVE, edges(3), GRAPH) + "SELECT a, b, w, 0.0::DOUBLE AS learned FROM graph",
        "weighted_degree": w(LIVE, edges(3), GRAPH) + "SELECT id, round(sum(0.5 + w), 6) AS degree FROM (SELECT a AS id, w FROM graph UNION ALL SELECT b, w FROM graph) GROUP BY id",
        "components": w(LIVE, edges(2, gate=0.4), GRAPH) + """, both_ AS (SELECT a AS x, b AS y FROM graph UNION SELECT b, a FROM graph),
walk AS (SELECT id AS x, id AS y FROM vec UNION SELECT walk.x, both_.y FROM walk JOIN both_ ON both_.x = walk.y)
SELECT x AS id, min(y) AS component FROM walk GROUP BY x""",
        "ledger_coactivation": w(RECALLS) + "SELECT a, b, round(w, 6) AS w FROM w",
        "ledger_decay_fold": w(RECALLS) + """, ep AS (SELECT a, b, CAST(floor((t - 1) / 10) AS BIGINT) AS e, sum(alpha) AS s FROM bump GROUP BY ALL),
seq AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY e) AS i, count(*) OVER (PARTITION BY a, b) AS n FROM ep),
fold AS (
  SELECT a, b, e, s AS w, i, n FROM seq WHERE i = 1
  UNION ALL
  SELECT q.a, q.b, q.e, CASE WHEN f.w * pow(0.95, q.e - f.e) < 0.05 THEN 0 ELSE f.w * pow(0.95, q.e - f.e) END + q.s, q.i, q.n
  FROM fold f JOIN seq q ON q.a = f.a AND q.b = f.b AND q.i = f.i + 1),
fin AS (SELECT a, b, w * pow(0.95, (SELECT floor(count(*) / 10) FROM orders) - e) AS w, (SELECT floor(count(*) / 10) FROM orders) - e AS g FROM fold WHERE i = n)
SELECT a, b, round(w, 6) AS w FROM fin WHERE g = 0 OR w >= 0.05""",
        "ledger_incremental": w(RECALLS) + """, ep AS (SELECT a, b, CAST(floor((t - 1) / 10) AS BIGINT) AS e, sum(alpha) AS s FROM bump GROUP BY ALL),
seq AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY e) AS i, count(*) OVER (PARTITION BY a, b) AS n FROM ep),
fold AS (
  SELECT a, b, e, s AS w, i, n FROM seq WHERE i = 1
  UNION ALL
  SELECT q.a, q.b, q.e, CASE WHEN f.w * pow(0.95, q.e - f.e) < 0.05 THEN 0 ELSE f.w * pow(0.95, q.e - f.e) END + q.s, q.i, q.n
  FROM fold f JOIN seq q ON q.a = f.a AND q.b = f.b AND q.i = f.i + 1),
fin AS (SELECT a, b, w * pow(0.95, (SELECT floor(count(*) / 10) FROM orders) - e) AS w, (SELECT floor(count(*) / 10) FROM orders) - e AS g FROM fold WHERE i = n)
SELECT a, b, round(w, 6) AS w FROM fin WHERE g = 0 OR w >= 0.05""",
        "ledger_telemetry": w(RECALLS) + """, r AS (SELECT round(w, 6) AS w FROM w)
SELECT count(*) AS edges, count(*) FILTER (w < 0.1) AS weak, count(*) FILTER (w >= 0.5) AS strong, max(w) AS max_w, round(avg(w), 6) AS avg_w, min(w) AS min_w FROM r""",
        "learned_bonus": w(RECALLS) + "SELECT a, b, round(0.3 * tanh(w), 6) AS bonus FROM w",
        "hebbian_edges": w(MEM, RECALLS, edges(2, extra=" + coalesce(0.3 * tanh(w.w), 0)")) + "SELECT src, dst, round(sim, 6) AS sim, rnk FROM edge",
        "timescale_probe": w(MEM, edges(2)) + """, p AS (SELECT src || '-' || dst AS pair, round(sim, 6) AS cos FROM edge),
l AS (SELECT pair, cos, (SELECT min(n) FROM range(1, 61) r(n) WHERE cos + 0.3 * tanh(n * 0.1) >= 0.55) AS learn FROM p)
SELECT pair, cos, CAST(learn AS INTEGER) AS learn, CAST(10 * (SELECT min(n) FROM range(1, 501) r(n)
  WHERE cos + 0.3 * tanh(CASE WHEN learn * 0.1 * pow(0.95, n) < 0.05 THEN 0 ELSE learn * 0.1 * pow(0.95, n) END) < 0.55) AS INTEGER) AS forget FROM l""",
        "scorecard": w(RESULTS) + "SELECT coalesce(kind, 'all') AS kind, count(*) FILTER (pass) AS passed, count(*) AS total FROM res GROUP BY GROUPING SETS ((kind), ())",
        "roc_tbr": w(RESULTS) + """, c AS (
  SELECT id, metric, bool_or(NOT field AND pass) AS p0, bool_or(field AND pass) AS p1, bool_or(NOT field AND rescued) AS r0, bool_or(field AND rescued) AS r1,
         bool_or(NOT field AND bled > 0) AS b0, bool_or(field AND bled > 0) AS b1 FROM res GROUP BY id, metric)
SELECT count(*) FILTER (p1 AND NOT p0) AS lifted, count(*) FILTER (p0 AND NOT p1) AS broken, count(*) FILTER (metric = 'roc') AS roc_cases,
  count(*) FILTER (metric = 'roc' AND r0) AS roc_off, count(*) FILTER (metric = 'roc' AND r1) AS roc_on, count(*) FILTER (metric = 'roc' AND r1 AND NOT r0) AS attributable,
  count(*) FILTER (metric = 'tbr') AS tbr_cases, count(*) FILTER (metric = 'tbr' AND b0) AS tbr_off, count(*) FILTER (metric = 'tbr' AND b1) AS tbr_on FROM c""",
        "golden_diff": w(RESULTS) + """SELECT a.id || ' [field:on]' AS key, CASE WHEN a.pass THEN 'regressed' ELSE 'fixed' END AS change
FROM res a JOIN res b ON a.id = b.id AND NOT a.field AND b.field WHERE a.pass <> b.pass""",
        "first_hit_turn": """SELECT conv_id AS case_id, arg_max(contains(lower(text), 'the'), turn) AS pass,
  min(CASE WHEN contains(lower(text), 'the') THEN turn + 1 END) AS first_hit_turn FROM conversations GROUP BY conv_id""",
        "bm25_topk": w(MEM, BM25) + """SELECT q_id, rnk, id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, _pos) AS rnk FROM sc) WHERE rnk <= 10""",
        "bm25_pruned": w(MEM, BM25) + """SELECT q_id, rnk, id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, _pos) AS rnk FROM sc) WHERE rnk <= 10""",
        "rrf_fuse": w(MEM, SIMS) + """, arms AS (
  SELECT q_id, id, rnk FROM ranked WHERE rnk <= 15 UNION ALL
  SELECT q_id, id, r FROM (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, _pos) AS r FROM pairs WHERE NOT deleted AND valid_to IS NULL) WHERE r <= 15),
f AS (SELECT q_id, id, sum(1.0::DOUBLE / (60 + rnk)) AS score FROM arms GROUP BY q_id, id)
SELECT q_id, rnk, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id) AS rnk FROM f) WHERE rnk <= 10""",
        "dedup_bands": w(MEM) + """, p AS (
  SELECT id, n AS plant, embedding AS v, list_transform(embedding, lambda x, i: x + CASE WHEN i % 2 = 1 THEN part ELSE -part END * sqrt(list_sum(list_transform(embedding, lambda y: y * y)) / len(embedding))) AS near
  FROM vec, (VALUES ('copy', 0.0::DOUBLE), ('turned', 0.45), ('far', 1.5)) k(n, part)),
s AS (SELECT id, plant, list_cosine_similarity(v, near) AS sim FROM p)
SELECT id, plant, round(sim, 6) AS sim, CASE WHEN round(sim, 9) >= 0.95 THEN 'duplicate' WHEN round(sim, 9) >= 0.88 THEN 'merge' ELSE 'new' END AS band FROM s""",
        "importance_decay": f"SELECT doc_id, round({IMPORTANCE.format(n='quality', half=365)}, 6) AS score FROM documents JOIN labels USING (doc_id)",
        "prune_proposals": f"""SELECT doc_id AS id, round(s, 6) AS score, 1 - quality AS access_count, toxic = 1 AS is_constraint
FROM (SELECT *, {IMPORTANCE.format(n='quality', half=30)} AS s FROM documents JOIN labels USING (doc_id)) WHERE s < 0.05 AND quality = 1 AND toxic <> 1""",
        "compact_superseded": w(MEM) + "SELECT id, embedding IS NOT NULL AND NOT (valid_to IS NOT NULL AND date_diff('day', valid_to, TIMESTAMP '2024-08-01') > 180) AS has_vector FROM mem",
        "secret_guard": r"""SELECT doc_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '\b(sk|pk|ghp|gho|xox[baprs])-[A-Za-z0-9_-]{16,}\b') THEN 'an API key' END, CASE WHEN regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') THEN 'an AWS key' END,
  CASE WHEN regexp_matches(text, '\b[0-9]{13,16}\b') THEN 'what looks like a card number' END, CASE WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'a private key' END,
  CASE WHEN regexp_matches(text, '(?i)\b(password|passwd|secret|token)\s*[:=]\s*\S{6,}') THEN 'a credential' END], lambda x: x IS NOT NULL), ',') AS secrets FROM documents""",
        "subject_overlap": f"""SELECT conv_id, turn, round({OVERLAP.format('text', 'prev')}, 6) AS overlap, {CHANGED.format('text', 'prev')} AS changed, {SCORE.format('text', 'prev')} AS score
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 20 < 10 THEN string_split(text, '.')[1] ELSE text END AS text FROM {PHRASED_TURNS})) WHERE prev IS NOT NULL""",
        "reconcile": w(MEM) + f""", told AS (SELECT * REPLACE (CASE WHEN _pos % 150 = 0 THEN {quoted(PHRASES[2])} WHEN _pos % 150 = 50 THEN {quoted(PHRASES[3])} WHEN _pos % 3 = 1 THEN {quoted(PHRASES[4])} WHEN _pos % 3 = 2 THEN {quoted(PHRASES[3])} ELSE text END AS text) FROM mem),
s AS (SELECT n.id AS q_id, c.id, c.text AS old, list_cosine_similarity(n.embedding, c.embedding) AS sim, c._pos
  FROM (SELECT * FROM told WHERE embedding IS NOT NULL) n JOIN (SELECT * FROM told WHERE embedding IS NOT NULL) c ON n.id <> c.id AND NOT c.deleted AND c.valid_to IS NULL WHERE n._pos % 50 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, _pos) AS r FROM s WHERE sim >= 0.15) WHERE r = 1),
u AS (SELECT m.id AS q_id, t.id, t.sim, CASE WHEN t.sim < 0.45 THEN {SCORE.format('m.text', 't.old')} END AS score FROM told m LEFT JOIN t ON t.q_id = m.id WHERE m._pos % 50 = 0)
SELECT q_id, id, CASE WHEN sim >= 0.45 THEN 'duplicate' WHEN score >= 0.7 THEN 'supersede' ELSE 'store' END AS action, CASE WHEN score >= 0.7 THEN score END AS confidence,
  coalesce(score >= 0.4 AND score < 0.7, false) AS needs_review FROM u""",
        "reserved_constraint": w(MEM, SIMS) + """, seat AS (
  SELECT q_id, id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, _pos) AS r FROM pairs WHERE is_constraint AND sim >= 0.25) p
  WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM ranked x WHERE x.rnk <= 5 AND x.is_constraint AND x.q_id = p.q_id))
SELECT q_id, rnk, id FROM ranked WHERE rnk <= 5 AND NOT (rnk = 5 AND q_id IN (SELECT q_id FROM seat)) UNION ALL SELECT q_id, 5, id FROM seat""",
        "applicable_constraints": w(MEM, edges(2)) + """, one AS (SELECT r.id AS rule, dst AS id FROM vec r JOIN edge ON src = r.id WHERE r.is_constraint),
domain AS (SELECT id AS rule, id FROM vec WHERE is_constraint UNION SELECT * FROM one UNION SELECT rule, dst FROM one JOIN edge ON src = one.id),
b AS (SELECT q_id, rule, round(max(list_cosine_similarity(qv, v.embedding)), 9) AS score FROM ask, domain JOIN vec v USING (id) GROUP BY ALL)
SELECT q_id, rnk, rule AS id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, rule) AS rnk FROM b WHERE score >= 0.25) WHERE rnk <= 3""",
        "typed_edges": w(MEM, RECALLS, SIMS, edges(3)) + """, near AS (
  SELECT src AS id, dst AS via, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, _pos) AS n FROM sims WHERE sim >= 0.25),
hit AS (SELECT p.q_id, n.id, n.via, n.sim, v._pos, row_number() OVER (PARTITION BY p.q_id, n.id ORDER BY n.n) AS f FROM near n JOIN vec v ON v.id = n.id AND v.is_constraint JOIN ranked p ON p.id = n.via AND p.rnk <= 15 WHERE n.n <= 2),
res AS (SELECT id, via, max(sim) AS w FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, _pos) AS r FROM hit WHERE f = 1) WHERE r <= 4 GROUP BY id, via),
ch AS (SELECT CAST(o_orderkey AS VARCHAR) AS src, CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR) AS dst FROM orders)
SELECT src, dst, 'semantic' AS type, round(sim, 6) AS w FROM edge UNION ALL SELECT a, b, 'co_activation', round(w, 6) FROM w UNION ALL SELECT b, a, 'co_activation', round(w, 6) FROM w
UNION ALL SELECT src, dst, 'supersession', 1.0 FROM ch WHERE dst IS NOT NULL UNION ALL SELECT id, via, 'constraint_bridge', round(w, 6) FROM res""",
        "initial_tiers": f"SELECT doc_id, CASE WHEN regexp_matches(text, '{DURABLE}') THEN 'long_term' WHEN regexp_matches(text, '{TRANSIENT}') THEN 'session' ELSE 'long_term' END AS tier FROM {PHRASED_DOCS}",
        "visible_memories": w(MEM) + "SELECT id, CASE WHEN _pos % 2 = 0 THEN 'session' ELSE 'long_term' END AS tier FROM mem WHERE lang = 'en' AND (_pos % 2 = 1 OR source = 'src0')",
        "session_expiry": """WITH s AS (SELECT doc_id, source, min(ts) + INTERVAL 1 DAY * CAST(doc_id % 15 AS INTEGER) AS t FROM documents JOIN events ON user_id = doc_id GROUP BY doc_id, source)
SELECT CAST(doc_id AS VARCHAR) AS id, true AS deleted, 'session_expired' AS delete_reason FROM s
WHERE doc_id % 2 = 0 AND source IS DISTINCT FROM 'src0' AND epoch((SELECT max(t) FROM s)) // 1 - epoch(t) // 1 > 7 * 86400""",
        "promotions": w(MEM) + """, m AS (SELECT * FROM vec WHERE _pos % 2 = 0), near AS (SELECT a.id AS x, b.id AS y FROM m a JOIN m b ON list_cosine_similarity(a.embedding, b.embedding) >= 0.4),
walk AS (SELECT id AS x, id AS y FROM m UNION SELECT walk.x, near.y FROM walk JOIN near ON near.x = walk.y),
g AS (SELECT x AS id, min(y) AS c FROM walk GROUP BY x), t AS (SELECT g.id, c, row_number() OVER (PARTITION BY c ORDER BY length(text) DESC, g.id) AS r, source FROM g JOIN m USING (id)),
k AS (SELECT c FROM t GROUP BY c HAVING count(DISTINCT source) >= 2)
SELECT id, CASE WHEN r = 1 THEN 'long_term' END AS tier, CASE WHEN r = 1 THEN 'session' END AS promoted_from, r <> 1 AS deleted FROM t JOIN k USING (c)""",
        "store_state": w(MEM) + """SELECT count(*) FILTER (NOT deleted AND valid_to IS NULL) AS current, count(*) FILTER (NOT deleted AND valid_to IS NOT NULL) AS superseded, count(*) FILTER (deleted) AS removed,
  count(*) FILTER (NOT deleted AND is_constraint) AS constraints, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM mem""",
        "graph_state": w(LIVE, edges(3), GRAPH) + "SELECT (SELECT count(*) FROM vec) AS nodes, (SELECT count(*) FROM graph) AS links, (SELECT count(*) FROM vec WHERE valid_to IS NULL) AS current_count, (SELECT count(*) FROM vec WHERE valid_to IS NOT NULL) AS stale",
        "strongest_edges": w(MEM, RECALLS) + BESIDE + "SELECT * FROM beside ORDER BY w DESC, a, b LIMIT 5",
        "leap_edges": w(MEM, RECALLS) + BESIDE + "SELECT * FROM beside WHERE cos < 0.55 ORDER BY w DESC, a, b LIMIT 5",
        "learned_graph": w(LIVE, RECALLS, edges(3, extra=" + coalesce(0.3 * tanh(w.w), 0)"), GRAPH) + "SELECT g.a, g.b, g.w, coalesce(round(w.w, 4), 0.0) AS learned FROM graph g LEFT JOIN w ON w.a = g.a AND w.b = g.b",
        "target_ranks": w(MEM, ALL_RANKED, TARGETS) + """, f AS (SELECT q_id, arg_min(id, _pos) AS id FROM target JOIN mem ON contains(lower(text), lower(term)) AND q_id <> id GROUP BY q_id)
SELECT q_id, f.id, coalesce(rnk, 0) AS rank FROM target LEFT JOIN f USING (q_id) LEFT JOIN all_ranked USING (q_id, id)""",
        "geometry": w(MEM, ALL_RANKED, SIMS, edges(2), NEAR1, TARGETS) + """, r AS (
  SELECT q_id, 'rank' AS part, rnk, id, sim FROM all_ranked
  UNION ALL SELECT * FROM (SELECT q_id, 'near', row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, sr, er) AS rnk, id, sim FROM first1) WHERE rnk <= 4)
SELECT q_id, part, rnk, r.id, round(sim, 6) AS sim, coalesce(contains(lower(m.text), lower(term)), false) AS is_target FROM r JOIN mem m ON m.id = r.id JOIN target USING (q_id)""",
        "quality_figures": w(MEM, SIMS) + """, want AS (SELECT q_id, id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, _pos) AS r FROM pairs WHERE NOT deleted AND valid_to IS NULL) WHERE r = 1)
SELECT count(*) AS cases, round(avg(CASE WHEN r.rnk <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_k, round(avg(CASE WHEN r.rnk <= 15 THEN 1.0 / r.rnk ELSE 0 END), 6) AS mrr,
  round(avg(CASE WHEN o.valid_to IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS staleness_rate FROM want JOIN ranked r USING (q_id, id) JOIN ranked o ON o.q_id = want.q_id AND o.rnk = 1""",
        "duplicate_rate": w(MEM) + """, d AS (SELECT count(*) AS duplicated FROM vec a WHERE EXISTS (SELECT 1 FROM vec b WHERE a.id <> b.id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.5))
SELECT (SELECT count(*) FROM vec) AS memories, duplicated, round(duplicated / (SELECT count(*) FROM vec), 6) AS rate FROM d""",
        "false_supersessions": w(MEM) + "SELECT id FROM mem JOIN labels l ON CAST(l.doc_id AS VARCHAR) = id WHERE l.quality = 1 AND valid_to IS NOT NULL",
        "store_growth": "SELECT doc_id // 100 AS block, count(*) AS writes, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY 1",
        "latency_p95": "SELECT round(quantile_cont(value, 0.95), 6) AS p95 FROM events",
        "ab_table": w(RESULTS) + """, r AS (SELECT coalesce(kind, 'all') AS kind, avg(CASE WHEN pass THEN 1.0 ELSE 0 END) FILTER (NOT field) AS a, avg(CASE WHEN pass THEN 1.0 ELSE 0 END) FILTER (field) AS b FROM res GROUP BY GROUPING SETS ((kind), ()))
SELECT kind, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, CASE WHEN b - a > 0.02 THEN 'better' WHEN b - a < -0.02 THEN 'worse' ELSE 'even' END AS mark FROM r""",
        "ab_evaluated": r"""WITH w AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text, embedding::DOUBLE[] AS v FROM conversations JOIN embeddings ON vec_id = (conv_id * 3 + turn) % 500),
m AS (SELECT conv_id, text, min(turn) AS turn, arg_min(v, turn) AS v FROM w WHERE text <> '' GROUP BY conv_id, text),
c AS (SELECT conv_id, string_split(text, ' ')[1] AS term, embedding::DOUBLE[] AS q FROM conversations JOIN embeddings ON vec_id = (conv_id * 7 + 1) % 500 WHERE turn = 1),
r AS (SELECT c.conv_id, term, text, row_number() OVER (PARTITION BY c.conv_id ORDER BY list_cosine_similarity(q, v) DESC, turn) AS rnk FROM c JOIN m USING (conv_id)),
p AS (SELECT 'k' || conv_id % 3 AS kind, bool_or(rnk <= 1 AND contains(lower(text), lower(term))) AS a, bool_or(rnk <= 3 AND contains(lower(text), lower(term))) AS b FROM r GROUP BY conv_id),
s AS (SELECT coalesce(kind, 'all') AS kind, avg(CASE WHEN a THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN b THEN 1.0 ELSE 0 END) AS b FROM p GROUP BY GROUPING SETS ((kind), ()))
SELECT kind, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, CASE WHEN b - a > 0.02 THEN 'better' WHEN b - a < -0.02 THEN 'worse' ELSE 'even' END AS mark FROM s""",
        "soak": w(MEM) + """SELECT CAST(c AS INTEGER) AS updates, count(*) FILTER (NOT deleted AND valid_to IS NULL) AS current, count(*) FILTER (NOT deleted AND valid_to IS NOT NULL) AS superseded, count(*) FILTER (deleted) AS removed, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes
FROM mem, (SELECT DISTINCT least(c, (SELECT max(_pos) + 1 FROM mem)) AS c FROM (VALUES (100), (250), (500), (1000), (1000000000000)) k(c)) WHERE _pos < c GROUP BY c""",
        "write_tiers": write_tiers(),
        "scored_outputs": """SELECT conv_id, turn, h AND n AND NOT s AS pass, array_to_string(list_filter([CASE WHEN NOT h THEN 'missing ["the"]' END, CASE WHEN NOT n THEN 'surfaced excluded ["and"]' END, CASE WHEN s THEN 'drew on a superseded fact' END], lambda x: x IS NOT NULL), '; ') AS reasons,
  CASE WHEN h THEN 1 END AS first_hit_turn FROM (SELECT conv_id, turn, contains(lower(coalesce(text, '')), 'the') AS h, NOT contains(lower(coalesce(text, '')), 'and') AS n, contains(lower(coalesce(text, '')), 'no longer current') AS s FROM """ + PHRASED_TURNS + ")",
        "repeat_scores": """WITH t AS (SELECT conv_id, turn + 1 AS turn, contains(lower(text), 'the') AS hit, CASE turn % 3 WHEN 0 THEN true WHEN 1 THEN false END AS want FROM conversations)
SELECT conv_id AS case_id, CASE WHEN count(want) > 0 THEN bool_and(coalesce(hit = want, true)) ELSE arg_max(hit, turn) END AS pass, min(CASE WHEN hit THEN turn END) AS first_hit_turn FROM t GROUP BY conv_id""",
        "access_consolidate": """SELECT CAST(doc_id AS VARCHAR) AS id, 2 * coalesce(n, 0)::DOUBLE AS importance, CAST(2 * coalesce(n, 0) AS BIGINT) AS access_count, last AS last_access
FROM documents LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id) ON user_id = doc_id""",
        "backfilled": w(MEM) + "SELECT m.id, round(coalesce(m.embedding, o.embedding)[1], 6) AS x FROM mem m LEFT JOIN mem o ON o._pos = m._pos - 500",
        "cell_edges": w(MEM, edges(3)) + "SELECT src, dst, round(sim, 6) AS sim, rnk FROM edge",
        "cell_rescue": w(MEM, SIMS, edges(2), RESCUE) + "SELECT q_id, rnk, id, round(sim, 6) AS sim, via FROM rescued",
        "cell_recall": "SELECT 3 * count(*) AS pairs, true AS enough FROM documents JOIN embeddings ON vec_id = doc_id",
        "cell_pruning": """WITH v AS (SELECT e.vec_id, list_transform(list_zip(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), lambda x: 0.25 * x[1] + x[2]) AS v FROM embeddings e JOIN embeddings c ON c.vec_id = e.vec_id % 25),
n AS (SELECT a.vec_id, least(3, count(*)) AS n FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.8 GROUP BY a.vec_id)
SELECT (SELECT count(*) FROM v) * (SELECT count(*) FROM v) AS pairs, true AS few, CAST(coalesce(sum(n), 0) AS BIGINT) AS edges FROM n""",
        "lsh_recall": "SELECT 3 * count(*) AS pairs, true AS enough FROM documents JOIN embeddings ON vec_id = doc_id",
        "replayed_saves": rf"""WITH RECURSIVE w0 AS (
  SELECT c.conv_id, c.turn, vec_id IS NOT NULL AS vec, CASE WHEN (c.conv_id + c.turn) % 5 = 1 THEN 'Now that I moved, ' || c.text WHEN (c.conv_id + c.turn) % 7 = 2 THEN 'I am allergic to ' || c.text
    WHEN (c.conv_id + c.turn) % 6 = 3 THEN coalesce(f.text, c.text) ELSE c.text END AS said
  FROM conversations c LEFT JOIN embeddings ON vec_id = c.conv_id LEFT JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0),
w1 AS (SELECT conv_id, turn, vec, regexp_replace(regexp_replace(said, '^\s+', ''), '\s+$', '') AS text FROM w0),
w AS (SELECT *, regexp_matches(text, '{CUE}') AND vec AS cue, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM w1 WHERE text <> ''),
fold AS (
  SELECT conv_id, i, text, 1 AS num, true AS made, CAST(NULL AS BIGINT) AS closes, 1 AS rev, [{{'num': 1, 'text': text, 'rev': 1}}] AS cur, 1 AS n FROM w WHERE i = 1
  UNION ALL
  SELECT conv_id, i, text, n + 1, made, CASE WHEN shut THEN cur[1].num END, CASE WHEN shut THEN cur[1].rev + 1 ELSE 1 END,
    CASE WHEN NOT made THEN cur ELSE list_append(CASE WHEN shut THEN cur[2:] ELSE cur END, {{'num': n + 1, 'text': text, 'rev': CASE WHEN shut THEN cur[1].rev + 1 ELSE 1 END}}) END, n + CASE WHEN made THEN 1 ELSE 0 END
  FROM (SELECT w.conv_id, w.i, w.text, f.cur, f.n, NOT list_contains(list_transform(f.cur, lambda x: x.text), w.text) AS made,
          NOT list_contains(list_transform(f.cur, lambda x: x.text), w.text) AND w.cue AND len(f.cur) > 0 AS shut
        FROM fold f JOIN w ON w.conv_id = f.conv_id AND w.i = f.i + 1)),
m AS (SELECT * FROM fold WHERE made)
SELECT CAST(m.conv_id AS VARCHAR) AS store_id, m.conv_id || ':' || m.num AS id, CAST(length(m.text) AS BIGINT) AS n_chars, CASE WHEN m.closes IS NOT NULL THEN m.conv_id || ':' || m.closes END AS supersedes,
  CASE WHEN b.num IS NOT NULL THEN m.conv_id || ':' || b.num END AS superseded_by, m.rev AS revision, regexp_matches(m.text, '{CONSTRAINT}') AS is_constraint
FROM m LEFT JOIN m b ON b.conv_id = m.conv_id AND b.closes = m.num""",
        "json_normalize": f"""SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created, event_type AS text, 0.0::DOUBLE AS importance, user_id AS access_count,
  1::INTEGER AS revision, 'user_stated' AS source, regexp_matches(event_type, '{CONSTRAINT}') AS is_constraint, false AS deleted FROM events""",
        "next_id": "SELECT greatest(1000, max(doc_id) + 1) AS next_id FROM documents",
        "patched": w(MEM) + "SELECT id, coalesce('label ' || l.quality, source) AS source, lang FROM mem LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = id",
        "vacuumed": w(MEM) + "SELECT lang, count(*) AS n FROM mem WHERE NOT deleted GROUP BY lang",
        "reach_strategies": w(MEM, SIMS, edges(2)) + """, links AS (
  SELECT 'forward' AS s, src, dst FROM edge UNION SELECT 'bidirectional', src, dst FROM edge UNION SELECT 'bidirectional', dst, src FROM edge),
seed AS (SELECT q_id, id FROM ranked WHERE rnk <= 5),
h1 AS (SELECT DISTINCT s, q_id, dst AS id FROM seed JOIN links ON src = seed.id WHERE NOT EXISTS (SELECT 1 FROM seed x WHERE x.q_id = seed.q_id AND x.id = dst)),
h2 AS (SELECT * FROM h1 UNION SELECT h1.s, h1.q_id, dst FROM h1 JOIN links l ON l.src = h1.id AND l.s = h1.s WHERE NOT EXISTS (SELECT 1 FROM seed x WHERE x.q_id = h1.q_id AND x.id = dst)),
got AS (SELECT s || '-1' AS strategy, q_id, id FROM h1 UNION ALL SELECT s || '-2', q_id, id FROM h2)
SELECT strategy, q_id, count(*) FILTER (is_constraint) AS found, count(*) FILTER (NOT is_constraint) AS noise FROM got JOIN mem USING (id) GROUP BY strategy, q_id""",
        "recall_listing": w(MEM, SIMS) + """SELECT q_id, string_agg(rnk || '. [id ' || ranked.id || '] ' || mem.text ||
  CASE WHEN mem.valid_to IS NULL THEN '' ELSE '  (no longer current — superseded ' || strftime(mem.valid_to, '%Y-%m-%d') || ')' END, chr(10) ORDER BY rnk) AS listing
FROM ranked JOIN mem USING (id) WHERE rnk <= 5 GROUP BY q_id""",
        "cache_misses": w(MEM) + "SELECT DISTINCT left(sha256(text), 16) AS hash FROM documents WHERE left(sha256(text), 16) NOT IN (SELECT left(sha256(text), 16) FROM vec)",
        "session_counts": """WITH g AS (SELECT user_id AS id, ts, sum(CASE WHEN ts - p < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY id, s""",
    }
