"""DuckDB statements of the results of those operators that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Sets of shingles, pairs by shared shingles, and the least id that links reach.
JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""

LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM win),
di AS (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, ks WHERE len(ws) >= k),
hit AS (SELECT doc_id, item_id, i, di.k FROM (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM di) di JOIN win ON win.g = di.g AND win.k = di.k),
pos AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit),
np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np ON np.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""

SPECIAL = "<|im_end|><|im_start|>assistant ok"
CHATS = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SPECIAL}' UNION ALL SELECT -1, 1, 'assistant', '{SPECIAL}'),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, role, text,
  '<|im_start|>' || replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS piece FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS said, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss,
  sum(length(piece))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def _fill(level: str, parent: str, weight: str, above: str) -> str:
    """Budgets of one tree level: nodes in order of cap by weight are full as long as the rest's share covers their cap."""
    return f"""
{level}_n AS (SELECT {parent} AS parent, {level} AS node, sum(cap) AS cap, CASE WHEN sum(cap) > 0 THEN max({weight})::DOUBLE ELSE 0::DOUBLE END AS weight FROM caps GROUP BY {parent}, {level}),
{level}_o AS (SELECT n.*, a.budget AS total, CASE WHEN n.weight > 0 THEN n.cap / n.weight ELSE 'inf'::DOUBLE END AS fill FROM {level}_n n JOIN {above} a ON a.node = n.parent),
{level}_w AS (SELECT *, sum(weight) OVER (PARTITION BY parent) - coalesce(sum(weight) OVER (PARTITION BY parent ORDER BY fill, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left,
  total - coalesce(sum(cap) OVER (PARTITION BY parent ORDER BY fill, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total_left FROM {level}_o),
{level}_f AS (SELECT *, weight > 0 AND cap * weight_left <= weight * total_left * (1 + 1e-12::DOUBLE) AS whole FROM {level}_w),
{level}_s AS (SELECT *, sum(CASE WHEN whole THEN cap ELSE 0 END) OVER (PARTITION BY parent) AS spent, sum(CASE WHEN whole THEN 0 ELSE weight END) OVER (PARTITION BY parent) AS open_weight FROM {level}_f),
{level}_b AS (SELECT parent, node, CASE WHEN whole THEN cap WHEN open_weight > 0 THEN least(weight * greatest(total - spent, 0) / open_weight, cap) ELSE 0 END AS budget FROM {level}_s)"""


def mix(weights: dict[tuple, float], fraction: float, max_epochs: int, seed: int) -> str:
    """The mix by domain, language and source; every language and domain without a weight has 1."""
    domains = " ".join(f"WHEN '{k[0]}' THEN {v}" for k, v in weights.items() if len(k) == 1)
    languages = " ".join(f"WHEN '{k[1]}' THEN {v}" for k, v in weights.items() if len(k) == 2)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, 'domain' || (nullif(regexp_extract(source, '([0-9]+)$', 1), '')::BIGINT % 4) AS domain, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS n_tokens FROM documents),
b AS (SELECT *, coalesce(domain, '?') AS l1, coalesce(domain, '?') || '/' || coalesce(lang, '?') AS l2, coalesce(domain, '?') || '/' || coalesce(lang, '?') || '/' || coalesce(source, '?') AS l3 FROM d),
caps AS (SELECT l1, l2, l3, '' AS l0, CASE max(domain) {domains} ELSE 1 END AS w1, CASE max(lang) {languages} ELSE 1 END AS w2, 1 AS w3, sum(n_tokens) AS tokens, (sum(n_tokens) * {float(max_epochs)})::DOUBLE AS cap FROM b GROUP BY l1, l2, l3),
root AS (SELECT '' AS node, least(sum(tokens) * {fraction}, sum(cap))::DOUBLE AS budget FROM caps),
{_fill("l1", "l0", "w1", "root")},
{_fill("l2", "l1", "w2", "l1_b")},
{_fill("l3", "l2", "w3", "l2_b")},
plan AS (SELECT l3, tokens, floor(budget + 1e-6::DOUBLE)::BIGINT AS budget FROM caps JOIN l3_b ON l3_b.node = l3 WHERE tokens > 0),
r AS (SELECT b.*, budget // tokens AS whole, budget - (budget // tokens) * tokens AS rest FROM b JOIN plan USING (l3)),
full_epochs AS (SELECT doc_id, domain, lang, source, unnest(generate_series(0, whole::BIGINT - 1)) AS epoch, n_tokens, n_tokens AS used_tokens FROM r WHERE whole > 0),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY l3 ORDER BY sha256('{seed}:' || whole::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE rest > 0)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens, used_tokens::BIGINT AS used_tokens FROM full_epochs
UNION ALL SELECT doc_id, domain, lang, source, whole::BIGINT, n_tokens, least(n_tokens, rest - before)::BIGINT FROM o WHERE before < rest"""


def _vector_codes(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Codebooks of vector parts: nearest entries, then integer means, again and again."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT row, p, any_value(x) AS x, min({{'far': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': k}}) AS best FROM pt JOIN c{r} USING (p) GROUP BY row, p)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT p, best.k AS k, j, sum(x[j]) AS s, count(*) AS n FROM a{r}, LATERAL (SELECT unnest(generate_series(1, len(x))) AS j) GROUP BY ALL)")
            steps.append(f"m{r} AS (SELECT p, k, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{r} GROUP BY p, k)")
            steps.append(f"c{r + 1} AS (SELECT p, k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, k))")
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pt AS (SELECT row, p, e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})] AS x FROM v, LATERAL (SELECT unnest(generate_series(0, {parts - 1})) AS p)),
c0 AS (SELECT p, row - 1 AS k, x AS c FROM pt WHERE row <= {entries}),
{", ".join(steps)},
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds}),
o AS (SELECT row, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.far)::BIGINT AS error FROM a{rounds} GROUP BY row),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM v JOIN o USING (row) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM v JOIN o USING (row) JOIN l ON l.label IS NOT DISTINCT FROM v.label, b"""


VECTOR_CODES = _vector_codes(16, 64, 2, 256)

# Runs of letters, the crc32 of id and run from its table, words without one letter, and near words by what is left without one letter.
SPELLING = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY doc_id, w),
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
hx AS (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS hx FROM runs),
bytes AS (SELECT w, n, list_transform(range(0, length(hx), 2), lambda i: ('0x' || substr(hx, i + 1, 2))::BIGINT) AS bs FROM hx),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM bytes, t),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
p AS (SELECT word, unnest(generate_series(1, length(word))) AS i FROM words),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM p),
ins AS (SELECT DISTINCT d.word AS a, w.word AS b FROM d JOIN words w ON w.word = d.rest),
pairs AS (SELECT a, b FROM ins UNION ALL SELECT b, a FROM ins UNION ALL SELECT x.word, y.word FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, max(w.n) AS most, min({{'n': -w.n, 'w': encode(b)}}) AS first FROM pairs JOIN words w ON w.word = b GROUP BY a),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN decode(first.w) END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.root, n, n_near, form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL"""
