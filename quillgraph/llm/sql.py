"""DuckDB SQL for the queries that SQL can express over whole tables."""

_PAGES = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS d, strlen(COALESCE(html, '')) AS n FROM pages),
g AS (SELECT d, MAX(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id AS page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.top IS NULL OR g.top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.top <> p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON g.d = p.d AND p.n >= 1000
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# All pairs that share a shingle, and all documents that links reach.
_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("COALESCE(text, '')")}, '{_SPACE}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS at FROM s UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.at)
SELECT s.doc_id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(r.at) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s
"""

_SUBSTRING = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{_SPACE}') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS low FROM k GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (k) WHERE f.low < k.doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(COALESCE(gone, [])) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(COALESCE(gone, []), i)), lambda i: w[i]), ' ')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""

_LEAKS = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("COALESCE(text, '')")}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("COALESCE(text, '')")}, '{_ALNUM}') AS w FROM documents),
h AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM k) z WHERE len(w) >= n)),
m AS (SELECT h.doc_id, h.i, h.n, k.item FROM h JOIN k ON k.k = h.k AND k.n = h.n),
c AS (SELECT doc_id, count(DISTINCT p) AS hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) q GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY 1)
SELECT d.doc_id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(COALESCE(hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(items, 0) AS BIGINT) AS n_items, sha256(COALESCE(names, '')) AS items_sha256, hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"

_NEGATIVES = f"""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS q FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS s FROM r a JOIN r b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
best AS (SELECT a, b AS positive_id, s AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT best.a AS anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY best.a, positive_id ORDER BY p.s DESC, p.b) AS INTEGER) AS rank, p.b AS negative_id, positive_score, p.s AS negative_score
  FROM best JOIN p ON p.a = best.a AND NOT p.same AND 50 * positive_score <= 100 * p.s AND 100 * p.s <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

_FAR = " + ".join(f"(x[{j}] - c[{j}]) * (x[{j}] - c[{j}])" for j in range(1, 5))
_ASSIGN = f"SELECT i, p, any_value(x) AS x, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (SELECT i, x.p AS p, x, e, {_FAR} AS d FROM x JOIN {{0}} USING (p)) y GROUP BY i, p"
_MOVED = "[" + ", ".join(f"CAST(floor(CAST(sum(x[{j}]) AS DOUBLE) / count(*)) AS BIGINT)" for j in range(1, 5)) + "]"
_MOVE = f"SELECT o.p AS p, o.e AS e, coalesce(n.c, o.c) AS c FROM {{0}} o LEFT JOIN (SELECT p, e, {_MOVED} AS c FROM {{1}} GROUP BY p, e) n ON n.p = o.p AND n.e = o.e"

# Vectors of 64 components: parts of four.
_CODES = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, {_WHOLE} AS q FROM embeddings WHERE {_USABLE}),
x AS (SELECT i, p, q[4 * p + 1:4 * p + 4] AS x FROM k, (SELECT unnest(range(16)) AS p) z),
c0 AS (SELECT p, i - 1 AS e, x AS c FROM x WHERE i <= 64), a0 AS ({_ASSIGN.format('c0')}), c1 AS ({_MOVE.format('c0', 'a0')}),
a1 AS ({_ASSIGN.format('c1')}), c2 AS ({_MOVE.format('c1', 'a1')}), a2 AS ({_ASSIGN.format('c2')}),
h AS (SELECT sha256(string_agg(CAST(c[j] AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM c2, (SELECT unnest(range(1, 5)) AS j) z),
v AS (SELECT i, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN v USING (i), h
"""

_KINDS = ["email", "ip", "card", "phone"]
_BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
_ANY = r"[A-Za-z0-9._%+-]+(?:@|\x20?[\[(](?:at|AT|@)[\])]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]+)+|(?:\+\(?|\(|\b)[0-9](?:[\x20().-]{0,2}[0-9]){3,18}\b"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(0, length(g)), lambda i: CASE WHEN i % 2 = 1 THEN CAST(g[length(g) - i] AS INTEGER) * 2 - CASE WHEN CAST(g[length(g) - i] AS INTEGER) > 4 THEN 9 ELSE 0 END ELSE CAST(g[length(g) - i] AS INTEGER) END)) % 10 = 0"
_HOLDS = ["TRUE", "len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(TRY_CAST('0' || right(y, 3) AS INTEGER), 999) > 255)) = 0", f"CASE WHEN length(g) BETWEEN 12 AND 19 THEN {_LUHN} ELSE FALSE END", "length(g) BETWEEN 9 AND 15"]
_SHAPES = ["x ~ '.*[A-Za-z].*'", "NOT x ~ '.*[A-Za-z].*' AND regexp_full_match(x, '[0-9]{1,3}(?:[\\x20.-]{1,2}[0-9]{1,3}){3}')", "NOT x ~ '.*[A-Za-z].*' AND length(g) BETWEEN 12 AND 19", "NOT x ~ '.*[A-Za-z].*' AND length(g) BETWEEN 7 AND 15"]
_AT = "CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT)"
_FOUND = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, regexp_extract_all(t, '{q}') AS m, string_split_regex(t, '{q}') AS p FROM d" for k, q in enumerate([*_BASE, _ANY]))
_MEMBERS = " UNION ALL ".join(f"SELECT doc_id, s, e, value, cs, {k} AS k, regexp_full_match(x, '{_BASE[k]}') AND ({_HOLDS[k]}) AS seed FROM f WHERE {_SHAPES[k]}" for k in range(4))


def _rated(i: int) -> str:
    """Accepted patterns of a round, and what instances are worth after it."""
    return f"""g{i} AS (SELECT k, c, sum(coalesce(w, 0)) // count(*) AS w FROM pairs LEFT JOIN w{i} USING (k, value) GROUP BY k, c HAVING sum(coalesce(w, 0)) // count(*) >= 800000 AND count(*) FILTER (w >= 800000) >= 3),
w{i + 1} AS (SELECT k, value, max(w) AS w FROM (SELECT * FROM w0 UNION ALL SELECT pairs.k, value, g{i}.w FROM pairs JOIN g{i} ON g{i}.k = pairs.k AND g{i}.c = pairs.c) z GROUP BY k, value)"""


_PRIVATE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS MATERIALIZED ({_FOUND}),
u AS MATERIALIZED (SELECT doc_id, k, x, {_DIGITS} AS g, s, s + length(x) AS e, before, behind FROM (SELECT doc_id, k, m[i] AS x, {_AT} AS s, p[i] AS before, p[i + 1] AS behind FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m) y) z),
base AS ({" UNION ALL ".join(f"SELECT doc_id, k, s, e FROM u WHERE k = {k} AND ({h})" for k, h in enumerate(_HOLDS))}),
l AS (SELECT *, list_filter(regexp_split_to_array(lower(string_split(right(before, 64), chr(10))[-1]), '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS ws, contains(right(before, 64), chr(10)) OR length(before) < 64 AS starts FROM u WHERE k = 4),
f AS MATERIALIZED (SELECT doc_id, s, e, x, g, CASE WHEN x ~ '.*[A-Za-z].*' THEN regexp_replace(regexp_replace(lower(x), '\\x20?[\\[(](?:at|@)[\\])]\\x20?', '@', 'g'), '\\x20?[\\[(]dot[\\])]\\x20?', '.', 'g') ELSE g END AS value,
  ['2 ' || array_to_string(v[-2:], ' '), '1 ' || array_to_string(v[-1:], ' ') || ' | ' || regexp_extract(lower(left(behind, 64)), '^[\\x20\\x09]*([^\\x20\\x09-\\x0D]*)', 1)] AS cs FROM (SELECT *, CASE WHEN starts THEN list_concat(['^'], ws) ELSE ws END AS v FROM l) y),
o AS MATERIALIZED (SELECT * EXCLUDE (cs), unnest(cs) AS c FROM ({_MEMBERS}) y), pairs AS MATERIALIZED (SELECT DISTINCT k, c, value FROM o), w0 AS (SELECT DISTINCT k, value, 1000000 AS w FROM o WHERE seed),
{_rated(0)}, {_rated(1)}, {_rated(2)},
more AS (SELECT doc_id, k, s, e FROM o JOIN g2 USING (k, c) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.e AND o.s < b.e) QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY w DESC, k) = 1),
j AS (SELECT doc_id, count(*) FILTER (b AND k = 0) AS n0, count(*) FILTER (b AND k = 1) AS n1, count(*) FILTER (b AND k = 2) AS n2, count(*) FILTER (b AND k = 3) AS n3, string_agg(name, ',' ORDER BY s, k) FILTER (b) AS own, string_agg(name, ',' ORDER BY s, k) AS every
  FROM (SELECT *, {_KINDS}[k + 1] || ':' || s || ':' || e AS name FROM (SELECT *, TRUE AS b FROM base UNION ALL SELECT *, FALSE FROM more) y) z GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(own, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN j USING (doc_id)
"""

ORACLES: dict[str, str] = {"op11_private_data": _PRIVATE, "op12_hard_negatives": _NEGATIVES, "op13_vector_codes": _CODES, "op1_ngram_jaccard_join": _JACCARD, "op2_substring_dedup": _SUBSTRING, "op9_warc": _PAGES, "op10_benchmark_decontamination": _LEAKS}
