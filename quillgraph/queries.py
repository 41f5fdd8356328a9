"""One registered query per operator over the adapter's graph, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.coerce import coerce
from .functions.text import closest
from .functions.values import millis
from .operators import claims as C
from .operators import discovery as D
from .operators import graph as G
from .operators import mutate as M
from .operators import page as P
from .operators import search as S
from .plans.compiler import compile_filter
from .plans.filters import Page
from .sources.adapter import prelude
from .sources.adapter import stored_graph as graph
from .streaming import debounce as E
from .tables import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_PRE = prelude()

CLAIMS = [
    ("order", "orderstatus", "Status", "State of the order", 1, True, False, None, ["O", "F"]),
    ("order", "totalprice", None, None, 2, None, True, "0", None),
    ("order", "orderpriority", "Priority", None, 1000, False, False, None, None),
    ("urgent", "orderpriority", "Urgency", "Why it is urgent", 5, True, True, '"1-URGENT"', None),
    ("urgent", "totalprice", "Price", None, 3, None, True, "1", None),
    ("customer", "mktsegment", "Segment", None, 1, True, False, None, None),
    ("customer", "phone", None, None, 2, True, False, None, None),
    ("part", "brand", None, None, 1, None, False, None, None),
    ("part", "size", None, None, 2, None, False, None, None),
    ("document", "lang", "Language", None, 1, True, False, None, None),
    ("document", "unknown_field", None, None, 1, True, False, None, None),
]
FIELDS = [
    ("orderstatus", "enum", ["O", "F", "P"], None, False, True, True, True, None),
    ("totalprice", "number", None, None, False, True, True, True, None),
    ("orderpriority", "string", None, '"none"', False, True, True, True, None),
    ("mktsegment", "enum", ["BUILDING", "MACHINERY"], None, False, True, True, True, None),
    ("phone", "string", None, None, False, True, True, True, None),
    ("brand", "string", None, None, False, True, True, True, None),
    ("size", "number", None, None, False, True, True, True, None),
    ("lang", "string", None, None, False, True, True, True, None),
]


def _lit(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, list):
        return "[" + ", ".join(map(_lit, v)) + "]"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows) + f") v({names}))"


_CLAIMS = "claims AS " + _values(CLAIMS, "schema_name, field, label, description, sort_order, required_override, default_overridden, default_override, enum_override")
_FIELDS = "global_fields AS " + _values(FIELDS, "name, field_type, enum_values, default_value, required, ov_required, ov_default, ov_enum, list_item_type")
_DIMS = _PRE.rstrip() + f", {_CLAIMS}, {_FIELDS} "


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _filter(name: str, spec: dict, where: str) -> None:
    """A filter whose result is the ids it accepts."""
    query(name, _PRE + f"SELECT n.id AS id FROM nodes n WHERE {where}")(lambda s, d: compile_filter(graph(s, d), spec).select("id"))


def _type(t: str) -> str:
    return f"EXISTS (SELECT 1 FROM node_types t WHERE t.node_id = n.id AND t.schema_type = '{t}')"


def _field(f: str, cond: str = "TRUE") -> str:
    return f"EXISTS (SELECT 1 FROM node_fields f WHERE f.node_id = n.id AND f.field_name = '{f}' AND {cond})"


_T = "coalesce(f.value_date, f.value_text)"
_ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_filter("f01_node_ids", {"node_ids": ["order:5", "order:7", "customer:3"]}, "n.id IN ('order:5', 'order:7', 'customer:3')")
_filter("f02_without_node_ids", {"types": ["nation"], "without_node_ids": ["nation:5"]}, _type("nation") + " AND n.id NOT IN ('nation:5')")
_filter("f03_types_all", {"types": ["order", "urgent"]}, _type("order") + " AND " + _type("urgent"))
_filter("f04_without_types", {"types": ["order"], "without_types": ["urgent", "document"]}, _type("order") + " AND NOT " + _type("urgent") + " AND NOT " + _type("document"))
_filter("f05_exists_true", {"fields": {"acctbal": {"exists": True}}}, _field("acctbal"))
_filter("f06_exists_false", {"types": ["part"], "fields": {"acctbal": {"exists": False, "gt": 5}}}, _type("part") + " AND NOT " + _field("acctbal"))
_filter("f07_eq_text", {"fields": {"orderstatus": {"eq": "O"}}}, _field("orderstatus", f"{_T} = 'O'"))
_filter("f07_eq_num", {"fields": {"size": {"eq": 11}}}, _field("size", "f.value_number = 11"))
_filter("f08_ne_requires_presence", {"fields": {"ref_text": {"ne": "ref-3"}}}, _field("ref_text", f"{_T} <> 'ref-3'"))
_filter("f09_range", {"fields": {"totalprice": {"gte": 100000, "lt": 200000}}}, _field("totalprice", "f.value_number >= 100000 AND f.value_number < 200000"))
_filter("f09_date_range", {"fields": {"orderdate": {"gt": "1996-01-01", "lte": "1997-06-30"}}}, _field("orderdate", f"{_T} > '1996-01-01' AND {_T} <= '1997-06-30'"))
_filter("f10_contains", {"fields": {"brand": {"contains": "bRaNd#1_"}}}, _field("brand", f"({_ASCII.format('f.value_text')} LIKE '%brand#1_%' OR {_ASCII.format('f.value_json')} LIKE '%brand#1_%')"))
_filter("f11_includes", {"fields": {"tags": {"includes": "ECONOMY"}}}, _field("tags", "list_contains(CAST(f.value_json AS JSON)::VARCHAR[], 'ECONOMY')"))
_filter("f12_one_of", {"fields": {"orderpriority": {"one_of": ["1-URGENT", "5-LOW"]}}}, _field("orderpriority", "f.value_text IN ('1-URGENT', '5-LOW')"))
_filter("f12_one_of_num", {"fields": {"size": {"one_of": [1, 5, 50]}}}, _field("size", "f.value_number IN (1, 5, 50)"))
_filter("f13_many_fields", {"fields": {"orderstatus": {"eq": "F"}, "totalprice": {"gt": 200000}, "orderdate": {"gte": "1996-01-01"}}},
        _field("orderstatus", f"{_T} = 'F'") + " AND " + _field("totalprice", "f.value_number > 200000") + " AND " + _field("orderdate", f"{_T} >= '1996-01-01'"))
_filter("f14_without_fields", {"without_fields": ["orderdate", "acctbal"]}, "NOT " + _field("orderdate") + " AND NOT " + _field("acctbal"))
_filter("f15_ref_out", {"references": {"target": "NATION_3", "rel_type": "nation"}}, "EXISTS (SELECT 1 FROM relationships r WHERE r.source_id = n.id AND r.target = 'NATION_3' AND r.rel_type = 'nation')")
_filter("f16_ref_in", {"references": {"target": "nation_3.md", "direction": "incoming"}}, "EXISTS (SELECT 1 FROM relationships r WHERE r.source_id = n.id AND r.resolved_target_id = 'nation:3')")
_filter("f17_ref_both", {"references": {"target": "NATION_3", "direction": "both"}}, "EXISTS (SELECT 1 FROM relationships r WHERE r.source_id = n.id AND r.target = 'NATION_3') AND EXISTS (SELECT 1 FROM relationships r WHERE r.source_id = n.id AND r.resolved_target_id = 'nation:3')")
_filter("f18_title_eq_nocase", {"title_eq": "customer#000000007"}, f"{_ASCII.format('n.title')} = 'customer#000000007'")
_filter("f19_title_contains", {"title_contains": "RED"}, f"{_ASCII.format('n.title')} LIKE '%red%'")
_filter("f20_without_titles", {"types": ["region"], "without_titles": ["asia", "europe"]}, _type("region") + f" AND {_ASCII.format('n.title')} NOT IN ('asia', 'europe')")
_filter("f21_path_prefix", {"path_prefix": "ORDERS/f/", "without_path_prefix": "orders/F/order-1"}, f"{_ASCII.format('n.file_path')} LIKE 'orders/f/%' AND {_ASCII.format('n.file_path')} NOT LIKE 'orders/f/order-1%'")
_filter("f22_path_dir", {"path_dir": "customers/BUILDING"}, "lower(n.file_path) LIKE 'customers/building/%' AND lower(n.file_path) NOT LIKE 'customers/building/%/%'")
_filter("f23_modified_since", {"modified_since": "1998-01-01T00:00:00Z"}, "n.file_mtime >= 883612800000")
_BUILDING = "EXISTS (SELECT 1 FROM relationships r JOIN nodes t ON t.id = r.resolved_target_id WHERE r.source_id = n.id AND r.rel_type = 'customer' AND EXISTS (SELECT 1 FROM node_fields f WHERE f.node_id = t.id AND f.field_name = 'mktsegment' AND f.value_text = 'BUILDING'))"
_building = {"rel_type": "customer", "target": {"types": ["customer"], "fields": {"mktsegment": {"eq": "BUILDING"}}}}
_filter("j04_join_out", {"types": ["order"], "join_filters": [_building]}, _type("order") + " AND " + _BUILDING)
_filter("j04_join_rel_in_list", {"join_filters": [{"rel_type": ["region", "nation"]}]}, "EXISTS (SELECT 1 FROM relationships r WHERE r.source_id = n.id AND r.rel_type IN ('region', 'nation') AND r.resolved_target_id IS NOT NULL)")
_filter("j05_without_join", {"types": ["order"], "without_joins": [_building]}, _type("order") + " AND NOT " + _BUILDING)
_filter("j06_join_in", {"types": ["part"], "join_filters": [{"direction": "incoming", "rel_type": "part", "target": {"types": ["urgent"]}}]},
        _type("part") + " AND EXISTS (SELECT 1 FROM relationships r JOIN node_types t ON t.node_id = r.source_id AND t.schema_type = 'urgent' WHERE r.resolved_target_id = n.id AND r.rel_type = 'part')")

_FLAGSHIP = {"types": ["order"], "fields": {"orderstatus": {"eq": "O"}}, "join_filters": [_building]}


@query("o01_page", _PRE + f"SELECT n.id AS id, n.file_path AS file_path, n.title AS title, n.version AS version FROM nodes n WHERE {_type('order')} AND {_field('orderstatus', _T + chr(32) + '= ' + chr(39) + 'O' + chr(39))} AND {_BUILDING} ORDER BY n.title, n.id LIMIT 50 OFFSET 10")
def _page(s, d):
    return P.page(graph(s, d), _FLAGSHIP, Page(offset=10))


@query("p02_enriched_page", _PRE + f"""SELECT n.id AS id, n.title AS title, (SELECT string_agg(schema_type, ',' ORDER BY sort_order) FROM node_types t WHERE t.node_id = n.id) AS types,
  (SELECT CAST(count(*) AS BIGINT) FROM node_fields f WHERE f.node_id = n.id) AS field_count FROM nodes n WHERE {_type('order')} ORDER BY n.file_mtime DESC NULLS LAST, n.id LIMIT 50""")
def _enriched(s, d):
    g = graph(s, d)
    return P.enrich(g, P.page(g, {"types": ["order"]}, Page("file_mtime", "desc"))).select("id", "title", F.array_join("types", ",").alias("types"), "field_count")


@query("a01_total", _PRE + f"SELECT CAST(count(*) AS BIGINT) AS total FROM nodes n WHERE {_type('order')} AND {_BUILDING}")
def _total(s, d):
    return P.total(graph(s, d), {"types": ["order"], "join_filters": [_building]})


@query("a02_type_counts", _PRE + "SELECT schema_type, CAST(count(*) AS BIGINT) AS n FROM node_types GROUP BY 1")
def _types(s, d):
    return D.type_counts(graph(s, d))


@query("a03_types_with_schemas", _DIMS + """, c AS (SELECT schema_name, count(*) AS k FROM claims GROUP BY 1), t AS (SELECT schema_type, count(*) AS n FROM node_types GROUP BY 1)
SELECT coalesce(t.schema_type, c.schema_name) AS schema_type, CAST(coalesce(n, 0) AS BIGINT) AS n, k IS NOT NULL AS has_schema, CAST(coalesce(k, 0) AS BIGINT) AS claim_count FROM t FULL JOIN c ON t.schema_type = c.schema_name""")
def _schemas(s, d):
    return D.types_with_schemas(graph(s, d), table(s, "claims", CLAIMS))


@query("a04_stats", _PRE + """SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT CAST(sum(coalesce(length(title), 0) + coalesce(length(body), 0)) AS BIGINT) FROM nodes) AS text_chars,
 (SELECT count(DISTINCT field_name) FROM node_fields) AS field_names, (SELECT count(*) FROM node_fields) AS field_rows, (SELECT count(*) FROM relationships) AS edges, (SELECT count(*) FROM relationships WHERE resolved_target_id IS NULL) AS unresolved""")
def _stats(s, d):
    return D.stats(graph(s, d))


_ORPHANS = ", o AS (SELECT f.* FROM node_fields f WHERE NOT EXISTS (SELECT 1 FROM node_types t JOIN claims c ON c.schema_name = t.schema_type WHERE t.node_id = f.node_id AND c.field = f.field_name))"


@query("a05_orphans", _DIMS + _ORPHANS + "SELECT field_name, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY 1")
def _orphans(s, d):
    return D.orphan_counts(graph(s, d), table(s, "claims", CLAIMS))


@query("a07_field_values", _PRE + """SELECT coalesce(value_text, value_date, value_json) AS value, CAST(count(*) AS BIGINT) AS n FROM node_fields f JOIN node_types t ON t.node_id = f.node_id AND t.schema_type IN ('order', 'urgent')
 WHERE field_name = 'orderpriority' GROUP BY 1 ORDER BY n DESC, value LIMIT 4""")
def _values_of(s, d):
    return D.field_values(graph(s, d), "orderpriority", ["order", "urgent"], 4)


@query("a08_totals", _PRE + "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT coalesce(value_text, CAST(value_number AS VARCHAR))) AS BIGINT) AS distinct_values FROM node_fields WHERE field_name = 'ref_text'")
def _totals(s, d):
    return D.field_totals(graph(s, d), "ref_text")


@query("a09_infer", _PRE + """, k AS (SELECT CASE WHEN value_number IS NOT NULL THEN 'number' ELSE 'string' END AS kind, count(*) AS n FROM node_fields WHERE field_name = 'ref_text' GROUP BY 1),
 x AS (SELECT count(DISTINCT coalesce(value_text, CAST(value_number AS VARCHAR))) AS dv, count(*) AS total FROM node_fields WHERE field_name = 'ref_text'), t AS (SELECT arg_max(kind, n) AS dom, max(n) AS top FROM k)
 SELECT CASE WHEN dom = 'string' AND top >= 5 AND dv <= 10 AND dv / total <= 0.3 THEN 'enum' ELSE dom END AS proposed_type, top / total AS confidence, CAST(dv AS BIGINT) AS distinct_values, CAST(total AS BIGINT) AS total FROM t, x""")
def _infer(s, d):
    return D.infer_type(graph(s, d), "ref_text")


@query("a09_kinds", _PRE + "SELECT CASE WHEN value_number IS NOT NULL THEN 'number' ELSE 'string' END AS kind, count(*) AS n FROM node_fields WHERE field_name = 'ref_text' GROUP BY 1")
def _kinds(s, d):
    return D.field_kinds(graph(s, d), "ref_text")


@query("a09_samples", _PRE + """SELECT value, kind FROM (SELECT coalesce(CAST(value_number AS VARCHAR), value_text) AS value, CASE WHEN value_number IS NOT NULL THEN 'number' ELSE 'string' END AS kind, min(node_id) AS low FROM node_fields WHERE field_name = 'ref_text' GROUP BY 1, 2) x ORDER BY low, value LIMIT 10""")
def _samples(s, d):
    return D.field_samples(graph(s, d), "ref_text")


@query("w07_dissenters", _PRE + "SELECT node_id, 'number' AS kind, CAST(value_number AS VARCHAR) AS value FROM node_fields WHERE field_name = 'ref_text' AND value_number IS NOT NULL ORDER BY node_id LIMIT 10")
def _dissenters(s, d):
    return D.dissenters(graph(s, d), "ref_text")


@query("a10_coverage", _DIMS + """SELECT c.schema_name AS schema_type, c.field AS field_name, (SELECT count(*) FROM node_types t WHERE t.schema_type = c.schema_name) AS nodes,
 (SELECT count(*) FROM node_types t JOIN node_fields f ON f.node_id = t.node_id AND f.field_name = c.field WHERE t.schema_type = c.schema_name) AS filled FROM claims c""")
def _coverage(s, d):
    return D.coverage(graph(s, d), table(s, "claims", CLAIMS))


@query("a11_orphan_names", _DIMS + _ORPHANS + "SELECT t.schema_type AS schema_type, o.field_name AS field_name, CAST(count(*) AS BIGINT) AS n FROM o JOIN node_types t ON t.node_id = o.node_id GROUP BY 1, 2")
def _orphan_names(s, d):
    return D.orphan_names_by_type(graph(s, d), table(s, "claims", CLAIMS))


@query("a12_field_usage", _DIMS + _ORPHANS + """, u AS (SELECT field_name, count(DISTINCT node_id) AS nodes FROM node_fields GROUP BY 1), b AS (SELECT field, string_agg(DISTINCT schema_name, ',' ORDER BY schema_name) AS k FROM claims GROUP BY 1),
 l AS (SELECT field_name, count(DISTINCT node_id) AS k FROM o GROUP BY 1) SELECT u.field_name AS field_name, CAST(u.nodes AS BIGINT) AS nodes, coalesce(b.k, '') AS claimed_by, CAST(coalesce(l.k, 0) AS BIGINT) AS orphan_nodes
 FROM u LEFT JOIN b ON b.field = u.field_name LEFT JOIN l ON l.field_name = u.field_name""")
def _usage(s, d):
    return D.field_usage(graph(s, d), table(s, "claims", CLAIMS))


@query("a13_unresolved", _PRE + "SELECT rel_type, CAST(count(*) AS BIGINT) AS n FROM relationships WHERE resolved_target_id IS NULL GROUP BY 1")
def _unresolved(s, d):
    return D.unresolved(graph(s, d))


@query("p05_storage_kinds", _PRE + "SELECT field_name, CASE WHEN value_json IS NOT NULL THEN 'json' WHEN value_number IS NOT NULL THEN 'number' WHEN value_date IS NOT NULL THEN 'date' ELSE 'text' END AS kind, CAST(count(*) AS BIGINT) AS n FROM node_fields GROUP BY 1, 2")
def _kinds(s, d):
    return D.storage_kinds(graph(s, d))


@query("p07_edges_by_type", _PRE + """SELECT id, direction, rel_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT source_id AS id, 'outgoing' AS direction, rel_type FROM relationships UNION ALL
 SELECT resolved_target_id, 'incoming', rel_type FROM relationships WHERE resolved_target_id IS NOT NULL AND source_id <> resolved_target_id) e WHERE id IN (SELECT node_id FROM node_types WHERE schema_type = 'supplier') GROUP BY 1, 2, 3""")
def _edges(s, d):
    g = graph(s, d)
    return P.edges_by_type(g, compile_filter(g, {"types": ["supplier"]}))


_KEYS = "SELECT id, file_path, 1 AS tier, file_path AS k FROM nodes UNION ALL SELECT id, file_path, 2, title FROM nodes UNION ALL SELECT id, file_path, 3, b FROM bn UNION ALL SELECT id, file_path, 4, lower(b) FROM bn"
_ASK = "SELECT target, 1 AS tier, target AS k FROM q UNION ALL SELECT target, 2, target FROM q UNION ALL SELECT target, 3, bare FROM q UNION ALL SELECT target, 4, lower(bare) FROM q"


@query("g01_resolve", _PRE + f""", bn AS (SELECT id, file_path, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.md$', '') AS b FROM nodes), q AS (SELECT DISTINCT target, regexp_replace(target, '\\.md$', '') AS bare FROM relationships),
 keys AS ({_KEYS}), ask AS ({_ASK}) SELECT target, arg_min(id, (ask.tier, length(file_path), file_path, id)) AS id FROM ask JOIN keys ON keys.tier = ask.tier AND keys.k = ask.k GROUP BY target""")
def _resolve(s, d):
    g = graph(s, d)
    return G.resolve(g.nodes, g.relationships)


@query("g06_expand", _PRE + f""", h AS (SELECT DISTINCT resolved_target_id AS root, source_id AS id FROM relationships WHERE rel_type = 'customer' AND resolved_target_id IS NOT NULL),
 r AS (SELECT h.root, h.id, row_number() OVER (PARTITION BY h.root ORDER BY n.file_mtime DESC NULLS LAST, h.id) AS rank, count(*) OVER (PARTITION BY h.root) AS considered FROM h JOIN nodes n ON n.id = h.id)
 SELECT root, id, CAST(rank AS INTEGER) AS rank, CAST(considered AS BIGINT) AS considered, considered > 10 AS truncated FROM r WHERE rank <= 10""")
def _expand(s, d):
    g = graph(s, d)
    return G.expand(g, compile_filter(g, {"types": ["customer"]}), ["order"], "incoming")


@query("w01_sort_order", _PRE + "SELECT node_id, schema_type, CAST(row_number() OVER (PARTITION BY node_id ORDER BY sort_order, schema_type) - 1 AS INTEGER) AS sort_order FROM node_types")
def _sort_order(s, d):
    return D.sort_orders(graph(s, d).node_types)


@query("u04_claim_diff", "SELECT * FROM (VALUES ('document', 'unknown_field', 'removed'), ('order', 'totalprice', 'changed'), ('region', 'name', 'added')) v(schema_name, field, change)")
def _claim_diff(s, d):
    after = [r for r in CLAIMS if r[1] != "unknown_field" and r[:2] != ("order", "totalprice")] + [("order", "totalprice", "Total", *CLAIMS[1][3:]), ("region", "name", None, None, 1, None, False, None, None)]
    return C.claim_diff(table(s, "claims", CLAIMS), table(s, "claims", after))


_MERGE = """, tl AS (SELECT DISTINCT types FROM (SELECT node_id, string_agg(schema_type, chr(1) ORDER BY sort_order) AS types FROM node_types GROUP BY 1) z),
 e AS (SELECT types AS key, unnest(string_split(types, chr(1))) AS schema_name, unnest(range(len(string_split(types, chr(1))))) AS o FROM tl),
 m AS (SELECT e.key, e.o, c.*, g.required, g.default_value, g.enum_values, CASE WHEN c.default_overridden THEN coalesce(c.default_override, 'null') END AS d FROM e JOIN claims c ON c.schema_name = e.schema_name JOIN global_fields g ON g.name = c.field)"""


@query("v01_merge", _DIMS + _MERGE + """SELECT key, field, arg_min(label, o) FILTER (label IS NOT NULL) AS label, arg_min(description, o) FILTER (description IS NOT NULL) AS description, CAST(coalesce(arg_min(sort_order, o) FILTER (sort_order <> 1000), 1000) AS INTEGER) AS sort_order,
 CASE WHEN count(DISTINCT required_override) = 1 THEN bool_or(required_override) ELSE bool_or(required) END AS required, CASE WHEN count(DISTINCT d) = 1 THEN nullif(max(d), 'null') ELSE max(default_value) END AS default_value,
 CASE WHEN count(DISTINCT d) = 1 THEN 'claim' ELSE 'global' END AS default_source, string_agg(schema_name, ',' ORDER BY o) AS claiming_types,
 CASE WHEN bool_or(enum_override IS NOT NULL) THEN string_agg(array_to_string(coalesce(enum_override, enum_values, []), '|'), ';' ORDER BY o) END AS enum_lists FROM m GROUP BY 1, 2""")
def _merge(s, d):
    lists = C.type_lists(graph(s, d)).select("key", "types").distinct()
    return C.merge_claims(lists, table(s, "claims", CLAIMS), table(s, "global_fields", FIELDS)).withColumn("enum_lists", F.array_join(F.transform("enum_lists", lambda v: F.array_join(v, "|")), ";"))


@query("v05_conformance", _DIMS + """, w AS (SELECT t.node_id, c.field, count(DISTINCT c.required_override) AS k, bool_or(c.required_override) AS r, bool_or(g.required) AS gr FROM node_types t JOIN claims c ON c.schema_name = t.schema_type JOIN global_fields g ON g.name = c.field GROUP BY 1, 2),
 x AS (SELECT coalesce(w.node_id, f.node_id) AS node_id, coalesce(w.field, f.field_name) AS field, CASE WHEN f.node_id IS NOT NULL AND w.node_id IS NOT NULL THEN 'claimed' WHEN f.node_id IS NOT NULL THEN 'orphan' WHEN CASE WHEN k = 1 THEN r ELSE gr END THEN 'unfilled-required' ELSE 'unfilled' END AS state
 FROM w FULL JOIN node_fields f ON f.node_id = w.node_id AND f.field_name = w.field) SELECT field, state, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1, 2""")
def _conformance(s, d):
    return C.conformance(graph(s, d), table(s, "claims", CLAIMS), table(s, "global_fields", FIELDS)).groupBy("field", "state").agg(F.count("*").alias("n"))


# Each claimed field of a node: override if the overriding types agree, else the global value; an enum value is good if the
# list of any claiming type (its override, else the global one) holds it, letter case aside.
_ISSUES = _DIMS + """, e AS (SELECT t.node_id, c.field, any_value(f.field_type) AS kind, CASE WHEN count(DISTINCT c.required_override) = 1 THEN bool_or(c.required_override) ELSE bool_or(f.required) END AS required,
  CASE WHEN count(DISTINCT CASE WHEN c.default_overridden THEN coalesce(c.default_override, 'null') END) = 1 THEN nullif(max(CASE WHEN c.default_overridden THEN coalesce(c.default_override, 'null') END), 'null') ELSE max(f.default_value) END AS dflt,
  flatten(list(coalesce(c.enum_override, f.enum_values, []))) AS valid
  FROM node_types t JOIN claims c ON c.schema_name = t.schema_type JOIN global_fields f ON f.name = c.field GROUP BY 1, 2),
 b AS (SELECT e.*, v.node_id IS NOT NULL AS has, coalesce(v.value_json, CAST(v.value_number AS VARCHAR), v.value_date, v.value_text) AS value, v.value_number IS NOT NULL AS num FROM e LEFT JOIN node_fields v ON v.node_id = e.node_id AND v.field_name = e.field),
 i AS (SELECT node_id, field, value, CASE WHEN NOT has AND required AND dflt IS NULL THEN 'REQUIRED_MISSING' WHEN has AND kind = 'number' AND NOT num AND try_cast(value AS DOUBLE) IS NULL THEN 'TYPE_MISMATCH'
  WHEN has AND kind = 'enum' AND NOT list_contains(list_transform(valid, lambda x: lower(x)), lower(trim(value))) THEN 'ENUM_INVALID' END AS code FROM b)"""


@query("v02_issue_groups", _ISSUES + """, r AS (SELECT *, row_number() OVER (PARTITION BY code, field ORDER BY node_id) AS k FROM i WHERE code IS NOT NULL)
 SELECT code, field, CAST(count(*) AS BIGINT) AS n, string_agg(node_id, ',' ORDER BY node_id) FILTER (k <= 5) AS samples FROM r GROUP BY 1, 2""")
def _issues(s, d):
    return C.issue_groups(C.issues(graph(s, d), table(s, "claims", CLAIMS), table(s, "global_fields", FIELDS)))


def _coerced(name: str, kind: str, expr: str, sql: str, enum: list[str] | None = None) -> None:
    def run(s, d):
        c = coerce(F.col("v"), kind, enum)
        return s.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{expr} AS v").select("event_id", c.alias("r")).select("event_id", "r.ok", "r.value", "r.changed", "r.code")

    query(name, sql)(run)


_coerced("x17_coerce_number", "number", "CASE WHEN event_id % 3 = 0 THEN event_type ELSE ' ' || CAST(event_id AS STRING) || ' ' END",
         "SELECT event_id, event_id % 3 <> 0 AS ok, CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(event_id AS DOUBLE) AS VARCHAR) END AS value, event_id % 3 <> 0 AS changed, CASE WHEN event_id % 3 <> 0 THEN 'STRING_TO_NUMBER' END AS code FROM events")
_coerced("x17_coerce_date", "date", "CASE WHEN event_id % 2 = 0 THEN '2024-02-' || lpad(CAST(event_id % 31 + 1 AS STRING), 2, '0') ELSE 'no date' END",
         "SELECT event_id, ok, CASE WHEN ok THEN v END AS value, ok AS changed, CASE WHEN ok THEN 'STRING_TO_DATE' END AS code FROM (SELECT event_id, '2024-02-' || lpad(CAST(event_id % 31 + 1 AS VARCHAR), 2, '0') AS v, event_id % 2 = 0 AND event_id % 31 + 1 <= 29 AS ok FROM events) x")
_coerced("x17_coerce_enum", "enum", "upper(event_type)", "SELECT event_id, event_type IN ('click', 'error') AS ok, CASE WHEN event_type IN ('click', 'error') THEN event_type END AS value, event_type IN ('click', 'error') AS changed, CASE WHEN event_type IN ('click', 'error') THEN 'STRING_TO_ENUM' END AS code FROM events", ["click", "error"])
_coerced("x12_coerce_boolean", "boolean", "CASE event_id % 3 WHEN 0 THEN ' Yes' WHEN 1 THEN 'FALSE' ELSE 'maybe' END", "SELECT event_id, event_id % 3 < 2 AS ok, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS value, event_id % 3 < 2 AS changed, CASE WHEN event_id % 3 < 2 THEN 'STRING_TO_BOOLEAN' END AS code FROM events")
_coerced("x14_coerce_reference", "reference", "'[[' || event_type || '|x]]'", "SELECT event_id, TRUE AS ok, event_type AS value, TRUE AS changed, 'STRING_TO_REFERENCE' AS code FROM events")


@query("x18_closest", """SELECT t, (SELECT coalesce(string_agg(c, ',' ORDER BY levenshtein(t, c), i), '') FROM (VALUES (0, 'click'), (1, 'view'), (2, 'error'), (3, 'views')) v(i, c) WHERE levenshtein(t, c) <= greatest(2, ceil(0.4 * length(t))) AND levenshtein(t, c) <= ceil(0.5 * length(c))) AS found FROM (SELECT DISTINCT event_type AS t FROM events) e""")
def _closest(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("t")).distinct().select("t", F.array_join(closest("t", ["click", "view", "error", "views"]), ",").alias("found"))


@query("s21_sync_log", """SELECT event_id AS id, (epoch_us(ts) // 1000) AS timestamp, event_type AS event FROM events WHERE (epoch_us(ts) // 1000) >= 1704672000000 AND event_type IN ('click', 'error') ORDER BY 2 DESC, 1 DESC LIMIT 500""")
def _sync_log(s, d):
    log = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), millis("ts").alias("timestamp"), F.col("event_type").alias("event"))
    return D.sync_log(log, since_ms=1704672000000, events=["click", "error"], limit=500)


_BM = """SELECT id, round(score, 9) AS score FROM (WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(lower('doc-' || doc_id || ' ' || coalesce(text, '')), '""" + S.ACCENTS[0] + "', '" + S.ACCENTS[1] + """'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
 t AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'thin')) AS b FROM w), z AS (SELECT count(*) AS n, avg(l) AS al, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM t)
 SELECT id, greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / al)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / al)) AS score FROM t, z WHERE a > 0 AND b > 0) q"""


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), "doc_id").alias("title"), F.col("text").alias("body"))


def _index(s, d):
    path = stored(s, "fts", [f"{d}/documents.parquet"], lambda p: S.save_index(S.build_index(_docs(s, d)), p))
    return S.load_index(s, path)


@query("r01_bm25", _BM)
def _bm25(s, d):
    return S.match(_index(s, d), "the thin").select("id", F.round("score", 9).alias("score"))


@query("r02_match_or", _BM.replace("WHERE a > 0 AND b > 0", "WHERE a > 0 OR b > 0"))
def _match(s, d):
    return S.match(_index(s, d), "the OR thin").select("id", F.round("score", 9).alias("score"))


_Q = [round(0.1 * ((i * 7) % 11 - 5) / 5, 3) for i in range(64)]
_KNN = f"SELECT vec_id AS id, list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS dist FROM embeddings"


def _chunks(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("node_id"), F.lit("node").alias("source_type"), F.lit(0).alias("chunk_index"), F.col("embedding").cast("array<double>").alias("vector"))


@query("r03_knn", f"SELECT id, round(dist, 6) AS distance, CAST(row_number() OVER (ORDER BY dist, id) AS INTEGER) AS rank FROM (SELECT * FROM ({_KNN}) k ORDER BY dist, id LIMIT 400) z")
def _knn(s, d):
    return S.nearest(_chunks(s, d), _Q).select("id", F.round("distance", 6).alias("distance"), "rank")


@query("r04_rrf", f"""SELECT node_id, round(sum(1.0 / (60 + r)), 9) AS score, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT id AS node_id, 'fts' AS s, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_BM.replace('round(score, 9)', 'score')}) f
 UNION ALL SELECT id, 'semantic', row_number() OVER (ORDER BY dist, id) FROM (SELECT * FROM ({_KNN}) k ORDER BY dist, id LIMIT 400) z) u GROUP BY 1""")
def _rrf(s, d):
    return S.fuse(S.match(_index(s, d), "the thin"), S.nearest(_chunks(s, d), _Q)).select("node_id", F.round("score", 9).alias("score"), "sources")


@query("m06_bulk_preview", _PRE + f"SELECT n.id AS id, 'orderstatus' AS field, f.value_text AS old, 'X' AS new, TRUE AS changed FROM nodes n JOIN node_fields f ON f.node_id = n.id AND f.field_name = 'orderstatus' WHERE {_type('urgent')}")
def _preview(s, d):
    return M.bulk_preview(graph(s, d), {"types": ["urgent"]}, {"orderstatus": "X"})


@query("m06_bulk_update", _PRE + f", u AS (SELECT node_id FROM node_types WHERE schema_type = 'urgent') SELECT CASE WHEN field_name = 'orderstatus' AND node_id IN (SELECT * FROM u) THEN 'X' ELSE coalesce(value_text, '-') END AS value, CAST(count(*) AS BIGINT) AS n FROM node_fields WHERE field_name = 'orderstatus' GROUP BY 1")
def _bulk(s, d):
    g = M.bulk_update(graph(s, d), {"types": ["urgent"]}, {"orderstatus": "X"}, dry_run=False, confirm=True)
    return g.node_fields.filter("field_name = 'orderstatus'").groupBy(F.coalesce("value_text", F.lit("-")).alias("value")).agg(F.count("*").alias("n"))


@query("m04_delete", _PRE + f"SELECT rel_type, CAST(count(*) AS BIGINT) AS edges, CAST(count(*) FILTER (resolved_target_id IS NULL OR resolved_target_id IN (SELECT node_id FROM node_types WHERE schema_type = 'customer')) AS BIGINT) AS unresolved FROM relationships WHERE source_id NOT IN (SELECT node_id FROM node_types WHERE schema_type = 'customer') GROUP BY 1")
def _delete(s, d):
    g = graph(s, d)
    g = M.delete(g, compile_filter(g, {"types": ["customer"]}))
    return g.relationships.groupBy("rel_type").agg(F.count("*").alias("edges"), F.count_if(F.col("resolved_target_id").isNull()).alias("unresolved"))


_BURSTS = "SELECT CAST(user_id AS VARCHAR) AS path, event_type AS event, (epoch_us(ts) // 1000) AS ms FROM events"


def _file_events(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("event"), millis("ts").alias("ms"))


@query("t02_debounce", f"""WITH RECURSIVE e AS (SELECT path, event, ms, row_number() OVER (PARTITION BY path ORDER BY ms, event) AS i FROM ({_BURSTS}) x),
 w AS (SELECT path, i, event, ms, ms AS first_ms, 1 AS b FROM e WHERE i = 1 UNION ALL
  SELECT e.path, e.i, e.event, e.ms, CASE WHEN e.ms - w.ms >= 2500 OR e.ms - w.first_ms >= 5000 THEN e.ms ELSE w.first_ms END, w.b + CASE WHEN e.ms - w.ms >= 2500 OR e.ms - w.first_ms >= 5000 THEN 1 ELSE 0 END
  FROM w JOIN e ON e.path = w.path AND e.i = w.i + 1) SELECT path, arg_max(event, i) AS event, min(ms) AS first_ms, max(ms) AS last_ms, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY path, b""")
def _debounce(s, d):
    return E.debounce(_file_events(s, d))


@query("t03_latest", f"SELECT path, arg_max(event, (ms, event)) AS event, max(ms) AS ms FROM ({_BURSTS}) e GROUP BY 1")
def _latest(s, d):
    return E.latest(_file_events(s, d))


@query("t07_suppressed", f"SELECT path, event, ms FROM ({_BURSTS}) e WHERE NOT EXISTS (SELECT 1 FROM ({_BURSTS}) w WHERE w.event = 'error' AND w.path = e.path AND e.ms >= w.ms AND e.ms - w.ms < 60000)")
def _suppressed(s, d):
    e = _file_events(s, d)
    return E.suppressed(e, e.filter("event = 'error'"), 60_000)


@query("t08_windowed", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _windowed(s, d):
    return E.windowed(s.read.parquet(f"{d}/events.parquet")).withColumn("total", F.round("total", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders of customers in one market segment: a filter across an edge, sorted, paged and enriched."""
    g = graph(spark, sf_dir)
    return P.enrich(g, P.page(g, _FLAGSHIP)).select("id", "file_path", "title", "version", F.array_join("types", ",").alias("types"), "field_count")


from . import queries_more, queries_search, queries_write  # noqa: E402, F401
