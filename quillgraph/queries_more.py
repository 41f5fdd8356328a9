"""Further registered queries: search, single nodes, mutations, schemas, ingest and coercion."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import coerce as CO
from .functions import templates as TP
from .functions.values import classified, rebuilt
from .operators import claims as C
from .operators import mutate as M
from .operators import nodes as N
from .operators import schemas as SC
from .operators import search as S
from .operators import undo as U
from .operators import write as W
from .plans.compiler import compile_filter
from .queries import _BM, _DIMS, _ISSUES, _KNN, _PRE, _Q, CLAIMS, FIELDS, _chunks, _docs, _index, _type, _values, query
from .sources import markdown as MD
from .sources import upgrade as UP
from .sources.adapter import stored_graph as graph
from .tables import table

SCHEMAS = [("order", "Order", None, "orders"), ("customer", "Customer", None, "customers"), ("part", "Part", None, None), ("document", "Document", None, "docs/all")]
_SCHEMAS = "schemas AS " + _values(SCHEMAS, "name, display_name, filename_template, default_directory")
AFTER = [r for r in CLAIMS if r[:2] not in {("order", "totalprice"), ("urgent", "totalprice"), ("document", "lang")}]
_AFTER = "later AS " + _values(AFTER, "schema_name, field, label, description, sort_order, required_override, default_overridden, default_override, enum_override")
_EVENT = "CASE event_id % 5 WHEN 0 THEN '\"' || event_type || '\"' WHEN 1 THEN CAST(event_id AS {0}) WHEN 2 THEN 'true' WHEN 3 THEN '[1,\"' || event_type || '\"]' ELSE 'null' END"


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


def _dims(s):
    return table(s, "claims", CLAIMS), table(s, "global_fields", FIELDS)


@query("p06_classify", f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type END AS value_text, CASE WHEN event_id % 5 = 1 THEN CAST(event_id AS DOUBLE) END AS value_number,
 CAST(NULL AS VARCHAR) AS value_date, CASE WHEN event_id % 5 >= 2 THEN {_EVENT.format('VARCHAR')} END AS value_json FROM events""")
def _classify(s, d):
    return _events(s, d).selectExpr("event_id", f"{_EVENT.format('STRING')} AS v").select("event_id", *classified(F.col("v")))


@query("m06_set_list", _PRE + f", u AS (SELECT node_id FROM node_types WHERE schema_type = 'economy') SELECT f.node_id AS node_id, CASE WHEN u.node_id IS NULL THEN f.value_json ELSE '[\"y\",\"z\"]' END AS value_json FROM node_fields f LEFT JOIN u ON u.node_id = f.node_id WHERE f.field_name = 'tags'")
def _set_list(s, d):
    g = M.bulk_update(graph(s, d), {"types": ["economy"]}, {"tags": ["y", "z"]}, dry_run=False, confirm=True)
    return g.node_fields.filter("field_name = 'tags'").select("node_id", "value_json")


@query("m06_preview_same", _PRE + f"SELECT n.id AS id, 'size' AS field, CAST(f.value_number AS VARCHAR) AS old, '11.0' AS new, f.value_number <> 11 AS changed FROM nodes n JOIN node_fields f ON f.node_id = n.id AND f.field_name = 'size' WHERE {_type('economy')}")
def _preview_same(s, d):
    return M.bulk_preview(graph(s, d), {"types": ["economy"]}, {"size": 11})


@query("p08_get_node", _PRE + """SELECT n.id AS id, n.title AS title, (SELECT string_agg(schema_type, ',' ORDER BY sort_order) FROM node_types t WHERE t.node_id = n.id) AS types,
 (SELECT string_agg(field_name, ',' ORDER BY field_name) FROM node_fields f WHERE f.node_id = n.id) AS fields, (SELECT string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) FROM relationships r WHERE r.source_id = n.id) AS outgoing,
 (SELECT count(*) FROM relationships r WHERE r.resolved_target_id = n.id) AS incoming FROM nodes n WHERE n.id = 'customer:7'""")
def _get_node(s, d):
    g = graph(s, d)
    keys = lambda c: F.array_join(F.sort_array(F.map_keys(c)), ",")
    count = F.aggregate(F.map_values("incoming"), F.lit(0).cast("long"), lambda a, e: a + F.size(e))
    return N.full(g, N.find(g, title="Customer#000000007")).select("id", "title", F.array_join("types", ",").alias("types"), keys("fields").alias("fields"), keys("outgoing").alias("outgoing"), count.alias("incoming"))


@query("p07_edge_lists", _PRE + f"""SELECT id, direction, rel_type, other, name, CAST(count(*) AS BIGINT) AS n FROM (SELECT r.source_id AS id, 'outgoing' AS direction, r.rel_type, (SELECT min(m.id) FROM nodes m WHERE m.title = r.target) AS other, r.target AS name FROM relationships r
 UNION ALL SELECT r.resolved_target_id, 'incoming', r.rel_type, r.source_id, m.title FROM relationships r JOIN nodes m ON m.id = r.source_id WHERE r.source_id <> r.resolved_target_id) x WHERE id IN (SELECT node_id FROM node_types WHERE schema_type = 'supplier') GROUP BY 1, 2, 3, 4, 5""")
def _edge_lists(s, d):
    g = graph(s, d)
    return N.edge_lists(g, compile_filter(g, {"types": ["supplier"]}))


@query("a19_delete_preview", _PRE + f"""SELECT n.id AS id, (SELECT count(*) FROM node_fields f WHERE f.node_id = n.id) AS fields, (SELECT count(*) FROM relationships r WHERE r.source_id = n.id) AS outgoing,
 (SELECT count(*) FROM relationships r WHERE r.resolved_target_id = n.id) AS incoming FROM nodes n WHERE {_type('supplier')}""")
def _delete_preview(s, d):
    g = graph(s, d)
    return N.delete_preview(g, compile_filter(g, {"types": ["supplier"]}))


@query("p09_describe_schema", _DIMS + """SELECT c.field AS field, field_type, coalesce(label, c.field) AS label, sort_order, coalesce(required_override, required) AS required, CASE WHEN default_overridden THEN default_override ELSE default_value END AS default_value,
 array_to_string(coalesce(enum_override, enum_values), ',') AS enum_values, required_override IS NOT NULL AS overrides_required, default_overridden, enum_override IS NOT NULL AS overrides_enum FROM claims c JOIN global_fields g ON g.name = c.field WHERE schema_name = 'order'""")
def _describe(s, d):
    return SC.describe_schema("order", *_dims(s)).withColumn("enum_values", F.array_join("enum_values", ","))


@query("p09_describe_field", _DIMS + "SELECT name, field_type, (SELECT string_agg(DISTINCT schema_name, ',' ORDER BY schema_name) FROM claims WHERE field = 'totalprice') AS claimed_by, (SELECT count(DISTINCT node_id) FROM node_fields WHERE field_name = 'totalprice') AS nodes FROM global_fields WHERE name = 'totalprice'")
def _describe_field(s, d):
    return SC.describe_field(graph(s, d), "totalprice", *_dims(s)).select("name", "field_type", "claimed_by", "nodes")


@query("s20_global_fields", _DIMS + "SELECT name, field_type FROM global_fields ORDER BY name")
def _list_fields(s, d):
    return SC.list_fields(_dims(s)[1]).select("name", "field_type")


_FUSED = f"""SELECT node_id, sum(1.0 / (60 + r)) AS score, string_agg(DISTINCT s, ',' ORDER BY s) AS sources, min(c) AS matched_chunk_index FROM (SELECT id AS node_id, 'fts' AS s, row_number() OVER (ORDER BY score DESC, id) AS r, NULL AS c FROM ({_BM.replace('round(score, 9)', 'score')}) f @@
 UNION ALL SELECT id, 'semantic', row_number() OVER (ORDER BY dist, id), 0 FROM (SELECT * FROM ({_KNN}) k ORDER BY dist, id LIMIT 400) z @@) u GROUP BY 1"""


_ENGLISH = "WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en')"


@query("r05_hybrid", f"SELECT node_id, round(score, 9) AS score, sources, CAST(matched_chunk_index AS INTEGER) AS matched_chunk_index, 'doc-' || node_id AS title FROM ({_FUSED.replace('@@', '')}) x WHERE node_id IN (SELECT doc_id FROM documents) ORDER BY x.score DESC, node_id LIMIT 20 OFFSET 5")
def _hybrid(s, d):
    near = _chunks(s, d)
    docs = _docs(s, d)
    # vectors of rows that are no document are left out after the nearest are known, as any candidate filter is
    hits = S.fuse(S.match(_index(s, d), "the thin"), S.nearest(near, _Q)).join(docs.select(F.col("id").alias("node_id"), "title"), "node_id")
    return hits.orderBy(F.desc("score"), "node_id").offset(5).limit(20).select("node_id", F.round("score", 9).alias("score"), "sources", "matched_chunk_index", "title")


@query("r06_prefilter", f"SELECT node_id, round(score, 9) AS score, sources FROM ({_FUSED.replace('@@', _ENGLISH)}) x")
def _prefilter(s, d):
    en = s.read.parquet(f"{d}/documents.parquet").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    return S.fuse(S.match(_index(s, d), "the thin"), S.nearest(_chunks(s, d), _Q), en).select("node_id", F.round("score", 9).alias("score"), "sources")


_MARKS = """regexp_replace(regexp_replace('doc-' || f.id || ' ' || t.text, '(the)', '<mark>\\1</mark>', 'gi'), '(thin)', '<mark>\\1</mark>', 'gi')"""


@query("x22_snippets", f"""SELECT id AS node_id, CASE WHEN a > 0 THEN '...' ELSE '' END || substring(m, a + 1, b - a) || CASE WHEN b < length(m) THEN '...' ELSE '' END AS snippet FROM (SELECT *, greatest(0, p - 40) AS a, least(length(m), p + 120) AS b
 FROM (SELECT id, m, strpos(m, '<mark>') - 1 AS p FROM (SELECT f.id, {_MARKS} AS m FROM ({_BM}) f JOIN documents t ON t.doc_id = f.id ORDER BY score DESC, f.id LIMIT 50) x) y) z""")
def _snippets(s, d):
    near = _chunks(s, d).filter("id < 0")
    return S.hybrid(_index(s, d), near, "the thin", _Q, _docs(s, d)).select("node_id", "snippet")


@query("r07_document", _PRE + "SELECT n.id AS node_id, sha256(concat_ws(chr(10) || chr(10), nullif(n.title, ''), nullif(n.body, ''), (SELECT string_agg(value_text, chr(10) || chr(10) ORDER BY field_name) FROM node_fields f WHERE f.node_id = n.id AND value_text IS NOT NULL))) AS hash FROM nodes n")
def _document(s, d):
    g = graph(s, d)
    return S.documents(g.nodes, g.node_fields).select("node_id", F.sha2("content", 256).alias("hash"))


@query("r08_chunks")
def _chunked(s, d):
    g = graph(s, d)
    docs = S.documents(compile_filter(g, {"types": ["document"]}), g.node_fields)
    return S.chunks_of(docs).select("node_id", "chunk_index", F.sha2("content", 256).alias("hash"))


@query("r10_embedding_queue", "SELECT doc_id AS node_id, 'node' AS source_type, CAST(NULL AS VARCHAR) AS extraction_ref FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 < 3")
def _queue(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("node_id"), F.lit("node").alias("source_type"), F.lit(None).cast("string").alias("extraction_ref"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), (F.col("doc_id") % 7).alias("tries"))
    return S.embedding_queue(docs.unionByName(docs), docs.filter("node_id % 3 = 0"))


@query("a14_index_status", "SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(DISTINCT vec_id) FROM embeddings) AS embedded")
def _status(s, d):
    return S.index_status(_docs(s, d), _chunks(s, d))


@query("a15_invalid_values", _ISSUES + "SELECT field, value, CAST(count(*) AS BIGINT) AS n FROM i WHERE code = 'ENUM_INVALID' GROUP BY 1, 2")
def _invalid(s, d):
    return C.invalid_values(C.issues(graph(s, d), *_dims(s)))


@query("v04_fixable", _ISSUES + """, c AS (SELECT i.node_id, i.field, i.value, b.valid, (SELECT arg_min(x.v, (levenshtein(lower(trim(i.value)), lower(x.v)), x.o)) FROM (SELECT unnest(b.valid) AS v, unnest(range(len(b.valid))) AS o) x
  WHERE levenshtein(lower(trim(i.value)), lower(x.v)) <= greatest(2, ceil(0.4 * length(trim(i.value)))) AND levenshtein(lower(trim(i.value)), lower(x.v)) <= ceil(0.5 * length(x.v))) AS suggestion
  FROM i JOIN b ON b.node_id = i.node_id AND b.field = i.field WHERE i.code = 'ENUM_INVALID') SELECT node_id, field, suggestion, CASE WHEN suggestion IS NULL THEN array_to_string(valid, ',') END AS allowed FROM c""")
def _fixable(s, d):
    g = graph(s, d)
    claims, fields = _dims(s)
    lists = C.type_lists(g)
    e = C.merge_claims(lists.select("key", "types").distinct(), claims, fields)
    out = C.fixable(C.issues(g, claims, fields).join(lists.select("node_id", "key"), "node_id"), e, fields)
    return out.select("node_id", "field", "suggestion", F.array_join("allowed", ",").alias("allowed"))


@query("v06_unknown_types", _DIMS + f", {_SCHEMAS} SELECT DISTINCT schema_type FROM node_types WHERE schema_type NOT IN (SELECT name FROM schemas)")
def _unknown_types(s, d):
    return W.unknown_types(graph(s, d).node_types, table(s, "schemas", SCHEMAS))


@query("v07_claim_issues", _DIMS + "SELECT schema_name, field, CASE WHEN g.name IS NULL THEN 'UNKNOWN_FIELD' ELSE 'STRUCTURAL_INCOMPAT' END AS code FROM claims c LEFT JOIN global_fields g ON g.name = c.field WHERE g.name IS NULL OR (enum_override IS NOT NULL AND field_type <> 'enum')")
def _claim_issues(s, d):
    return SC.claim_issues(*_dims(s))


@query("v08_retype_preview", _PRE + "SELECT node_id, value_number IS NOT NULL AS ok, CAST(value_number AS VARCHAR) AS value, CASE WHEN value_number IS NOT NULL THEN 'STRING_TO_NUMBER' END AS code FROM node_fields WHERE field_name = 'ref_text'")
def _retype_preview(s, d):
    return SC.retype_preview(graph(s, d), "ref_text", "number").select("node_id", "ok", "value", "code")


@query("v08_retype", _PRE + "SELECT count(*) AS rows, count(value_number) AS numbers, (SELECT count(*) FROM node_fields WHERE field_name = 'ref_text' AND value_text IS NOT NULL) AS removed FROM node_fields WHERE field_name = 'ref_text' AND value_number IS NOT NULL")
def _retype(s, d):
    g, log = SC.retype(graph(s, d), "ref_text", "number", discard=True)
    a = g.node_fields.filter("field_name = 'ref_text'").agg(F.count("*").alias("rows"), F.count("value_number").alias("numbers"))
    return a.crossJoin(log.agg(F.count("*").alias("removed")))  # one row each


@query("v08_retype_list", _PRE + """SELECT node_id, CASE WHEN value_number IS NOT NULL THEN '[' || CAST(CAST(value_number AS BIGINT) AS VARCHAR) || '.0]' END AS value_json FROM node_fields WHERE field_name = 'ref_text' AND value_number IS NOT NULL""")
def _retype_list(s, d):
    g, _ = SC.retype(graph(s, d), "ref_text", "list", discard=True, item="number")
    return g.node_fields.filter("field_name = 'ref_text'").select("node_id", "value_json")


@query("v08_retype_date", _PRE + "SELECT node_id, value_date AS value_text, 'STRING_TO_DATE' AS code FROM node_fields WHERE field_name = 'orderdate'")
def _retype_date(s, d):
    return SC.retype_preview(graph(s, d), "orderdate", "date").select("node_id", F.col("value").alias("value_text"), "code")


@query("v10_orphaned_by", _DIMS + f""", {_AFTER} SELECT f.field_name AS field_name, CAST(count(*) AS BIGINT) AS n FROM node_fields f WHERE EXISTS (SELECT 1 FROM node_types t JOIN claims c ON c.schema_name = t.schema_type WHERE t.node_id = f.node_id AND c.field = f.field_name)
 AND NOT EXISTS (SELECT 1 FROM node_types t JOIN later c ON c.schema_name = t.schema_type WHERE t.node_id = f.node_id AND c.field = f.field_name) GROUP BY 1""")
def _orphaned(s, d):
    return SC.orphaned_by(graph(s, d), table(s, "claims", CLAIMS), table(s, "claims", AFTER))


@query("v10_propagate", _DIMS + "SELECT node_id, 'orderpriority' AS field_name, '1-URGENT' AS value_text FROM node_types WHERE schema_type = 'nation'")
def _propagate(s, d):
    new = [*CLAIMS, ("nation", "orderpriority", None, None, 1, True, True, '"1-URGENT"', None)]
    add, _ = SC.propagate(graph(s, d), table(s, "claims", CLAIMS), table(s, "claims", new), table(s, "global_fields", FIELDS))
    return add.select("node_id", "field_name", "value_text")


@query("v14_folders", _DIMS + f", {_SCHEMAS}, t AS (SELECT node_id, arg_min(schema_type, (sort_order, schema_type)) AS name FROM node_types GROUP BY 1) SELECT coalesce(s.default_directory, '') AS folder, CAST(count(*) AS BIGINT) AS n FROM t LEFT JOIN schemas s ON s.name = t.name GROUP BY 1")
def _folders(s, d):
    return SC.folders(graph(s, d), table(s, "schemas", SCHEMAS)).groupBy("folder").agg(F.count("*").alias("n"))


@query("g04_rename", _PRE + "SELECT rel_type, target, resolved_target_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT rel_type, CASE WHEN resolved_target_id = 'nation:3' THEN 'NATION_3' ELSE target END AS target, CASE WHEN resolved_target_id = 'nation:3' THEN NULL ELSE resolved_target_id END AS resolved_target_id FROM relationships WHERE rel_type = 'nation') x GROUP BY 1, 2, 3")
def _rename(s, d):
    g = graph(s, d)
    nodes = g.nodes.withColumns({c: F.when(F.col("id") == "nation:3", v).otherwise(F.col(c)) for c, v in (("title", "Elsewhere"), ("file_path", "nations/Elsewhere.md"))})
    return W.refresh_on_rename(g.relationships, nodes, "nation:3").filter("rel_type = 'nation'").groupBy("rel_type", "target", "resolved_target_id").agg(F.count("*").alias("n"))


@query("g03_claim_edges", _PRE + "SELECT rel_type, resolved_target_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT rel_type, CASE WHEN resolved_target_id IS NULL THEN 'new:1' ELSE resolved_target_id END AS resolved_target_id FROM relationships WHERE rel_type = 'customer' AND (resolved_target_id IS NULL OR resolved_target_id = 'customer:7')) x GROUP BY 1, 2")
def _claim_edges(s, d):
    g = graph(s, d)
    new = s.createDataFrame([("new:1", "ghosts/ghost.md", "Ghost")], "id string, file_path string, title string")
    out = W.claim_edges(g.relationships, new).filter("rel_type = 'customer' and resolved_target_id in ('new:1', 'customer:7')")
    return out.groupBy("rel_type", "resolved_target_id").agg(F.count("*").alias("n"))


@query("m01_apply", _PRE + f"SELECT n.id AS id, CASE WHEN n.id IN ('part:1', 'part:2') THEN n.version + 1 ELSE n.version END AS version FROM nodes n WHERE {_type('part')}")
def _apply(s, d):
    g = graph(s, d)
    claims, fields = _dims(s)
    some = compile_filter(g, {"node_ids": ["part:1", "part:2", "part:3"]})
    value = F.coalesce("value_json", F.col("value_number").cast("string"), F.concat(F.lit('"'), F.col("value_text"), F.lit('"')))
    f = g.node_fields.groupBy(F.col("node_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("field_name", value))).alias("fields"))
    t = C.type_lists(g).select(F.col("node_id").alias("id"), "types")
    title = F.when(F.col("id") == "part:3", F.col("title")).otherwise(F.concat("title", F.lit(" (new)")))  # the third is as it was
    p = some.join(f, "id").join(t, "id").select("id", "file_path", title.alias("title"), "body", "types", "fields")
    out, _, _ = W.apply(g, p, claims, fields, table(s, "schemas", [*SCHEMAS, ("economy", "", None, None)]))
    return compile_filter(out, {"types": ["part"]}).select("id", "version")


@query("m07_batch", _PRE + f"SELECT n.id AS id, CASE n.id WHEN 'region:0' THEN 'First' WHEN 'region:1' THEN n.title ELSE n.title END AS title, n.version + CASE n.id WHEN 'region:0' THEN 2 ELSE 0 END AS version FROM nodes n WHERE {_type('region')} AND n.id <> 'region:4'")
def _batch(s, d):
    ops = [{"op": "set_title", "id": "region:0", "title": "First"}, {"op": "set_fields", "id": "region:0", "fields": {"note": ["a", True]}}, {"op": "set_title", "id": "region:1", "title": "Stale"}, {"op": "delete", "id": "region:4"}]
    g, _, _ = W.batch(graph(s, d), ops, {"region:1": 9})
    return compile_filter(g, {"types": ["region"]}).select("id", "title", "version")


@query("m10_undo", _PRE + "SELECT node_id, field_name, coalesce(value_json, CAST(value_number AS VARCHAR), value_date, value_text) AS value FROM node_fields WHERE node_id IN (SELECT node_id FROM node_types WHERE schema_type = 'economy')")
def _undo(s, d):
    g = graph(s, d)
    ids = compile_filter(g, {"types": ["economy"]}).select("id")
    snaps = U.capture(g, ids, "op")
    ops = U.begin(table(s, "undo_operations"), "op", 1, "t", "")
    changed = M.set_fields(g, ids, {"size": 99, "tags": ["gone"], "brand": None, "extra": True})
    back, _ = U.undo(changed, ops, snaps, ["op"])
    return back.node_fields.join(ids, F.col("node_id") == F.col("id"), "left_semi").select("node_id", "field_name", rebuilt().alias("value"))


@query("m11_cleanup", "SELECT event_id AS operation_id FROM events WHERE (epoch_us(ts) // 1000) >= 1704672000000 AND (event_id % 2 = 0 OR (epoch_us(ts) // 1000) >= 1704672000000 + 86400000 - 60000)")
def _cleanup(s, d):
    from .functions.values import millis

    ops = _events(s, d).select(F.col("event_id").alias("operation_id"), millis("ts").alias("timestamp"))
    live, _ = U.cleanup(ops, ops.filter("operation_id % 2 = 0").select("operation_id"), 1704672000000 + 86_400_000)
    return live.select("operation_id")


@query("o09_field_order", _DIMS + """, c AS (SELECT t.node_id, c.field, min(c.sort_order) AS o FROM node_types t JOIN claims c ON c.schema_name = t.schema_type GROUP BY 1, 2)
 SELECT f.node_id AS node_id, string_agg(f.field_name, ',' ORDER BY c.o NULLS LAST, f.field_name) AS names FROM node_fields f LEFT JOIN c ON c.node_id = f.node_id AND c.field = f.field_name WHERE f.node_id LIKE 'order:%' GROUP BY 1""")
def _order(s, d):
    g = graph(s, d)
    mine = lambda df: df.filter(F.col("node_id").startswith("order:"))
    return W.field_order(mine(g.node_fields), mine(g.node_types), table(s, "claims", CLAIMS)).select("node_id", F.array_join("names", ",").alias("names"))


@query("o10_preview_cap", _PRE + f"SELECT n.id AS id, 'brand' AS field FROM nodes n WHERE {_type('part')} ORDER BY n.id LIMIT 20")
def _cap(s, d):
    return W.preview_rows(M.bulk_preview(graph(s, d), {"types": ["part"]}, {"brand": "X"})).select("id", "field")


@query("s04_changes", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'changed' ELSE 'unchanged' END AS action, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'deleted', CAST(count(*) AS BIGINT) FROM part")
def _changes(s, d):
    files = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("file_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.col("doc_id").alias("file_mtime"))
    n = F.regexp_extract("file_path", r"(\d+)\.md$", 1).cast("long")
    known = files.filter(n % 5 != 0).withColumns({"content_hash": F.when(n % 5 == 1, "old").otherwise(F.col("content_hash")), "file_mtime": F.col("file_mtime") - F.when(n % 5 < 3, 1).otherwise(0)})
    gone = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("parts/"), "p_partkey").alias("file_path"), F.lit("h").alias("content_hash"), F.lit(0).cast("long").alias("file_mtime"))
    return MD.changes(files, known.unionByName(gone)).groupBy("action").agg(F.count("*").alias("n"))


@query("x15_list_errors", "SELECT event_id, event_id % 2 = 0 AS ok, CASE WHEN event_id % 2 = 0 THEN 'LIST_ELEMENT_COERCION' END AS code, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS bad FROM events")
def _list_errors(s, d):
    v = F.array(F.lit("1"), F.when(F.col("event_id") % 2 == 0, F.lit(" 2 ")).otherwise(F.col("event_type")))
    r = CO.list_errors(v, "number")
    return _events(s, d).select("event_id", r.alias("r")).select("event_id", "r.ok", "r.code", F.size("r.errors").alias("bad"))


@query("x16_to_string", "SELECT event_id, CAST(event_id AS VARCHAR) AS value, 'NUMBER_TO_STRING' AS code FROM events")
def _to_string(s, d):
    return _events(s, d).select("event_id", CO.to_string(F.col("event_id").cast("double"), "number").alias("r")).select("event_id", "r.value", "r.code")


@query("x11_fuzzy_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') || CASE WHEN event_id % 2 = 0 THEN 'T' || strftime(ts, '%H:%M') ELSE '' END AS value, 'STRING_TO_DATE_FUZZY' AS code FROM events")
def _fuzzy(s, d):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "MMMM d, yyyy 'at' H:mm")).otherwise(F.date_format("ts", "d MMM yyyy"))
    return _events(s, d).select("event_id", CO.to_date_fuzzy(text).alias("r")).select("event_id", "r.value", "r.code")


@query("x19_default_value", "SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M-%S') AS a, strftime(ts, '%Y-%m-%d') AS b, 'plain' AS c FROM events")
def _default(s, d):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    value = lambda t: TP.default_value(F.lit(t), at, F.lit(None).cast("long"), at)
    return _events(s, d).select("event_id", value("$ctime:YYYY/MM/DD HH-mm-ss").alias("a"), value("$mtime").alias("b"), value("plain").alias("c"))


@query("x20_file_name", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'e-' || event_type || ' 2024-01-02.md' END AS name FROM events")
def _file_name(s, d):
    return _events(s, d).select("event_id", TP.file_name("e-{kind} {date}", {"kind": F.when(F.col("event_id") % 2 == 0, F.col("event_type"))}, F.lit("2024-01-02").cast("timestamp")).alias("name"))


@query("z07_claim_shape", "WITH claims AS " + _values(CLAIMS, "schema_name, field, label, description, sort_order, required_override, default_overridden, default_override, enum_override") + """ SELECT schema_name, field, CASE WHEN required_override IS NULL THEN 'inherit' WHEN required_override THEN 'yes' ELSE 'no' END AS required,
 CASE WHEN default_overridden THEN 'override' ELSE 'inherit' END AS default_from, CASE WHEN default_overridden THEN default_override END AS default_value FROM claims""")
def _claim_shape(s, d):
    return UP.claim_shape(table(s, "claims", CLAIMS))


@query("z02_created_at", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id + 5 END AS created_at FROM events")
def _created(s, d):
    return UP.created_at(_events(s, d).select(F.col("event_id").alias("id"), (F.col("event_id") + 5).alias("indexed_at"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("created_at"))).select("id", "created_at")
