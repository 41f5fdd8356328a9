"""Writing nodes: proposals are merged, checked and turned into the next snapshot with its log rows."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, rewrite_links
from ..functions.values import rebuilt
from ..plans.filters import InvalidParams
from ..tables import Graph, cut
from . import coerced as S
from .graph import resolve, tiers
from .keys import Keys, keys

#: Sources whose nodes take the defaults of required fields; the others write again what is there.
DEFAULTING = {"tool", "watcher"}


def unknown_types(types: DataFrame, schemas: DataFrame) -> DataFrame:
    """``schema_type`` values without a schema."""
    return types.select("schema_type").distinct().join(schemas.select(F.col("name").alias("schema_type")), "schema_type", "left_anti")


def log(rows: DataFrame, event: str, at_ms: int, details: Column | None = None) -> DataFrame:
    """Rows for the edits log."""
    return rows.select("node_id", F.lit(at_ms).cast("long").alias("timestamp"), F.lit(event).alias("event_type"), (F.lit(None) if details is None else details).cast("string").alias("details"))


#: Columns of ``nodes`` that a change keeps or sets besides what is proposed.
TIMES = ("content_hash", "file_mtime", "indexed_at", "created_at")


def apply(g: Graph, proposed: DataFrame, claims: DataFrame, fields: DataFrame, schemas: DataFrame, source: str = "tool", at_ms: int = 0) -> tuple[Graph, DataFrame, DataFrame]:
    """The snapshot after whole nodes ``proposed(id, file_path, title, body, types array, fields map<string, JSON>)``, its log
    rows, and the issues found.

    Values are converted to their fields' types; null is the wish to delete, which a required field doesn't grant. Required
    fields that aren't given take their defaults (from a tool or a watcher). A tool's node with an unknown type or any issue
    is refused; other sources may leave required fields out; of a watcher, a bad value gives way to the stored one. A node
    that is as proposed already is left alone: no new version, no log row. Edges of changed nodes are derived again and
    resolved against the nodes after the change; edges of others that point to a new or renamed node follow it.
    Times: ``created_at`` stays, ``file_mtime`` and ``content_hash`` are the proposal's if it has them, else the write's.
    """
    wanted = ["id", "file_path", "title", "body", "types", "fields"]
    brought = [c for c in ("content_hash", "file_mtime") if c in proposed.columns and c in g.nodes.columns]
    times = [c for c in TIMES if c in g.nodes.columns]
    old = Keys(proposed.select("id")).only(g.nodes, "id").select("id", *(F.col(c).alias(f"_{c}") for c in ("version", "file_path", "title", *times)))
    p = cut(proposed.select(*wanted, *brought).join(old, "id", "left"))
    had = lambda c: F.col(f"_{c}") if c in times else F.lit(None).cast("long")
    st = cut(S.coerced_state(p.withColumns({"created_ms": had("created_at"), "modified_ms": had("file_mtime")}), claims, fields, source in DEFAULTING, at_ms))
    bad = S.issue_rows(st)
    types = p.select(F.col("id").alias("node_id"), F.posexplode("types").alias("sort_order", "schema_type"))
    if source != "watcher":
        refused = (bad if source == "tool" else bad.filter("code <> 'REQUIRED_MISSING'")).select(F.col("node_id").alias("id"))
        if source == "tool":
            refused = refused.unionByName(types.join(unknown_types(types, schemas), "schema_type", "left_semi").select(F.col("node_id").alias("id")))
        p = p.join(refused.distinct(), "id", "left_anti")
    ids = cut(p.select("id"))
    child = ids.withColumnRenamed("id", "node_id")
    rows = S.field_rows(st)
    retained = None
    if source == "watcher":
        wrong = bad.select("node_id", F.col("field").alias("field_name"))
        stays = g.node_fields.join(wrong, ["node_id", "field_name"], "left_semi")
        rows = rows.unionByName(stays.select(*rows.columns))
        retained = stays.select("node_id", F.col("field_name").alias("field"), rebuilt().alias("kept"))
    rows = cut(rows.join(child, "node_id", "left_semi"))
    types = types.join(child, "node_id", "left_semi")
    mine = Keys(ids)
    was = state(Graph(mine.only(g.nodes, "id"), mine.only(g.node_types, "node_id"), mine.only(g.node_fields, "node_id"), g.relationships))
    after = state(Graph(p, types, rows, g.relationships))
    changed = cut(after.join(was.select("id", F.col("s").alias("_s")), "id", "left").filter(~F.col("s").eqNullSafe(F.col("_s"))).select("id", F.col("s").alias("_hash")))
    key = changed.select(F.col("id").alias("node_id"))
    new = Keys(key)
    now = F.lit(at_ms).cast("long")
    given = lambda c, other: F.coalesce(F.col(c), other) if c in brought else other
    sets = {"version": F.coalesce(F.col("_version") + 1, F.lit(1)), "content_hash": given("content_hash", F.col("_hash")), "file_mtime": given("file_mtime", now), "indexed_at": now, "created_at": F.coalesce(had("created_at"), now)}
    fresh = cut(p.join(changed, "id").withColumns({c: v for c, v in sets.items() if c in g.nodes.columns}).withColumn("_moved", F.col("_version").isNull() | ~F.col("title").eqNullSafe(F.col("_title")) | ~F.col("file_path").eqNullSafe(F.col("_file_path"))))
    nodes = new.without(g.nodes, "id").unionByName(fresh.select(*(F.col(c) if c in fresh.columns else F.lit(None).cast(t).alias(c) for c, t in g.nodes.dtypes)))
    swap = lambda a, b: new.without(a, "node_id").unionByName(b.join(key, "node_id", "left_semi"), allowMissingColumns=True).select(*a.columns)
    edges = relink(g.relationships, nodes, rows.join(key, "node_id", "left_semi"), fresh, fields)
    logs = S.log_rows(st, source, at_ms, retained).join(key, "node_id", "left_semi")
    return Graph(nodes.select(*g.nodes.columns), swap(g.node_types, types), swap(g.node_fields, rows), edges), logs, bad


def relink(relationships: DataFrame, nodes: DataFrame, rows: DataFrame, fresh: DataFrame, fields: DataFrame) -> DataFrame:
    """Edges after nodes changed: those of ``fresh(id, body, _moved)`` derived from their field ``rows`` and bodies, all
    others as they were but for what points to a moved node."""
    mine = cut(S.edges_of(rows, fresh, fields))
    found = resolve(nodes, mine.select("target")).withColumnRenamed("id", "resolved_target_id")
    mine = mine.join(found, "target", "left")
    mine = cut(mine)
    changed = Keys(fresh.select("id"))
    moved = fresh.filter("_moved").select("id", "title", "file_path")
    if moved.isEmpty():
        rest = changed.without(relationships, "source_id")
    else:
        rest = refresh(relationships, nodes, moved, changed)
    return rest.unionByName(mine, allowMissingColumns=True).select(*relationships.columns)


def state(g: Graph) -> DataFrame:
    """``id, s``: a hash of what a reader sees of each node, equal for equal content."""
    t = g.node_types.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sort_order", "schema_type"))).alias("t")).select("id", F.transform("t", lambda x: x["schema_type"]).alias("t"))
    f = g.node_fields.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("field_name", rebuilt().alias("v")))).alias("f"))
    rows = g.nodes.select("id", "file_path", "title", "body").join(t, "id", "left").join(f, "id", "left")
    return rows.select("id", F.sha2(F.to_json(F.struct("file_path", "title", "body", F.coalesce("t", F.array().cast("array<string>")).alias("t"), "f")), 256).alias("s"))


def keys_of(nodes: DataFrame) -> DataFrame:
    """``id, tier, key``: the five keys under which an edge's raw text finds a node."""
    base = basename("file_path")
    return tiers(nodes, ["id"], [F.col("file_path"), F.col("title"), base, base, base])


def claims_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``target, _found`` of distinct raw ``texts(target)`` that are a key of one of the ``nodes``; the text keeps its ``.md``
    here. The first tier wins, then the smaller id."""
    asked = tiers(texts, ["target"], [F.col("target")] * 5)
    return asked.join(keys_of(nodes), ["tier", "key"]).groupBy("target").agg(F.min_by("id", F.struct("tier", "id")).alias("_found"))


def claim_edges(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unresolved edges whose raw text is a key of one of the new or renamed ``nodes`` point to it. Resolved edges stay as
    they are."""
    found = claims_of(relationships.filter("resolved_target_id is null").select("target").distinct(), nodes)
    return relationships.join(found, "target", "left").withColumn("resolved_target_id", F.coalesce("resolved_target_id", "_found")).select(*relationships.columns)


def rename(g: Graph, node_id: str, title: str, file_path: str | None = None) -> Graph:
    """One node under a new title (and path): fields that hold the old title, alone or in a list, and body links that
    resolve to the node name the new one; edges are resolved anew. Versions of all changed nodes grow."""
    row = g.nodes.filter(F.col("id") == node_id).select("title", "file_path").first()
    if row is None:
        raise InvalidParams(f"no node {node_id}")
    old = row.title
    path = file_path or row.file_path.rpartition("/")[0] + ("/" if "/" in row.file_path else "") + title.translate(str.maketrans("/\\", "--")) + ".md"
    likely = g.relationships.select("source_id", "target").filter(_may_name(row.file_path, old))
    if row.file_path.isascii():
        likely = cut(likely)  # few, and asked for twice
    hits = cut(resolve(g.nodes, likely).filter(F.col("id") == node_id).select("target"))
    sources = Keys(likely.join(hits, "target", "left_semi").select(F.col("source_id").alias("id")).filter(F.col("id") != node_id))
    targets = [r.target for r in hits.collect()]  # spellings of one node's name
    item = F.expr(f"""transform(from_json(value_json, 'array<string>'), x -> CASE WHEN x = {_sql(old)} THEN {_sql(title)} ELSE x END)""")
    is_list = F.col("value_json").startswith("[") & F.array_contains(F.from_json("value_json", "array<string>"), old)
    marked = sources.mark(g.node_fields, "node_id", "_ref")
    hit = F.col("_ref")
    fields = marked.withColumns({"value_text": F.when(hit & (F.col("value_text") == old), title).otherwise(F.col("value_text")), "value_json": F.when(hit & is_list, F.to_json(item)).otherwise(F.col("value_json"))})
    changed = sources.only(g.node_fields, "node_id").filter((F.col("value_text") == old) | is_list).select(F.col("node_id").alias("id"))
    bodies = sources.only(g.nodes, "id").select("id", rewrite_links("body", targets, title).alias("_body"), "body").filter("_body <> body").select("id", "_body")
    bodies = cut(bodies)
    touched = Keys(changed.unionByName(bodies.select("id")))
    me = F.col("id") == node_id
    nodes = touched.mark(touched.add(g.nodes, "id", bodies), "id", "_t")
    nodes = nodes.withColumns({"body": F.coalesce("_body", "body"), "version": F.col("version") + F.col("_t").cast("int") + F.when(me, 1).otherwise(0), "title": F.when(me, title).otherwise(F.col("title")), "file_path": F.when(me, path).otherwise(F.col("file_path"))}).select(*g.nodes.columns)
    # texts of edges follow fields and bodies
    linked = touched.mark(g.relationships, "source_id", "_s")
    mine = F.col("_s") & F.col("target").isin(targets) if targets else F.lit(False)
    edges = linked.withColumn("target", F.when(mine, title).otherwise(F.col("target"))).select(*g.relationships.columns)
    return g.replace(nodes=nodes, node_fields=fields.select(*g.node_fields.columns), relationships=refresh_on_rename(edges, nodes, node_id))


def _may_name(path: str, title: str | None) -> Column:
    """Whether the raw text ``target`` can be a key of the node: all that are, and those beyond ASCII."""
    name = path.rpartition("/")[2].removesuffix(".md")
    target = F.col("target")
    same = target.isin([x for x in (path, title) if x is not None]) | F.lower(target).isin(name.lower(), name.lower() + ".md")
    odd = (F.octet_length(target) != F.char_length(target)) | target.contains("\n") | target.contains("\r")  # a line's end hides .md
    return same | odd if name.isascii() else F.lit(True)


def _sql(s: str) -> str:
    return "'" + (s or "").replace("\\", "\\\\").replace("'", "\\'") + "'"


def refresh(relationships: DataFrame, nodes: DataFrame, moved: DataFrame, but: DataFrame | Keys | None = None) -> DataFrame:
    """Edges to nodes ``moved(id)`` (new, renamed or back again) are resolved anew by their text; what is open then is
    claimed by their present keys, those of ``moved`` if it has title and path. Edges of the sources ``but`` are left
    out.

    Answers are found once a text and joined: the edges themselves are only read, and where no edge is lost or claimed, no more
    than the left-out sources are looked up."""
    moved = cut(moved.distinct())
    here = Keys(moved.select("id"))
    renewed = moved if "file_path" in moved.columns else cut(here.only(nodes, "id").select("id", "title", "file_path"))
    rest = relationships if but is None else keys(but).without(relationships, "source_id")
    marked = here.mark(rest, "resolved_target_id", "_lost")
    texts = cut(marked.filter("_lost or resolved_target_id is null").groupBy("target").agg(F.bool_or("_lost").alias("_asked")))
    claimed = claims_of(texts.select("target"), renewed).withColumnRenamed("_found", "_claimed")
    asked = texts.filter("_asked")
    loses = not asked.isEmpty()
    found = resolve(nodes, asked).withColumnRenamed("id", "_found") if loses else claimed.select("target", F.lit(None).cast("string").alias("_found")).limit(0)
    answers = cut(texts.join(found, "target", "left").join(claimed, "target", "left").select("target", F.coalesce("_found", "_claimed").alias("_found")).filter("_found is not null"))
    if not loses and answers.isEmpty():
        return rest
    open_ = F.col("_lost") | F.col("resolved_target_id").isNull()
    out = Keys(answers).add(marked, "target", answers, open_)
    return out.withColumn("resolved_target_id", F.when(open_, F.col("_found")).otherwise(F.col("resolved_target_id"))).select(*relationships.columns)


def refresh_on_rename(relationships: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """``refresh`` for one node."""
    return refresh(relationships, nodes, nodes.sparkSession.createDataFrame([(node_id,)], "id string"))


#: Kinds of a caller's operations and the columns they fill; fixed values.
KINDS = {"set_fields": "fields", "add_types": "add_types", "remove_types": "remove_types", "set_title": "title", "delete": None}


def batch(g: Graph, ops: list[dict], expected: dict[str, int] | None = None) -> tuple[Graph, list[str], dict[str, int]]:
    """A caller's list of operations, one after another, without a schema; nothing is kept if one can't be read.

    Each is ``{"op": set_fields | add_types | remove_types | delete | set_title, "id": ..., ...}``. An operation on a node
    whose version isn't the expected one is skipped and told, the rest go on. Gives snapshot, skipped ids, counts by kind.
    """
    from . import batch as B
    from ..tables import table

    spark = g.nodes.sparkSession
    names = [c.strip().split(" ")[0] for c in B.OPS.split(", ")]
    rows = []
    for i, o in enumerate(ops):
        if o["op"] not in KINDS:
            raise InvalidParams(f"unknown operation {o['op']}")
        row = dict.fromkeys(names) | {"seq": i, "op": "delete" if o["op"] == "delete" else "update", "id": o["id"], "expected_version": (expected or {}).get(o["id"])}
        if column := KINDS[o["op"]]:
            given = o["types" if column.endswith("types") else column]
            row[column] = {k: json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in given.items()} if column == "fields" else given
        rows.append(tuple(row[n] for n in names))
    none = [table(spark, n) for n in ("claims", "global_fields", "schemas")]
    out = B.run(g, spark.createDataFrame(rows, B.OPS), *none, source="normalizer")
    if bad := out.errors.limit(5).collect():
        raise InvalidParams(", ".join(f"{e.id}: {e.code}" for e in bad))
    stale = {r.id for r in out.status.filter("status = 'stale'").collect()}  # as many as were named
    return out.graph, sorted(o["id"] for o in ops if o["id"] in stale), dict(Counter(o["op"] for o in ops if o["id"] not in stale))


def move(g: Graph, ids: DataFrame, folder: str) -> Graph:
    """The files of the given nodes in another folder, under their names; edges resolve by the new paths when refreshed."""
    mark = ids.select("id", F.lit(1).alias("_m"))
    name = F.element_at(F.split("file_path", "/"), -1)
    to = F.concat(F.lit(folder.strip("/") + "/" if folder.strip("/") else ""), name)
    nodes = g.nodes.join(mark, "id", "left").withColumns({"file_path": F.when(F.col("_m") == 1, to).otherwise(F.col("file_path")), "version": F.col("version") + F.coalesce("_m", F.lit(0))})
    return g.replace(nodes=nodes.select(*g.nodes.columns))


def preview_rows(changes: DataFrame, most: int = 20) -> DataFrame:
    """Changes of the first ``most`` matched nodes (not the first changes), by id."""
    first = changes.select("id").distinct().orderBy("id").limit(most)
    return changes.join(F.broadcast(first), "id", "left_semi")  # ``most`` rows


def next_time(operations: DataFrame, now_ms: int) -> int:
    """A timestamp above all earlier ones."""
    last = operations.agg(F.max("timestamp")).first()[0]
    return max(now_ms, (last or 0) + 1)


def in_order(fields: DataFrame) -> DataFrame:
    """``node_id, names``: each node's fields, claimed ones by order and name, then the others by name.
    ``fields(node_id, field_name, sort_order)`` with a null order for orphans."""
    key = F.struct(F.col("sort_order").isNull().cast("int").alias("o"), "sort_order", "field_name")
    return fields.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["field_name"]).alias("names"))


def field_order(fields: DataFrame, types: DataFrame, claims: DataFrame) -> DataFrame:
    """``in_order`` of ``fields(node_id, field_name)`` of nodes with ``types(node_id, schema_type)``: a field's order is the
    least of its claims by the node's types. Rows are shuffled once, by node; the claims, few, come along as one map."""
    at = lambda t, n: F.concat(t, F.lit("\u0001"), n)
    least = claims.filter("sort_order is not null").groupBy(at(F.col("schema_name"), F.col("field")).alias("k")).agg(F.min("sort_order").alias("o"))
    orders = least.agg(F.map_from_entries(F.collect_list(F.struct("k", "o"))).alias("orders"))  # one row
    claiming = claims.select(F.col("schema_name").alias("schema_type")).distinct()
    none = F.lit(None).cast("string")
    rows = fields.select("node_id", "field_name", none.alias("schema_type")).unionByName(types.join(F.broadcast(claiming), "schema_type", "left_semi").select("node_id", none.alias("field_name"), "schema_type"))
    lists = rows.groupBy("node_id").agg(F.collect_list("field_name").alias("f"), F.collect_list("schema_type").alias("t")).filter("size(f) > 0").crossJoin(F.broadcast(orders))
    order = lambda n: F.array_min(F.transform("t", lambda t: F.try_element_at("orders", at(t, n))))
    keys = F.transform(F.transform("f", lambda n: F.struct(order(n).alias("o"), n.alias("n"))), lambda x: F.struct(x["o"].isNull().cast("int").alias("b"), x["o"].alias("o"), x["n"].alias("n")))
    return lists.select("node_id", F.transform(F.array_sort(keys), lambda x: x["n"]).alias("names"))
