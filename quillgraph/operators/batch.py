"""Many operations as one plan, and the making of new nodes.

Operations are rows. Those of a node are folded in their order into one overlay, the overlays become whole proposed nodes, and
one run of the write pipeline takes them all; the plan is the same for one operation and for a million.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import plain
from ..functions.text import sanitize_filename
from ..functions.values import as_json
from ..tables import Graph, cut
from . import mutate as M
from . import write as W

OPS = "seq long, op string, id string, title string, directory string, types array<string>, add_types array<string>, remove_types array<string>, fields map<string,string>, body string, append string, expected_version int"


@dataclass
class Result:
    """``status(id, status, version)``: applied, unchanged or stale nodes. ``errors(id, code, field)``: if there are any, the
    graph is the one that was given."""

    graph: Graph
    status: DataFrame
    errors: DataFrame
    log: DataFrame


def whole_nodes(g: Graph, ids: DataFrame) -> DataFrame:
    """Nodes as the write pipeline takes them: ``id, file_path, title, body, types, fields`` (a map of JSON)."""
    child = ids.select(F.col("id").alias("node_id"))
    f = g.node_fields.join(child, "node_id", "left_semi").groupBy(F.col("node_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("field_name", as_json().alias("v")))).alias("fields"))
    t = g.node_types.join(child, "node_id", "left_semi").groupBy(F.col("node_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "schema_type"))), lambda x: x["schema_type"]).alias("types"))
    rows = g.nodes.join(ids.select("id"), "id", "left_semi").select("id", "file_path", "title", "body", "version").join(f, "id", "left").join(t, "id", "left")
    return rows.withColumns({"types": F.coalesce("types", F.array().cast("array<string>")), "fields": F.coalesce("fields", F.create_map().cast("map<string,string>"))})


def fold(ops: DataFrame) -> DataFrame:
    """``id, ops`` and what they come to: each node's operations in their order, folded once."""
    cols = [c for c in ops.columns if c != "id"]
    in_order = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    rows = ops.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*cols)), in_order).alias("ops"))  # as many as name the node
    every = F.col("ops")
    named = lambda c: F.filter(every, lambda o: o[c].isNotNull())
    return rows.withColumns({
        "made": F.exists(every, lambda o: o["op"] == "create"), "gone": F.exists(every, lambda o: o["op"] == "delete"), "n": F.size(every), "expected": F.get(named("expected_version"), 0)["expected_version"],
        "new_title": F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(named("title"), lambda o: o["title"])), -1), "directory": F.get(named("directory"), 0)["directory"]})


def _types(start: Column) -> Column:
    """Types after the operations: set, then added behind, then taken away."""
    none = F.array().cast("array<string>")

    def step(acc: Column, o: Column) -> Column:
        base = F.coalesce(o["types"], acc)
        return F.array_except(F.array_union(base, F.coalesce(o["add_types"], none)), F.coalesce(o["remove_types"], none))

    return F.aggregate("ops", start, step)


def _body(start: Column) -> Column:
    """A body that is set replaces what was there; one that is appended follows an empty line."""

    def step(acc: Column, o: Column) -> Column:
        more = F.when(F.coalesce(acc, F.lit("")) == "", o["append"]).otherwise(F.concat(acc, F.lit("\n\n"), o["append"]))
        return F.when(o["append"].isNotNull(), more).otherwise(F.coalesce(o["body"], acc))

    return F.aggregate("ops", start, step)


def _fields(start: Column) -> Column:
    """The last value given of each field, over those that are there; null stays as the wish to delete."""
    none = F.create_map().cast("map<string,string>")

    def step(acc: Column, o: Column) -> Column:
        new = F.transform_values(F.coalesce(o["fields"], none), lambda k, v: F.coalesce(v, F.lit("null")))
        return F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(new, k)), new)

    return F.aggregate("ops", start, step)


def _refused(rows: DataFrame) -> DataFrame:
    """``id, code, field`` of overlays that can't be: unknown operations, a node that isn't there or is there already,
    operations behind a deletion, a body both set and appended."""
    first, last, there = F.get("ops", 0)["op"], F.element_at("ops", -1)["op"], F.col("version").isNotNull()
    some = lambda test: F.exists("ops", test)
    behind = F.size(F.filter("ops", lambda o: o["op"] == "delete")) > F.when(last == "delete", 1).otherwise(0)
    again = F.exists(F.slice("ops", 2, F.greatest(F.size("ops"), F.lit(1))), lambda o: o["op"] == "create")
    code = (F.when(some(lambda o: ~o["op"].isin("create", "update", "delete")), "UNKNOWN_OP").when((first == "create") & there, "ID_TAKEN").when((first != "create") & ~there, "NOT_FOUND")
            .when(behind | again, "OUT_OF_ORDER").when(some(lambda o: o["body"].isNotNull() & o["append"].isNotNull()), "BODY_SET_AND_APPENDED").when((first == "create") & F.col("new_title").isNull(), "NO_TITLE"))
    return rows.select("id", code.alias("code"), F.lit(None).cast("string").alias("field")).filter("code is not null")


def folder_of(asked: DataFrame, schemas: DataFrame) -> DataFrame:
    """``asked(id, types, directory)`` with ``folder``: the one asked for, else the first type's; and ``template``."""
    s = schemas.select(F.col("name").alias("_first"), F.col("default_directory").alias("_folder"), F.col("filename_template").alias("template"))
    rows = asked.withColumn("_first", F.get("types", 0)).join(s, "_first", "left")
    return rows.withColumn("folder", F.coalesce("directory", "_folder", F.lit(""))).drop("_first")


def taken(g: Graph, paths: DataFrame) -> DataFrame:
    """``id, code`` of new nodes ``paths(id, file_path)`` whose path a node has, or another new one with a smaller id."""
    old = paths.join(g.nodes.select("file_path"), "file_path", "left_semi").select("id")
    first = paths.groupBy("file_path").agg(F.min("id").alias("_low"))
    twice = paths.join(first, "file_path").filter("id <> _low").select("id")
    return old.unionByName(twice).distinct().withColumn("code", F.lit("PATH_TAKEN"))


def run(g: Graph, ops: DataFrame, claims: DataFrame, fields: DataFrame, schemas: DataFrame, source: str = "tool", at_ms: int = 0) -> Result:
    """The graph after ``ops`` (columns of ``OPS``), all of them or none.

    A node whose version isn't the expected one is stale: it is left out and told, the others go on. Anything else that is
    wrong, an operation, a type without a schema or a value, refuses the whole batch. A node's version grows by its number of
    operations if they change it at all.
    """
    folded = fold(ops)
    rows = cut(folded.join(whole_nodes(g, folded.select("id")), "id", "left"))
    stale = F.col("version").isNotNull() & F.col("expected").isNotNull() & (F.col("version") != F.col("expected"))
    live = rows.filter(~F.coalesce(stale, F.lit(False)))
    errors = _refused(live)
    empty, none = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    kept = live.filter("not gone")
    p = kept.select("id", F.coalesce("file_path", F.lit(None).cast("string")).alias("file_path"), F.coalesce("new_title", "title").alias("title"), _body(F.col("body")).alias("body"), _types(F.coalesce("types", empty)).alias("types"), _fields(F.coalesce("fields", none)).alias("fields"), "made", "directory", "n")
    p = folder_of(p, schemas)
    name = F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat(F.regexp_replace("folder", "/+$", ""), F.lit("/"))), sanitize_filename(F.col("title")), F.lit(".md"))
    p = cut(p.withColumn("file_path", F.when(F.col("made"), name).otherwise(F.col("file_path"))))
    errors = errors.unionByName(taken(g, p.filter("made and file_path is not null").select("id", "file_path")).select("id", "code", F.lit(None).cast("string").alias("field")))
    out, log, bad = W.apply(g, p.select("id", "file_path", "title", "body", "types", "fields"), claims, fields, schemas, source, at_ms)
    errors = errors.unionByName(bad.select(F.col("node_id").alias("id"), "code", "field"))
    if source == "tool":
        t = p.select("id", F.explode("types").alias("schema_type"))
        errors = errors.unionByName(t.join(W.unknown_types(t, schemas), "schema_type", "left_semi").select("id", F.lit("UNKNOWN_TYPE").alias("code"), F.col("schema_type").alias("field")))
    errors = cut(errors)
    late = rows.filter(stale).select("id", F.lit("stale").alias("status"), "version")
    if not errors.isEmpty():
        return Result(g, late, errors, log.limit(0))
    # the snapshot stays a plan over the given graph and what the operations wrote: nodes that none names are only read
    counts = cut(p.select("id", "n").join(rows.select("id", F.col("version").alias("_was")), "id", "left"))
    grown = F.when(F.col("n").isNotNull() & ~F.col("version").eqNullSafe(F.col("_was")), F.col("version") + F.col("n") - 1).otherwise(F.col("version"))
    nodes = out.nodes.join(counts, "id", "left").withColumn("version", grown).select(*g.nodes.columns)
    status = cut(out.nodes.select("id", "version").join(counts, "id").select("id", F.when(F.col("version").eqNullSafe(F.col("_was")), "unchanged").otherwise("applied").alias("status"), grown.alias("version")))
    out = M.delete(out.replace(nodes=nodes), cut(live.filter("gone and version is not null").select("id")))
    deleted = live.filter("gone").select("id", F.lit("applied").alias("status"), F.lit(None).cast("int").alias("version"))
    return Result(out, status.unionByName(deleted).unionByName(late), errors, log)


def created(g: Graph, asked: DataFrame, schemas: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Whole nodes of ``asked(id, title, types, directory, override, fields, body)`` with their paths, and ``id, code`` of those
    that can't be: DIRECTORY_FIXED (the type has a folder and ``override`` isn't given), TEMPLATE_UNRESOLVED, PATH_TAKEN,
    BAD_PATH.

    The first type's template names the file: ``{title}``, ``{date}`` (``today``) and text fields; without one the title does.
    """
    rows = folder_of(asked, schemas)
    texts = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: v.startswith('"') & ~k.isin("title", "date"))
    values = F.map_concat(F.transform_values(texts, lambda k, v: plain(v)), F.create_map(F.lit("title"), F.col("title"), F.lit("date"), F.lit(today)))
    asked_for = F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1))
    filled = F.aggregate(asked_for, F.col("template"), lambda acc, n: F.replace(acc, F.concat(F.lit("{"), n, F.lit("}")), F.try_element_at(values, n)))
    name = F.when(F.col("template").isNull(), F.concat("title", F.lit(".md"))).otherwise(filled)
    path = F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat(F.regexp_replace("folder", "/+$", ""), F.lit("/"))), sanitize_filename(name))
    rows = cut(rows.withColumn("file_path", path))
    fixed = F.col("directory").isNotNull() & F.col("_folder").isNotNull() & (F.col("directory") != F.col("_folder")) & ~F.coalesce("override", F.lit(False))
    outside = F.exists(F.split("file_path", "/"), lambda s: s == "..") | F.col("file_path").startswith("/")
    code = F.when(fixed, "DIRECTORY_FIXED").when(F.col("file_path").isNull(), "TEMPLATE_UNRESOLVED").when(outside, "BAD_PATH")
    errors = rows.select("id", code.alias("code")).filter("code is not null").unionByName(taken(g, rows.filter("file_path is not null").select("id", "file_path")))
    errors = cut(errors)
    good = rows.join(errors.select("id").distinct(), "id", "left_anti")
    return good.select("id", "file_path", "title", F.coalesce("body", F.lit("")).alias("body"), "types", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields")), errors
