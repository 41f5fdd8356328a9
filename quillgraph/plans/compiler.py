"""Node filters as DataFrame plans: semi and anti joins, which keep each node once, so no DISTINCT is needed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text, like_ci
from ..functions.values import comparable
from ..operators.graph import resolve
from ..tables import Graph
from .filters import InvalidParams, JoinFilter, NodeFilter

FUSE = 3  # from so many fields on, one grouped pass over the fields replaces a join each


def field_condition(ops: dict) -> Column:
    """The test of one field row; several operators hold together."""
    out = F.lit(True)
    for op, v in ops.items():
        col = comparable(v) if op in ("eq", "ne", "gt", "gte", "lt", "lte") else None
        if op == "eq":
            out &= col == F.lit(v)
        elif op == "ne":
            out &= col != F.lit(v)
        elif op == "gt":
            out &= col > F.lit(v)
        elif op == "gte":
            out &= col >= F.lit(v)
        elif op == "lt":
            out &= col < F.lit(v)
        elif op == "lte":
            out &= col <= F.lit(v)
        elif op == "contains":
            out &= like_ci("value_text", f"%{v}%") | like_ci("value_json", f"%{v}%")
        elif op == "includes":
            out &= includes(v)
        elif op == "one_of":
            first = v[0]
            out &= (F.col("value_number") if isinstance(first, (int, float)) and not isinstance(first, bool) else F.col("value_text")).isin(v)
    return out


def includes(v: object) -> Column:
    """Membership in a JSON list; a scalar counts as a list of one, ``true`` as 1."""
    j = F.trim("value_json")
    items = F.when(j.startswith("["), F.from_json(j, "array<string>")).when(j.startswith("{"), F.map_values(F.from_json(j, "map<string,string>"))).otherwise(F.from_json(F.concat(F.lit("["), j, F.lit("]")), "array<string>"))
    if isinstance(v, bool):
        v = int(v)
    if isinstance(v, (int, float)):
        numbers = F.transform(items, lambda x: F.when(x == "true", 1.0).when(x == "false", 0.0).otherwise(x.try_cast("double")))
        return F.coalesce(F.array_contains(numbers, F.lit(float(v))), F.lit(False))
    return F.coalesce(F.array_contains(items, F.lit(v)), F.lit(False))


def _having(g: Graph, nodes: DataFrame, fields: dict[str, dict]) -> DataFrame:
    present = {k: ops for k, ops in fields.items() if ops.get("exists") is not False}
    for k in set(fields) - set(present):
        nodes = _without(nodes, g.node_fields.filter(F.col("field_name") == k).select("node_id"))
    tests = {k: field_condition({o: v for o, v in ops.items() if o != "exists"}) for k, ops in present.items()}
    if len(tests) >= FUSE:
        rows = g.node_fields.filter(F.col("field_name").isin(list(tests)))
        flags = rows.groupBy("node_id").agg(*(F.max(F.when((F.col("field_name") == k) & t, 1)).alias(f"f{i}") for i, (k, t) in enumerate(tests.items())))
        return _with(nodes, flags.filter(" AND ".join(f"f{i} = 1" for i in range(len(tests)))).select("node_id"))
    for k, t in tests.items():
        nodes = _with(nodes, g.node_fields.filter((F.col("field_name") == k) & t).select("node_id"))
    return nodes


def _with(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.toDF("_id"), F.col("id") == F.col("_id"), "left_semi")


def _without(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.toDF("_id"), F.col("id") == F.col("_id"), "left_anti")


def _joined(g: Graph, j: JoinFilter) -> DataFrame:
    """Ids of the outer side of the edges that the join filter accepts; unresolved edges are no edges."""
    outer, inner = ("source_id", "resolved_target_id") if j.direction == "outgoing" else ("resolved_target_id", "source_id")
    edges = g.relationships.filter(F.col("resolved_target_id").isNotNull())
    if j.rel_type:
        edges = edges.filter(F.col("rel_type").isin([j.rel_type] if isinstance(j.rel_type, str) else list(j.rel_type)))
    if j.target:
        found = compile_filter(g, j.target).select(F.col("id").alias("_inner"))
        edges = edges.join(found, F.col(inner) == F.col("_inner"), "left_semi")
    return edges.select(outer)


def _references(g: Graph, nodes: DataFrame, ref: dict) -> DataFrame:
    """Outgoing compares raw text, incoming the id that the text resolves to; both are tests of edges *from* the node."""
    edges = g.relationships
    if ref.get("rel_type"):
        edges = edges.filter(F.col("rel_type") == ref["rel_type"])
    direction = ref.get("direction", "outgoing")
    if direction not in ("outgoing", "incoming", "both"):
        raise InvalidParams(f"direction {direction}")
    if direction != "incoming":
        nodes = _with(nodes, edges.filter(F.col("target") == ref["target"]).select("source_id"))
    if direction != "outgoing":
        wanted = g.nodes.sparkSession.createDataFrame([(ref["target"],)], "target string")
        found = resolve(g.nodes, wanted).select(F.col("id").alias("_target"))
        nodes = _with(nodes, edges.join(F.broadcast(found), F.col("resolved_target_id") == F.col("_target"), "left_semi").select("source_id"))
    return nodes


def compile_filter(g: Graph, f: NodeFilter | dict) -> DataFrame:
    """The nodes that the filter accepts, with the columns of ``nodes``."""
    f = NodeFilter.parse(f) if isinstance(f, dict) else f
    n = g.nodes
    if f.node_ids:
        n = n.filter(F.col("id").isin(f.node_ids))
    if f.without_node_ids:
        n = n.filter(~F.col("id").isin(f.without_node_ids))
    if f.title_eq is not None:
        n = n.filter(fold("title") == fold_text(f.title_eq))
    if f.title_contains is not None:
        n = n.filter(like_ci("title", f"%{f.title_contains}%"))
    if f.without_titles:
        n = n.filter(~fold("title").isin([fold_text(t) for t in f.without_titles]))
    if f.path_prefix is not None:
        n = n.filter(like_ci("file_path", f.path_prefix + "%"))
    if f.without_path_prefix is not None:
        n = n.filter(~like_ci("file_path", f.without_path_prefix + "%"))
    if f.path_dir is not None:
        top = f.path_dir.strip("/") in ("", ".")
        n = n.filter(~F.col("file_path").like("%/%")) if top else n.filter(like_ci("file_path", f.path_dir.rstrip("/") + "/%") & ~like_ci("file_path", f.path_dir.rstrip("/") + "/%/%"))
    if f.modified_since is not None:
        when = dt.datetime.fromisoformat(f.modified_since.replace("Z", "+00:00"))
        when = when.replace(tzinfo=dt.timezone.utc) if when.tzinfo is None else when
        n = n.filter(F.col("file_mtime") >= int(when.timestamp() * 1000))
    for t in f.types or []:
        n = _with(n, g.node_types.filter(F.col("schema_type") == t).select("node_id"))
    if f.without_types:
        n = _without(n, g.node_types.filter(F.col("schema_type").isin(f.without_types)).select("node_id"))
    n = _having(g, n, f.fields)
    if f.without_fields:
        n = _without(n, g.node_fields.filter(F.col("field_name").isin(f.without_fields)).select("node_id"))
    if f.references:
        n = _references(g, n, f.references)
    for j in f.join_filters:
        n = _with(n, _joined(g, j))
    for j in f.without_joins:
        n = _without(n, _joined(g, j))
    return n
