"""One node as a reader asks for it, and edges as lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import kind, rebuilt
from ..plans.filters import InvalidParams
from ..tables import Graph
from .graph import resolve


def find(g: Graph, node_id: str | None = None, file_path: str | None = None, title: str | None = None) -> DataFrame:
    """The row of one node by id, path or title; a title that no node has goes through the resolver. Exactly one is given."""
    if sum(x is not None for x in (node_id, file_path, title)) != 1:
        raise InvalidParams("give one of node_id, file_path and title")
    if node_id is not None:
        return g.nodes.filter(F.col("id") == node_id)
    if file_path is not None:
        return g.nodes.filter(F.col("file_path") == file_path)
    exact = g.nodes.filter(F.col("title") == title).select("id", F.lit(0).alias("o"))
    asked = g.nodes.sparkSession.createDataFrame([(title,)], "target string")
    found = exact.unionByName(resolve(g.nodes, asked).select("id", F.lit(1).alias("o"))).agg(F.min_by("id", F.struct("o", "id")).alias("id"))
    return g.nodes.join(found, "id", "left_semi")


def field_map(g: Graph, ids: DataFrame) -> DataFrame:
    """``id, fields``: name to (value, kind) of the given nodes."""
    rows = g.node_fields.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    entry = F.struct("field_name", F.struct(rebuilt().alias("value"), kind().alias("kind")).alias("v"))
    return rows.groupBy(F.col("node_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))


def edge_lists(g: Graph, ids: DataFrame) -> DataFrame:
    """``id, direction, rel_type, other, name, n``: outgoing edges by raw target, resolved anew (title first, then the
    resolver); incoming ones by the stored id, self edges left out. Equal rows are counted."""
    ids = ids.select("id")
    out = g.relationships.join(ids, F.col("source_id") == F.col("id"), "left_semi").select(F.col("source_id").alias("id"), "rel_type", "target")
    titles = g.nodes.filter("title is not null").groupBy(F.col("title").alias("target")).agg(F.min("id").alias("by_title"))
    wanted = out.select("target").distinct()
    named = wanted.join(titles, "target", "left").join(resolve(g.nodes, wanted).withColumnRenamed("id", "by_rule"), "target", "left")
    out = out.join(named, "target").select("id", F.lit("outgoing").alias("direction"), "rel_type", F.coalesce("by_title", "by_rule").alias("other"), F.col("target").alias("name"))
    into = g.relationships.join(ids, F.col("resolved_target_id") == F.col("id"), "left_semi").filter("source_id <> resolved_target_id")
    into = into.join(g.nodes.select(F.col("id").alias("source_id"), "title"), "source_id").select(F.col("resolved_target_id").alias("id"), F.lit("incoming").alias("direction"), "rel_type", F.col("source_id").alias("other"), F.col("title").alias("name"))
    return out.unionByName(into).groupBy("id", "direction", "rel_type", "other", "name").agg(F.count("*").alias("n"))


def full(g: Graph, node: DataFrame) -> DataFrame:
    """The node's row with types, fields and its edges grouped by relation, each group in order of name."""
    ids = node.select("id")
    types = g.node_types.join(ids, F.col("node_id") == F.col("id"), "left_semi").groupBy(F.col("node_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "schema_type"))), lambda x: x["schema_type"]).alias("types"))
    edges = edge_lists(g, ids)
    by_type = edges.groupBy("id", "direction", "rel_type").agg(F.array_sort(F.collect_list(F.struct("name", "other"))).alias("edges"))
    side = lambda d: by_type.filter(F.col("direction") == d).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel_type", "edges")))).alias(d))
    out = node.join(types, "id", "left").join(field_map(g, ids), "id", "left")
    return out.join(side("outgoing"), "id", "left").join(side("incoming"), "id", "left")


def delete_preview(g: Graph, ids: DataFrame) -> DataFrame:
    """``id, fields, outgoing, incoming``: what a deletion takes along and what it leaves unresolved."""
    ids = ids.select("id")
    f = g.node_fields.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("fields"))
    o = g.relationships.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outgoing"))
    i = g.relationships.filter("resolved_target_id is not null").groupBy(F.col("resolved_target_id").alias("id")).agg(F.count("*").alias("incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ids.join(f, "id", "left").join(o, "id", "left").join(i, "id", "left").select("id", zero("fields"), zero("outgoing"), zero("incoming"))
