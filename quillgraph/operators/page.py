"""Pages of a result: order, limit, and what is joined on afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import rebuilt
from ..plans.compiler import compile_filter
from ..plans.filters import NodeFilter, Page
from ..tables import Graph


def page(g: Graph, f: NodeFilter | dict, p: Page | None = None, body: bool = False) -> DataFrame:
    """The rows of one page, with their bodies if asked for; equal keys are in order of id, nulls are lowest. Bodies are joined
    to the page, so that no sort carries them."""
    p = p or Page()
    col = F.col("_sort")
    order = col.asc_nulls_first() if p.sort_order == "asc" else col.desc_nulls_last()
    rows = compile_filter(g, f).select("id", "file_path", "title", "version", F.col(p.sort_by).alias("_sort"))
    rows = rows.orderBy(order, "id").offset(p.offset).limit(p.limit).drop("_sort")
    return rows.join(g.nodes.select("id", "body"), "id") if body else rows


def enrich(g: Graph, rows: DataFrame, include_fields: list[str] | None = None) -> DataFrame:
    """Types, number of fields and chosen fields (``['*']``: all) of a page's rows; joined after the limit."""
    ids = rows.select(F.col("id").alias("node_id"))  # of a page Spark knows that it is small
    types = g.node_types.join(ids, "node_id", "left_semi").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "schema_type"))).alias("t")).select(F.col("node_id").alias("id"), F.transform("t", lambda x: x["schema_type"]).alias("types"))
    fields = g.node_fields.join(ids, "node_id", "left_semi")
    counts = fields.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("field_count"))
    out = rows.join(types, "id", "left").join(counts, "id", "left").withColumn("field_count", F.coalesce("field_count", F.lit(0)))
    if include_fields:
        some = fields if include_fields == ["*"] else fields.filter(F.col("field_name").isin(include_fields))
        maps = some.groupBy(F.col("node_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", rebuilt().alias("v"))))).alias("fields"))
        out = out.join(maps, "id", "left")
    return out


def total(g: Graph, f: NodeFilter | dict) -> DataFrame:
    return compile_filter(g, f).agg(F.count("*").alias("total"))


def edges_by_type(g: Graph, ids: DataFrame) -> DataFrame:
    """``id, direction, rel_type, n`` of the edges of some nodes; self edges don't count as incoming."""
    ids = ids.select("id")
    out = g.relationships.select(F.col("source_id").alias("id"), F.lit("outgoing").alias("direction"), "rel_type")
    into = g.relationships.filter("resolved_target_id is not null and source_id != resolved_target_id").select(F.col("resolved_target_id").alias("id"), F.lit("incoming").alias("direction"), "rel_type")
    return out.unionByName(into).join(ids, "id", "left_semi").groupBy("id", "direction", "rel_type").agg(F.count("*").alias("n"))
