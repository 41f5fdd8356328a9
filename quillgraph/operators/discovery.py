"""What is in the graph: histograms, coverage, orphans, inferred types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import as_text, declared_kind, kind, rebuilt
from ..tables import Graph


def type_counts(g: Graph) -> DataFrame:
    return g.node_types.groupBy("schema_type").agg(F.count("*").alias("n"))


def types_with_schemas(g: Graph, claims: DataFrame) -> DataFrame:
    """Types in use or declared, whether they have a schema and how many fields it claims."""
    claimed = claims.groupBy(F.col("schema_name").alias("schema_type")).agg(F.count("*").alias("claim_count"))
    return type_counts(g).join(claimed, "schema_type", "full").select("schema_type", F.coalesce("n", F.lit(0)).alias("n"), F.col("claim_count").isNotNull().alias("has_schema"), F.coalesce("claim_count", F.lit(0)).alias("claim_count"))


def stats(g: Graph) -> DataFrame:
    """One row of totals; each is a one-row aggregate."""
    a = g.nodes.agg(F.count("*").alias("nodes"), F.sum(F.coalesce(F.length("title"), F.lit(0)) + F.coalesce(F.length("body"), F.lit(0))).cast("long").alias("text_chars"))
    b = g.node_fields.agg(F.count_distinct("field_name").alias("field_names"), F.count("*").alias("field_rows"))
    c = g.relationships.agg(F.count("*").alias("edges"), F.count_if(F.col("resolved_target_id").isNull()).alias("unresolved"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def claimed_rows(g: Graph, claims: DataFrame) -> DataFrame:
    """(node_id, field_name) pairs that some type of the node claims."""
    return g.node_types.join(claims.select(F.col("schema_name").alias("schema_type"), F.col("field").alias("field_name")), "schema_type").select("node_id", "field_name")


def orphans(g: Graph, claims: DataFrame) -> DataFrame:
    """Field rows that no type of their node claims."""
    return g.node_fields.join(claimed_rows(g, claims), ["node_id", "field_name"], "left_anti")


def orphan_counts(g: Graph, claims: DataFrame) -> DataFrame:
    return orphans(g, claims).groupBy("field_name").agg(F.count("*").alias("n"))


def orphan_names_by_type(g: Graph, claims: DataFrame) -> DataFrame:
    return orphans(g, claims).join(g.node_types, "node_id").groupBy("schema_type", "field_name").agg(F.count("*").alias("n"))


def coverage(g: Graph, claims: DataFrame) -> DataFrame:
    """For each claim: nodes of the type, and how many of them have the field."""
    nodes = type_counts(g).withColumnRenamed("n", "nodes")
    have = claimed_rows_with_value(g, claims).groupBy("schema_type", "field_name").agg(F.count("*").alias("filled"))
    all_ = claims.select(F.col("schema_name").alias("schema_type"), F.col("field").alias("field_name"))
    return all_.join(nodes, "schema_type", "left").join(have, ["schema_type", "field_name"], "left").select("schema_type", "field_name", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("filled", F.lit(0)).alias("filled"))


def claimed_rows_with_value(g: Graph, claims: DataFrame) -> DataFrame:
    wanted = claims.select(F.col("schema_name").alias("schema_type"), F.col("field").alias("field_name"))
    return g.node_types.join(wanted, "schema_type").join(g.node_fields.select("node_id", "field_name"), ["node_id", "field_name"])


def field_values(g: Graph, name: str, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Histogram of a field's values; a node counts once for each of the given types it has."""
    rows = g.node_fields.filter(F.col("field_name") == name)
    if types:
        rows = rows.join(g.node_types.filter(F.col("schema_type").isin(types)).select("node_id"), "node_id")
    out = rows.groupBy(as_text().alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(limit) if limit else out


def field_totals(g: Graph, name: str) -> DataFrame:
    return g.node_fields.filter(F.col("field_name") == name).agg(F.count("*").alias("total"), F.count_distinct(as_text()).alias("distinct_values"))


def infer_type(g: Graph, name: str) -> DataFrame:
    """Proposed type, confidence and distribution of one field; equal counts are in order of the type's name.

    Few distinct strings make an enum: at least 5 strings, at most 10 values, at most 0.3 of all rows.
    """
    rows = g.node_fields.filter(F.col("field_name") == name).withColumn("kind", declared_kind())
    kinds = rows.groupBy("kind").agg(F.count("*").alias("n"))
    top = kinds.agg(F.max_by("kind", F.struct(F.col("n"), F.col("kind"))).alias("dominant"), F.max("n").alias("top"), F.sum("n").alias("total"))
    distinct = rows.agg(F.count_distinct(as_text()).alias("distinct_values"))
    enum = (F.col("dominant") == "string") & (F.col("top") >= 5) & (F.col("distinct_values") <= 10) & (F.col("distinct_values") / F.col("total") <= 0.3)
    return top.crossJoin(distinct).select(F.when(enum, "enum").otherwise(F.col("dominant")).alias("proposed_type"), (F.col("top") / F.col("total")).alias("confidence"), "distinct_values", "total")


def field_kinds(g: Graph, name: str) -> DataFrame:
    """``kind, n``: how often each kind of value stands in a field."""
    return g.node_fields.filter(F.col("field_name") == name).groupBy(declared_kind().alias("kind")).agg(F.count("*").alias("n"))


def field_samples(g: Graph, name: str, most: int = 10) -> DataFrame:
    """``value, kind``: the first different values of a field by their first node."""
    rows = g.node_fields.filter(F.col("field_name") == name).groupBy(declared_kind().alias("kind"), rebuilt().alias("value")).agg(F.min("node_id").alias("_first"))
    return rows.orderBy("_first", "value").limit(most).select("value", "kind")


def dissenters(g: Graph, name: str, most: int = 10) -> DataFrame:
    """Rows whose kind isn't the commonest, at most ``most`` of a kind."""
    rows = g.node_fields.filter(F.col("field_name") == name).select("node_id", declared_kind().alias("kind"), rebuilt().alias("value"))
    top = rows.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max_by("kind", F.struct("n", "kind")).alias("top"))
    others = rows.join(F.broadcast(top), F.col("kind") != F.col("top"))  # one row
    return others.withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy("node_id"))).filter(F.col("i") <= most).select("node_id", "kind", "value")


def field_usage(g: Graph, claims: DataFrame) -> DataFrame:
    """For each field: nodes that have it, types that claim it, nodes where it is an orphan."""
    used = g.node_fields.groupBy("field_name").agg(F.count_distinct("node_id").alias("nodes"))
    by = claims.groupBy(F.col("field").alias("field_name")).agg(F.array_join(F.sort_array(F.collect_set("schema_name")), ",").alias("claimed_by"))
    lost = orphans(g, claims).groupBy("field_name").agg(F.count_distinct("node_id").alias("orphan_nodes"))
    return used.join(by, "field_name", "left").join(lost, "field_name", "left").select("field_name", "nodes", F.coalesce("claimed_by", F.lit("")).alias("claimed_by"), F.coalesce("orphan_nodes", F.lit(0)).alias("orphan_nodes"))


def unresolved(g: Graph) -> DataFrame:
    return g.relationships.filter("resolved_target_id is null").groupBy("rel_type").agg(F.count("*").alias("n"))


def storage_kinds(g: Graph) -> DataFrame:
    return g.node_fields.groupBy("field_name", kind().alias("kind")).agg(F.count("*").alias("n"))


def sync_log(log: DataFrame, since_ms: int | None = None, file_path: str | None = None, source: str | None = None, events: list[str] | None = None, order: str = "desc", limit: int = 100) -> DataFrame:
    """Log rows by time and id; ``limit`` is at most 1000."""
    if since_ms is not None:
        log = log.filter(F.col("timestamp") >= since_ms)
    if file_path is not None:
        log = log.filter(F.col("file_path") == file_path)
    if source is not None:
        log = log.filter(F.col("source") == source)
    if events:
        log = log.filter(F.col("event").isin(events))
    up = order == "asc"
    return log.orderBy(F.col("timestamp").asc() if up else F.col("timestamp").desc(), F.col("id").asc() if up else F.col("id").desc()).limit(min(limit, 1000))


def sort_orders(node_types: DataFrame) -> DataFrame:
    """Sort orders from 0 within a node for types without one, in the order of the given ones, then by name."""
    return node_types.withColumn("sort_order", F.row_number().over(Window.partitionBy("node_id").orderBy("sort_order", "schema_type")) - 1)
