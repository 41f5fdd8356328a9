"""Mutations as transformations of snapshots, and their undo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import classify, literal, rebuilt
from ..plans.compiler import compile_filter
from ..plans.filters import InvalidParams
from ..tables import Graph
from .graph import forget
from .keys import Keys, keys

CONFIRM = 1000


def set_fields(g: Graph, ids: DataFrame, values: dict[str, object]) -> Graph:
    """Field values of the given nodes; None removes the field. Children are replaced, versions grow by one."""
    spark = g.nodes.sparkSession
    touched = Keys(ids.select("id"))
    ids = touched.ids.withColumnRenamed("_key", "node_id")
    rows = [(k, *classify(v)) for k, v in values.items() if v is not None]
    new = spark.createDataFrame(rows, "field_name string, value_text string, value_number double, value_date string, value_json string")
    named = F.coalesce(F.col("field_name").isin(list(values)), F.lit(False))  # the other fields' rows need no join
    kept = g.node_fields.filter(~named).unionByName(touched.without(g.node_fields.filter(named), "node_id"))
    fields = kept.unionByName(ids.crossJoin(F.broadcast(new)), allowMissingColumns=True)
    return g.replace(node_fields=fields, nodes=bumped(g.nodes, touched))


def bumped(nodes: DataFrame, ids: DataFrame | Keys) -> DataFrame:
    return keys(ids).mark(nodes, "id", "_one").withColumn("version", F.col("version") + F.col("_one").cast("int")).select(*nodes.columns)


def change_types(g: Graph, ids: DataFrame, add: list[str] = (), remove: list[str] = ()) -> Graph:
    """Types added behind the present ones, or taken away; a type a node has already stays where it is."""
    spark = g.nodes.sparkSession
    ids = ids.select(F.col("id").alias("node_id"))
    t = g.node_types
    if remove:
        gone = ids.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in remove], "schema_type string")))
        t = t.join(gone, ["node_id", "schema_type"], "left_anti")
    if add:
        new = ids.crossJoin(F.broadcast(spark.createDataFrame([(x, 1000 + i) for i, x in enumerate(add)], "schema_type string, sort_order int")))
        t = t.unionByName(new.join(t.select("node_id", "schema_type"), ["node_id", "schema_type"], "left_anti"))
    return g.replace(node_types=t, nodes=bumped(g.nodes, ids))


def delete(g: Graph, ids: DataFrame) -> Graph:
    """Nodes and their children go; edges to them stay, unresolved."""
    gone = Keys(ids.select("id"))
    return Graph(gone.without(g.nodes, "id"), gone.without(g.node_types, "node_id"), gone.without(g.node_fields, "node_id"), forget(gone.without(g.relationships, "source_id"), gone))


def bulk_preview(g: Graph, where: dict, set_to: dict[str, object]) -> DataFrame:
    """``id, field, old, new, changed`` of a bulk update that isn't committed."""
    rows = None
    matched = compile_filter(g, where).select("id")
    for k, v in set_to.items():
        old = g.node_fields.filter(F.col("field_name") == k).select(F.col("node_id").alias("id"), rebuilt().alias("old"))
        part = matched.join(old, "id", "left").select("id", F.lit(k).alias("field"), "old", literal(v).alias("v")).select("id", "field", "old", rebuilt("v").alias("new"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("changed", ~F.col("old").eqNullSafe(F.col("new")))


def bulk_update(g: Graph, where: dict, set_to: dict[str, object], dry_run: bool = True, confirm: bool = False) -> Graph:
    """The snapshot after the update; more than ``CONFIRM`` nodes need ``confirm``. A dry run gives the snapshot unchanged."""
    if dry_run:
        return g
    ids = compile_filter(g, where).select("id")
    if not confirm and ids.limit(CONFIRM + 1).count() > CONFIRM:
        raise InvalidParams(f"more than {CONFIRM} nodes match; confirm is needed")
    return set_fields(g, ids, set_to)


def stale(nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """Ids whose version isn't the expected one."""
    return nodes.join(expected.select("id", F.col("version").alias("_expected")), "id").filter("version != _expected").select("id")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; versions go on from the old row's."""
    versions = old.select(key, F.col("version").alias("_v"))
    fresh = new.drop("version").join(versions, key, "left").withColumn("version", F.coalesce(F.col("_v") + 1, F.lit(1))).select(*old.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(fresh)


def history(operations: DataFrame, status: str = "active", source_tool: str | None = None, since: int | None = None, until: int | None = None, limit: int = 20) -> DataFrame:
    """Operations, the latest first; one more than ``limit`` tells that there are others."""
    if status != "all":
        operations = operations.filter(F.col("status") == status)
    if source_tool:
        operations = operations.filter(F.col("source_tool") == source_tool)
    if since is not None:
        operations = operations.filter(F.col("timestamp") >= since)
    if until is not None:
        operations = operations.filter(F.col("timestamp") <= until)
    return operations.orderBy(F.desc("timestamp"), "operation_id").limit(min(limit, 100) + 1)
