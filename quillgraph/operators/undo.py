"""Operations, what they changed, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TABLES
from ..tables import Graph, cut
from .graph import forget, resolve
from .keys import Keys
from .write import refresh, state

HOUR = 3_600_000
_VALUES = ("field_name", "value_text", "value_number", "value_date", "value_json")


def begin(operations: DataFrame, operation_id: str, at_ms: int, tool: str, description: str) -> DataFrame:
    row = operations.sparkSession.createDataFrame([(operation_id, at_ms, tool, description, 0, "active")], operations.schema)
    return operations.unionByName(row)


def finish(operations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Operations with the number of nodes each touched; those that touched none go."""
    n = snapshots.groupBy("operation_id").agg(F.count("*").cast("int").alias("_n"))
    return operations.join(n, "operation_id").withColumn("node_count", F.col("_n")).select(*operations.columns)


def _of(g: Graph, ids: DataFrame) -> Graph:
    """The rows of some nodes in all four tables."""
    own = Keys(ids.select("id"))
    return Graph(own.only(g.nodes, "id"), own.only(g.node_types, "node_id"), own.only(g.node_fields, "node_id"), own.only(g.relationships, "source_id"))


def capture(g: Graph, ids: DataFrame, operation_id: str) -> DataFrame:
    """The whole present state of nodes, before an operation changes them: row, types, fields, outgoing edges, times.

    A node that isn't there yet is marked ``was_deleted``: the way back is to delete it; ``ids`` may bring its future
    ``file_path``. Values keep the column they are stored in.
    """
    mine = _of(g, ids)
    own = lambda df, key, name, *cols: df.groupBy(F.col(key).alias("node_id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    text = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    t = own(mine.node_types, "node_id", "types", "sort_order", "schema_type")
    f = own(mine.node_fields, "node_id", "fields", *_VALUES)
    e = own(mine.relationships, "source_id", "edges", "target", "rel_type", text(mine.relationships, "context"), "resolved_target_id")
    n = mine.nodes.select(F.col("id").alias("node_id"), F.col("file_path").alias("_path"), "title", "body", *(F.col(c) if c in g.nodes.columns else F.lit(None).cast("long").alias(c) for c in ("file_mtime", "created_at")), "version")
    rows = ids.select(F.col("id").alias("node_id"), text(ids, "file_path")).join(n, "node_id", "left").join(t, "node_id", "left").join(f, "node_id", "left").join(e, "node_id", "left")
    was_deleted = F.col("version").isNull()
    out = rows.withColumns({"operation_id": F.lit(operation_id), "file_path": F.coalesce("_path", "file_path"), "was_deleted": was_deleted, "post_mutation_hash": F.lit(None).cast("string")})
    empty = table_like(g.nodes.sparkSession)
    return out.select(*(F.col(c).cast(k).alias(c) for c, k in empty.dtypes))


def table_like(spark) -> DataFrame:
    return spark.createDataFrame([], TABLES["undo_snapshots"])


def committed(g: Graph, snapshots: DataFrame, operation_id: str) -> DataFrame:
    """Snapshots with the hash of what the operation left of each of its nodes; null for a node that is gone."""
    mine = F.col("operation_id") == operation_id
    ids = snapshots.filter(mine).select(F.col("node_id").alias("id"))
    now = state(_of(g, ids)).select(F.col("id").alias("node_id"), F.col("s").alias("_hash"))
    out = snapshots.filter(mine).join(now, "node_id", "left").withColumn("post_mutation_hash", F.col("_hash")).select(*snapshots.columns)
    return snapshots.filter(~mine).unionByName(out)


def conflicts(g: Graph, operations: DataFrame, snapshots: DataFrame, ids: list[str]) -> DataFrame:
    """``operation_id, node_id, reason`` of what stands against undoing the operations ``ids`` together.

    ``path_occupied``: the node is gone and another has its path. ``modified_after_operation``: it isn't as the operation
    left it. ``superseded_by_later_op``: an active operation outside the call touched it later. What an operation created
    has no conflict.
    """
    mine = snapshots.filter(F.col("operation_id").isin(ids) & ~F.col("was_deleted"))
    when = operations.select("operation_id", F.col("timestamp").alias("_t"), "status")
    mine = mine.join(when.select("operation_id", "_t"), "operation_id").select("operation_id", "node_id", "file_path", "post_mutation_hash", "_t")
    others = snapshots.filter(~F.col("operation_id").isin(ids)).join(when.filter("status = 'active'"), "operation_id").groupBy("node_id").agg(F.max("_t").alias("_last"))
    now = state(_of(g, mine.select(F.col("node_id").alias("id")).distinct())).select(F.col("id").alias("node_id"), F.col("s").alias("_now"))
    mine = cut(mine.join(now, "node_id", "left").join(others, "node_id", "left"))
    taken = Keys(mine.filter("_now is null").select("file_path")).only(g.nodes, "file_path").select("file_path", F.lit(True).alias("_taken")).distinct()
    mine = mine.join(taken, "file_path", "left")
    occupied = F.col("_now").isNull() & F.coalesce("_taken", F.lit(False))
    drifted = F.col("_now").isNotNull() & F.col("post_mutation_hash").isNotNull() & (F.col("_now") != F.col("post_mutation_hash"))
    later = ~occupied & (F.col("_last") > F.col("_t"))
    reasons = F.filter(F.array(F.when(occupied, "path_occupied"), F.when(drifted, "modified_after_operation"), F.when(later, "superseded_by_later_op")), lambda x: x.isNotNull())
    return mine.select("operation_id", "node_id", F.explode(reasons).alias("reason"))


def earliest(snapshots: DataFrame, ids: list[str], operations: DataFrame) -> DataFrame:
    """The state each node had before the first of the operations, by partial minima."""
    mine = snapshots.join(operations.filter(F.col("operation_id").isin(ids)).select("operation_id", "timestamp"), "operation_id")
    first = mine.groupBy("node_id").agg(F.min_by(F.struct(*[c for c in snapshots.columns if c != "node_id"]), F.struct("timestamp", "operation_id")).alias("r"))
    return first.select("node_id", "r.*")


def _rows(snapshots: DataFrame, name: str) -> DataFrame:
    return snapshots.select("node_id", F.explode(name).alias("s")).select("node_id", "s.*")


def undo(g: Graph, operations: DataFrame, snapshots: DataFrame, ids: list[str], revert: bool | list[str] = False) -> tuple[Graph, DataFrame]:
    """The snapshot as it was before the given operations, in all four tables, and the operations with their new status.

    One overlay for all of them: a node that several touched takes the state before the earliest. Nodes with a conflict stay
    as they are, unless ``revert`` is true or names them. What an operation created goes; versions grow. Edges of a node come
    back with what they pointed to, if that is there, else they are resolved anew; edges of others that point to a node that
    is back, or has its old name again, follow it.
    """
    snapshots = cut(snapshots)  # the state before, whatever the tables hold now
    rows = earliest(snapshots, ids, operations)
    if revert is not True:
        against = conflicts(g, operations, snapshots, ids).select("node_id").distinct()
        against = against.filter(~F.col("node_id").isin(list(revert))) if revert else against
        rows = rows.join(against, "node_id", "left_anti")
    rows = cut(rows)
    now = g.nodes.select(F.col("id").alias("node_id"), F.col("version").alias("_v"), F.col("title").alias("_t"), F.col("file_path").alias("_p"))
    gone = Keys(rows.select("node_id"))
    rows = cut(rows.join(gone.only(now, "node_id"), "node_id", "left"))
    made = rows.filter("was_deleted").select(F.col("node_id").alias("id"))
    back = rows.filter("not was_deleted")
    fresh = back.select(F.col("node_id").alias("id"), "file_path", "title", "body", "file_mtime", "created_at", (F.greatest(F.coalesce("_v", F.lit(0)), F.col("version")) + 1).alias("version"))
    if "content_hash" in g.nodes.columns:
        content = Graph(fresh, _rows(back, "types"), _rows(back, "fields"), g.relationships)
        fresh = fresh.join(state(content).withColumnRenamed("s", "content_hash"), "id")
    fresh = cut(fresh)
    kept = gone.without(g.nodes, "id")
    nodes = kept.unionByName(fresh.select(*(c for c in fresh.columns if c in g.nodes.columns)), allowMissingColumns=True).select(*g.nodes.columns)
    swap = lambda a, b: gone.without(a, "node_id").unionByName(b, allowMissingColumns=True).select(*a.columns)
    mine = _rows(back, "edges").withColumnRenamed("node_id", "source_id")
    mine = cut(mine)
    there = Keys(mine.select("resolved_target_id")).only(nodes.select(F.col("id").alias("resolved_target_id")), "resolved_target_id").withColumn("_there", F.lit(True))
    mine = cut(mine.join(there, "resolved_target_id", "left").withColumn("resolved_target_id", F.when(F.col("_there"), F.col("resolved_target_id"))))
    anew = resolve(nodes, mine.filter("resolved_target_id is null").select("target")).withColumnRenamed("id", "_found")
    mine = cut(mine.join(anew, "target", "left").withColumn("resolved_target_id", F.coalesce("resolved_target_id", "_found")))
    rest = forget(gone.without(g.relationships, "source_id"), made)
    moved = back.filter("_v is null or not (title <=> _t) or not (file_path <=> _p)").select(F.col("node_id").alias("id"))
    if not moved.isEmpty():
        rest = refresh(rest, nodes, moved)
    edges = rest.unionByName(mine.select(*(c for c in mine.columns if c in g.relationships.columns)), allowMissingColumns=True).select(*g.relationships.columns)
    status = F.when(F.col("operation_id").isin(ids), "undone").otherwise(F.col("status"))
    return Graph(nodes, swap(g.node_types, _rows(back, "types")), swap(g.node_fields, _rows(back, "fields")), edges), operations.withColumn("status", status)


def undo_with(g: Graph, dims: dict[str, tuple[DataFrame, str]], operations: DataFrame, snapshots: DataFrame, held: DataFrame, ids: list[str], revert: bool | list[str] = False) -> tuple[Graph, dict[str, DataFrame], DataFrame]:
    """``undo`` for operations that changed schemas, claims or global fields too. ``dims``: a table and its key by kind;
    ``held(operation_id, kind, name, row)``: their rows before (a null row: there was none), of which the earliest counts.
    Dimensions come back first, then nodes."""
    first = held.join(operations.filter(F.col("operation_id").isin(ids)).select("operation_id", "timestamp"), "operation_id")
    order = first.groupBy("kind", "name").agg(F.min(F.struct("timestamp", "operation_id")).alias("o"))
    first = cut(first.join(order, ["kind", "name"]).filter("operation_id = o.operation_id").select("kind", "name", "row"))
    out = {}
    for kind, (rows, key) in dims.items():
        mine = first.filter(F.col("kind") == kind)
        old = mine.filter("row is not null").select(F.from_json("row", rows.schema).alias("r")).select("r.*")
        out[kind] = rows.join(mine.select(F.col("name").alias(key)).distinct(), key, "left_anti").select(*rows.columns).unionByName(old.select(*rows.columns))
    g, operations = undo(g, operations, snapshots, ids, revert)
    return g, out, operations


def cleanup(operations: DataFrame, snapshots: DataFrame, now_ms: int, hours: int = 24, grace_ms: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """Operations older than ``hours`` go, and so do those without snapshots after a grace; snapshots follow them."""
    have = snapshots.select("operation_id").distinct().withColumn("_s", F.lit(1))
    live = operations.filter(F.col("timestamp") >= now_ms - hours * HOUR).join(have, "operation_id", "left")
    live = live.filter(F.col("_s").isNotNull() | (F.col("timestamp") >= now_ms - grace_ms)).select(*operations.columns)
    return live, snapshots.join(live.select("operation_id"), "operation_id", "left_semi")


def capture_rows(table: DataFrame, key: str, names: list[str], operation_id: str) -> DataFrame:
    """Rows of a dimension (schemas, claims, global fields) before they change, as JSON by key."""
    return table.filter(F.col(key).isin(names)).select(F.lit(operation_id).alias("operation_id"), F.col(key).alias("name"), F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("row"))


def put_back(table: DataFrame, key: str, held: DataFrame, names: list[str]) -> DataFrame:
    """A dimension with the named rows as they were held; a name without a held row was new and goes."""
    old = held.select(F.from_json("row", table.schema).alias("r")).select("r.*")
    return table.filter(~F.col(key).isin(names)).unionByName(old.select(*table.columns))
