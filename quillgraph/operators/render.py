"""Nodes as markdown texts, and which files must be written again, as one plan without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import json_items, json_number, plain, quoted
from ..functions.values import as_json
from ..tables import Graph
from . import claims as C

# What a plain scalar may not hold, begin or end with; and what would be read as something else.
SPECIAL = r"""[:#\[\]{}"']|^[-?&*!|>%@`]|^\s|\s$|\n"""
OTHER = r"^(?:|~|null|true|false|[+-]?[0-9]+|[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"


def _scalar(json: Column, reference: Column) -> Column:
    """A value as it stands behind its key: links in brackets, texts bare where that reads back as the same text."""
    text = plain(json)
    string = json.startswith('"')
    bare = ~text.rlike(SPECIAL) & ~text.rlike(OTHER)
    number = json.rlike(r"^-?[0-9]")
    return (F.when(string & reference, F.concat(F.lit('"[['), text, F.lit(']]"'))).when(string & bare, text).when(string, quoted(text))
            .when(number, json_number(json.try_cast("double"))).otherwise(json))


def _entry(name: Column, json: Column, reference: Column) -> Column:
    items = F.transform(json_items(json), lambda x: F.concat(F.lit("\n  - "), _scalar(x, reference)))
    return F.concat(name, F.lit(":"), F.when(json.startswith("["), F.array_join(items, "")).otherwise(F.concat(F.lit(" "), _scalar(json, reference))))


def rendered(g: Graph, claims: DataFrame, fields: DataFrame) -> DataFrame:
    """``id, text`` of every node: types, claimed fields by order and name, other fields by name, body.

    Orders come from the claims merged once per type list; a node's lines meet in one row."""
    lists = C.type_lists(g)
    order = C.merge_claims(lists.select("key", "types").distinct(), claims, fields).select("key", F.col("field").alias("field_name"), "sort_order")
    kinds = fields.select(F.col("name").alias("field_name"), ((F.col("field_type") == "reference") | ((F.col("field_type") == "list") & F.coalesce(F.col("list_item_type") == "reference", F.lit(False)))).alias("ref"))
    rows = g.node_fields.select("node_id", "field_name", as_json().alias("json")).join(lists.select("node_id", "key"), "node_id", "left").join(order, ["key", "field_name"], "left").join(kinds, "field_name", "left")
    line = _entry(F.col("field_name"), F.col("json"), F.coalesce("ref", F.lit(False)))
    each = F.struct(F.col("sort_order").isNull().alias("orphan"), "sort_order", "field_name", line.alias("line"))
    lines = rows.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: F.concat(F.lit("\n"), x["line"])), "").alias("lines"))
    head = F.concat(F.lit("types:"), F.array_join(F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.concat(F.lit("\n  - "), t)), ""))
    rows = g.nodes.select(F.col("id").alias("node_id"), "body").join(lists.select("node_id", "types"), "node_id", "left").join(lines, "node_id", "left")
    text = F.concat(F.lit("---\n"), head, F.coalesce("lines", F.lit("")), F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    return rows.select(F.col("node_id").alias("id"), text.alias("text"))


def to_rewrite(g: Graph, claims: DataFrame, fields: DataFrame, now_ms: int, quiet_minutes: int = 60) -> DataFrame:
    """``id, file_path, text`` of the files whose content isn't what their node says, but for those changed lately."""
    old = g.nodes.filter(F.col("file_mtime") < now_ms - quiet_minutes * 60_000).select("id", "file_path", "content_hash")
    rows = rendered(g, claims, fields).join(old, "id")
    return rows.filter(~F.sha2("text", 256).eqNullSafe(F.col("content_hash"))).select("id", "file_path", "text")
