"""Schema claims merged over a node's types, and validation against them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import dispatch, let
from ..functions.text import closest_of
from ..functions.values import as_json, declared_kind, rebuilt
from ..tables import Graph


def merge_claims(type_lists: DataFrame, claims: DataFrame, fields: DataFrame) -> DataFrame:
    """Effective fields of each distinct ordered type list (``key string, types array<string>``).

    Label, description: the first that is given in type order; order: the first that isn't 1000. Required and default:
    the override if all overriding types agree, else the global value. ``enum_lists``: for each claiming type its override
    or the global values, null where no type overrides. Claims of unknown fields are skipped.
    """
    t = type_lists.select("key", F.posexplode("types").alias("o", "schema_name"))
    rows = t.join(claims, "schema_name").join(fields, F.col("field") == F.col("name"))
    first = lambda c, when=None: F.min_by(c, F.when(F.col(c).isNotNull() if when is None else when, F.col("o")))
    d = F.when(F.col("default_overridden"), F.coalesce("default_override", F.lit("null")))
    by_type = F.array_sort(F.collect_list(F.struct("o", F.coalesce("enum_override", "enum_values", F.array()).alias("values"))))
    out = rows.groupBy("key", "field").agg(
        first("label").alias("label"), first("description").alias("description"),
        F.coalesce(first("sort_order", F.col("sort_order") != 1000), F.lit(1000)).alias("sort_order"),
        F.count_distinct("required_override").alias("nr"), F.max("required_override").alias("r"), F.first("required").alias("required"),
        F.count_distinct(d).alias("nd"), F.max(d).alias("d"), F.first("default_value").alias("default_value"),
        F.when(F.bool_or(F.col("enum_override").isNotNull()), F.transform(by_type, lambda x: x["values"])).alias("enum_lists"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "schema_name"))), lambda x: x["schema_name"]), ",").alias("claiming_types"))
    return out.select("key", "field", "label", "description", "sort_order", F.when(F.col("nr") == 1, F.col("r")).otherwise(F.col("required")).alias("required"),
                      F.when(F.col("nd") == 1, F.when(F.col("d") != "null", F.col("d"))).otherwise(F.col("default_value")).alias("default_value"),
                      F.when(F.col("nd") == 1, "claim").otherwise("global").alias("default_source"), "claiming_types", "enum_lists")


def type_lists(g: Graph) -> DataFrame:
    """``node_id, key, types`` in sort order; ``key`` names the list."""
    t = g.node_types.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "schema_type"))).alias("t")).select("node_id", F.transform("t", lambda x: x["schema_type"]).alias("types"))
    return t.select("node_id", F.array_join("types", "\u0001").alias("key"), "types")


def conformance(g: Graph, claims: DataFrame, fields: DataFrame) -> DataFrame:
    """``node_id, field, state``: claimed, orphan, unfilled or unfilled-required; merged once per distinct type list."""
    lists = type_lists(g)
    effective = merge_claims(lists.select("key", "types").distinct(), claims, fields).select("key", "field", "required")
    want = lists.select("node_id", "key").join(effective, "key").select("node_id", "field", "required")
    have = g.node_fields.select("node_id", F.col("field_name").alias("field"), F.lit(1).alias("h"))
    state = F.when(F.col("h").isNotNull() & F.col("required").isNotNull(), "claimed").when(F.col("h").isNotNull(), "orphan").when(F.col("required"), "unfilled-required").otherwise("unfilled")
    return want.join(have, ["node_id", "field"], "full").select("node_id", "field", state.alias("state"))


def issues(g: Graph, claims: DataFrame, fields: DataFrame) -> DataFrame:
    """``node_id, field, code, value`` of stored values: TYPE_MISMATCH, ENUM_MISMATCH, LIST_ITEM_COERCION_FAILED or
    REQUIRED_MISSING (no value and no default). A value that the list of any claiming type takes is valid.

    A value of its field's type needs no conversion, and an enum's only a look at the lists; all others go through the rules of
    ``dispatch``.
    """
    lists = type_lists(g)
    kinds = fields.select(F.col("name").alias("field"), "field_type", "enum_values", "list_item_type")
    effective = merge_claims(lists.select("key", "types").distinct(), claims, fields).join(kinds, "field")
    claimed = lists.select("node_id", "key").join(effective, "key")
    have = g.node_fields.select("node_id", F.col("field_name").alias("field"), rebuilt().alias("value"), as_json().alias("json"), declared_kind().alias("kind"), F.lit(1).alias("h"))
    rows = claimed.join(have, ["node_id", "field"], "left").withColumn("lists", F.coalesce("enum_lists", F.array("enum_values")))
    same = ((F.col("field_type") == F.col("kind")) & (F.col("kind") != "list")) | ((F.col("field_type") == "reference") & (F.col("kind") == "string"))
    listed = F.coalesce(F.exists("lists", lambda v: F.exists(v, lambda x: F.lower(x) == F.lower(F.trim("value")))), F.lit(False))
    judged = F.when(same, None).when(F.col("field_type") == "enum", F.when(~listed, "ENUM_MISMATCH")).otherwise(_judged(g.nodes.sparkSession.sparkContext.applicationId))
    code = F.when(F.col("h").isNull(), F.when(F.col("required") & F.col("default_value").isNull(), "REQUIRED_MISSING")).otherwise(judged)
    return rows.select("node_id", "field", code.alias("code"), "value").filter("code is not null")


@lru_cache(maxsize=4)
def _judged(application: str) -> Column:
    """What is wrong with ``json`` as a value of its field; the expression is large, so each application makes it once."""
    tries = F.transform("lists", lambda v: dispatch(F.col("json"), F.col("field_type"), F.col("list_item_type"), v))
    picked = let(tries, lambda t: F.coalesce(F.get(F.filter(t, lambda r: r["ok"]), 0), F.element_at(t, -1)))
    enum = F.col("enum_lists").isNotNull() | (F.col("field_type") == "enum")
    return let(picked, lambda r: F.when(~r["ok"], F.when(enum | (F.size(r["closest"]) > 0), "ENUM_MISMATCH").when(r["errors"].isNotNull(), "LIST_ITEM_COERCION_FAILED").otherwise("TYPE_MISMATCH")))


def issue_groups(found: DataFrame, samples: int = 5) -> DataFrame:
    """Issues counted by (reason, field), with the smallest node ids as samples. The reason of an enum mismatch is
    ENUM_INVALID, that of any failed conversion TYPE_MISMATCH; other codes have none and are left out."""
    found = found.withColumn("code", reason("code")).filter("code is not null")
    w = Window.partitionBy("code", "field").orderBy("node_id")
    few = found.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= samples).groupBy("code", "field").agg(F.array_join(F.sort_array(F.collect_list("node_id")), ",").alias("samples"))
    return found.groupBy("code", "field").agg(F.count("*").alias("n")).join(few, ["code", "field"])


def reason(code: str) -> Column:
    """The reason under which an issue is grouped."""
    c = F.col(code)
    return F.when(c == "ENUM_MISMATCH", "ENUM_INVALID").when(c.isin("TYPE_MISMATCH", "COERCION_FAILED", "LIST_ITEM_COERCION_FAILED"), "TYPE_MISMATCH").when(c == "REQUIRED_MISSING", c)


def invalid_values(found: DataFrame) -> DataFrame:
    """``field, value, n``: how often each value outside its enum stands, to be read by falling ``n``."""
    return found.filter("code = 'ENUM_MISMATCH'").groupBy("field", "value").agg(F.count("*").alias("n"))


def fixable(found: DataFrame, effective: DataFrame, fields: DataFrame) -> DataFrame:
    """``node_id, field, suggestion, allowed, field_type, sort_order`` of the issues a caller can mend without asking: a
    near enum value or the list, a default, or the kind of a missing boolean, reference or enum.

    ``found`` as of ``issues`` with the ``key`` of the node's type list, ``effective`` as of ``merge_claims``."""
    kinds = fields.select(F.col("name").alias("field"), "field_type", "enum_values")
    e = effective.select("key", "field", "sort_order", "default_value", "enum_lists").join(kinds, "field")
    rows = found.join(e, ["key", "field"])
    lists = F.array_distinct(F.coalesce(F.flatten("enum_lists"), F.col("enum_values")))
    enum = F.col("code") == "ENUM_MISMATCH"
    missing = F.col("code") == "REQUIRED_MISSING"
    near = F.get(closest_of(F.trim("value"), lists), 0)
    default = F.when(missing, F.col("default_value"))
    suggestion = F.when(enum, near).otherwise(default)
    allowed = F.when(suggestion.isNull() & (enum | (missing & (F.col("field_type") == "enum"))), lists)
    kind = F.when(missing & suggestion.isNull() & F.col("field_type").isin("boolean", "reference"), F.col("field_type"))
    out = rows.select("node_id", "field", suggestion.alias("suggestion"), allowed.alias("allowed"), kind.alias("field_type"), "sort_order")
    return out.filter("suggestion is not null or allowed is not null or field_type is not null")


def claim_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``schema_name, field, change`` between two claim tables: added, removed, changed."""
    cols = ["label", "description", "sort_order", "required_override", "default_overridden", "default_override", "enum_override"]
    a = before.select("schema_name", "field", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("a"))
    b = after.select("schema_name", "field", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, ["schema_name", "field"], "full").select("schema_name", "field", change.alias("change")).filter("change is not null")
