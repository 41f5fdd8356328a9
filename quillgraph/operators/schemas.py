"""Global fields, schemas and their claims: gates, edits, and what an edit does to the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import coerce, dispatch
from ..functions.values import as_json, as_text
from ..plans.filters import InvalidParams
from ..tables import Graph
from . import claims as C
from .write import log

WIDGETS = {"text", "textarea", "number", "date", "bool", "enum", "tags", "link"}
# The widget of a field type where no hint names one; fixed values.
BY_TYPE = {"string": "text", "number": "number", "date": "date", "boolean": "bool", "enum": "enum", "reference": "link", "list": "tags"}
HIDDEN = {"textarea", "tags"}


def list_fields(fields: DataFrame) -> DataFrame:
    return fields.orderBy("name")


def list_schemas(schemas: DataFrame) -> DataFrame:
    return schemas.orderBy("name")


def describe_schema(name: str, claims: DataFrame, fields: DataFrame) -> DataFrame:
    """The schema's claims over their fields: what holds after overrides, and which of them are overrides."""
    c = claims.filter(F.col("schema_name") == name).join(fields, F.col("field") == F.col("name"))
    return c.select("field", "field_type", F.coalesce("label", "field").alias("label"), "sort_order", F.coalesce("required_override", "required").alias("required"),
                    F.when(F.col("default_overridden"), F.col("default_override")).otherwise(F.col("default_value")).alias("default_value"),
                    F.coalesce("enum_override", "enum_values").alias("enum_values"), F.col("required_override").isNotNull().alias("overrides_required"),
                    "default_overridden", F.col("enum_override").isNotNull().alias("overrides_enum"))


def describe_field(g: Graph, name: str, claims: DataFrame, fields: DataFrame) -> DataFrame:
    """The field's definition, the schemas that claim it and the nodes that have it."""
    by = claims.filter(F.col("field") == name).agg(F.array_join(F.sort_array(F.collect_set("schema_name")), ",").alias("claimed_by"))
    n = g.node_fields.filter(F.col("field_name") == name).agg(F.count_distinct("node_id").alias("nodes"))
    return fields.filter(F.col("name") == name).crossJoin(by).crossJoin(n)  # one row each


def wire(fields: DataFrame) -> DataFrame:
    """Definitions as callers see them: ``ui_hints`` is ``ui``."""
    return fields.withColumnRenamed("ui_hints", "ui")


def claim_issues(claims: DataFrame, fields: DataFrame) -> DataFrame:
    """``schema_name, field, code``: claims of unknown fields, overrides that the field forbids, and enum lists for a field
    that is no enum."""
    f = fields.select(F.col("name").alias("field"), "field_type", "ov_required", "ov_default", "ov_enum")
    rows = claims.join(f, "field", "left")
    forbidden = (F.col("required_override").isNotNull() & ~F.col("ov_required")) | (F.col("default_overridden") & ~F.col("ov_default")) | (F.col("enum_override").isNotNull() & ~F.col("ov_enum"))
    code = F.when(F.col("field_type").isNull(), "UNKNOWN_FIELD").when(F.col("enum_override").isNotNull() & (F.col("field_type") != "enum"), "STRUCTURAL_INCOMPAT").when(forbidden, "OVERRIDE_NOT_ALLOWED")
    return rows.select("schema_name", "field", code.alias("code")).filter("code is not null")


def edit_claims(claims: DataFrame, schema: str, add: DataFrame | None = None, update: DataFrame | None = None, remove: list[str] = (), replace: DataFrame | None = None) -> DataFrame:
    """The claims after an edit of one schema: either all are replaced, or some are added, updated and removed."""
    if replace is not None and (add is not None or update is not None or remove):
        raise InvalidParams("replace all claims, or name those to add, update and remove")
    others = claims.filter(F.col("schema_name") != schema)
    if replace is not None:
        return others.unionByName(replace)
    mine = claims.filter(F.col("schema_name") == schema)
    if remove:
        mine = mine.filter(~F.col("field").isin(list(remove)))
    for new in (update, add):
        if new is not None:
            mine = mine.join(new.select("field"), "field", "left_anti").select(*claims.columns).unionByName(new)
    return others.unionByName(mine)


def orphaned_by(g: Graph, before: DataFrame, after: DataFrame) -> DataFrame:
    """``field_name, n``: field rows that a claim covers before and none after; an edit that has any needs a confirmation.
    The most frequent first."""
    # a field whose claims all stay loses no row; of the others, rows and claims meet in one aggregate by node and field
    dropped = before.join(after, ["schema_name", "field"], "left_anti").select(F.col("field").alias("field_name")).distinct()
    claim = lambda c, **by: c.select(F.col("schema_name").alias("schema_type"), F.col("field").alias("field_name"), *(F.lit(v).alias(k) for k, v in by.items()))
    claims = claim(before, was=True, now=False).unionByName(claim(after, was=False, now=True)).join(dropped, "field_name", "left_semi").groupBy("schema_type", "field_name").agg(F.bool_or("was").alias("was"), F.bool_or("now").alias("now"))
    covers = g.node_types.join(F.broadcast(claims), "schema_type").filter("node_id is not null").select("node_id", "field_name", F.lit(0).alias("n"), "was", "now")
    have = g.node_fields.join(F.broadcast(dropped), "field_name", "left_semi").select("node_id", "field_name", F.lit(1).alias("n"), F.lit(False).alias("was"), F.lit(False).alias("now"))
    met = have.unionByName(covers).groupBy("node_id", "field_name").agg(F.sum("n").alias("n"), F.bool_or("was").alias("was"), F.bool_or("now").alias("now"))
    return met.filter("n > 0 and was and not now").groupBy("field_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "field_name")


def propagate(g: Graph, before: DataFrame, after: DataFrame, fields: DataFrame, at_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """Field rows to add (defaults of required fields that the edit made claimed) and log rows (defaulted, orphaned)."""
    lists = C.type_lists(g)
    keys = lists.select("key", "types").distinct()
    was = C.merge_claims(keys, before, fields).select("key", "field")
    now = C.merge_claims(keys, after, fields)
    new = now.join(was, ["key", "field"], "left_anti").filter("required and default_value is not null").select("key", F.col("field").alias("field_name"), "default_value")
    from ..functions.values import classified

    want = lists.select("node_id", "key").join(new, "key").select("node_id", "field_name", "default_value")
    add = want.join(g.node_fields.select("node_id", "field_name"), ["node_id", "field_name"], "left_anti").select("node_id", "field_name", *classified(F.col("default_value")))
    gone = was.join(now.select("key", "field"), ["key", "field"], "left_anti").select("key", F.col("field").alias("field_name"))
    lost = lists.select("node_id", "key").join(gone, "key").join(g.node_fields.select("node_id", "field_name"), ["node_id", "field_name"], "left_semi")
    return add, log(add, "field-defaulted", at_ms, F.col("field_name")).unionByName(log(lost, "fields-orphaned", at_ms, F.col("field_name")))


def retype_preview(g: Graph, name: str, kind: str, enum_values: list[str] | None = None, item: str | None = None) -> DataFrame:
    """``node_id, old, ok, value, code, reason`` of every row of a field if its type became ``kind``, a list with elements of
    type ``item`` among them (its values are JSON)."""
    if kind == "list":
        values = F.array(*map(F.lit, enum_values)) if enum_values else F.lit(None).cast("array<string>")
        rows = g.node_fields.filter(F.col("field_name") == name).select("node_id", as_text().alias("old"), dispatch(as_json(), F.lit("list"), F.lit(item).cast("string"), values).alias("_r"))
        return rows.select("node_id", "old", "_r.ok", "_r.value", "_r.code", "_r.reason")
    rows = g.node_fields.filter(F.col("field_name") == name).select("node_id", as_text().alias("old"))
    return rows.withColumn("_r", coerce(F.col("old"), kind, enum_values)).select("node_id", "old", "_r.ok", "_r.value", "_r.code", "_r.reason")


def retype(g: Graph, name: str, kind: str, enum_values: list[str] | None = None, discard: bool = False, at_ms: int = 0, item: str | None = None) -> tuple[Graph, DataFrame]:
    """The field with its new type, and the log rows of values that couldn't be converted; those go if ``discard`` is
    given, else the change is refused."""
    seen = retype_preview(g, name, kind, enum_values, item)
    bad = seen.filter("not ok")
    if not discard and not bad.isEmpty():
        raise InvalidParams(f"values of {name} can't become {kind}; discard is needed")
    good = seen.filter("ok")
    none = F.lit(None)
    number, in_json = kind == "number", kind in ("boolean", "list")
    new = good.select("node_id", F.lit(name).alias("field_name"), (none if number or in_json else F.col("value")).cast("string").alias("value_text"), (F.col("value") if number else none).cast("double").alias("value_number"),
                      none.cast("string").alias("value_date"), (F.col("value") if in_json else none).cast("string").alias("value_json"))
    rest = g.node_fields.filter(F.col("field_name") != name)
    return g.replace(node_fields=rest.unionByName(new, allowMissingColumns=True)), log(bad, "value-removed", at_ms, F.col("old"))


def rename_field(g: Graph, claims: DataFrame, fields: DataFrame, old: str, new: str) -> tuple[Graph, DataFrame, DataFrame]:
    """A global field under another name, in rows, edges and claims."""
    swap = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    again = lambda df, c: df.withColumn(c, swap(c))
    return g.replace(node_fields=again(g.node_fields, "field_name"), relationships=again(g.relationships, "rel_type")), again(claims, "field"), again(fields, "name")


def delete_field(claims: DataFrame, fields: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """A global field and its claims go; values of nodes stay as orphans."""
    return claims.filter(F.col("field") != name), fields.filter(F.col("name") != name)


def delete_schema(claims: DataFrame, schemas: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    return claims.filter(F.col("schema_name") != name), schemas.filter(F.col("name") != name)


def folders(g: Graph, schemas: DataFrame) -> DataFrame:
    """``node_id, folder``: the default folder of each node's first type, empty without one."""
    first = g.node_types.groupBy("node_id").agg(F.min_by("schema_type", F.struct("sort_order", "schema_type")).alias("name"))
    return first.join(schemas.select("name", "default_directory"), "name", "left").select("node_id", F.coalesce("default_directory", F.lit("")).alias("folder"))


def widget(field_type: str, hint: str | None = None) -> str:
    """How a form shows a field."""
    if hint is not None and hint not in WIDGETS:
        raise InvalidParams(f"unknown widget {hint}")
    return hint or BY_TYPE.get(field_type, "text")


def check_hints(hints: dict) -> list[str]:
    """What is wrong with a field's form hints."""
    out = [f"unknown hint {k}" for k in sorted(set(hints) - {"widget", "label", "help", "order"})]
    if hints.get("widget") is not None and hints["widget"] not in WIDGETS:
        out.append(f"unknown widget {hints['widget']}")
    return out + [f"{k} is longer than {n}" for k, n in (("label", 80), ("help", 280)) if len(hints.get(k) or "") > n]


def columns(fields: list[dict]) -> list[str]:
    """Columns that a table shows at first: the title, and every field but long texts, tags and lists of references."""
    shown = [f["name"] for f in fields if widget(f["field_type"], f.get("widget")) not in HIDDEN and not (f["field_type"] == "list" and f.get("list_item_type") == "reference")]
    return ["title", *shown]
