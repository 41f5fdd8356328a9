"""The coerced state of proposed nodes: one table from which field rows, log rows and issues are read."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import dispatch, let, plain, quoted
from ..functions.templates import default_value
from ..functions.text import closest_of, links_in
from ..functions.values import classified
from ..tables import cut
from .claims import merge_claims

#: What a proposal without a value may still say: nothing (the key is absent) or null, which is the wish to delete.
STATE = "node_id, field, origin, value, original, changed, code, issue, reason, closest, errors, default_source, types"


def effective(type_lists: DataFrame, claims: DataFrame, fields: DataFrame) -> DataFrame:
    """``key, eff`` for each distinct type list: a map from field to its merged claims and definition."""
    kinds = fields.select(F.col("name").alias("field"), "field_type", "list_item_type", "enum_values")
    rows = merge_claims(type_lists, claims, fields).join(kinds, "field")
    e = F.struct("required", "default_value", "default_source", "field_type", "list_item_type", "enum_values", "enum_lists")
    return rows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", e.alias("e")))).alias("eff"))  # as many entries as a type list claims


def _state(n: Column, given: Column, eff: Column, defaults: bool, times: tuple[Column, Column, Column]) -> Column:
    """The state of field ``n`` of one node."""
    kinds = {"field": "string", "origin": "string", "value": "string", "original": "string", "changed": "boolean", "code": "string", "issue": "string", "reason": "string", "closest": "string", "errors": "array<struct<index:int,value:string,reason:string>>", "default_source": "string"}

    def out(**x) -> Column:
        x = {"field": n, "changed": False, **x}
        lit = lambda c: c if isinstance(c, Column) else F.lit(c)
        return F.struct(*(lit(x.get(k)).cast(t).alias(k) for k, t in kinds.items()))

    def rule(b: Column) -> Column:
        e, v, has = b["e"], b["v"], b["has"]
        missing = F.when(e["required"], "REQUIRED_MISSING")
        text = plain(e["default_value"])
        token = e["default_value"].startswith('"$')
        default = F.when(token, quoted(default_value(text, *times))).otherwise(e["default_value"])
        use = e["required"] & e["default_value"].isNotNull() & F.lit(defaults)

        def judged(r: Column) -> Column:
            per_type = e["enum_lists"].isNotNull()
            issue = F.when(~r["ok"], F.when(per_type | (e["field_type"] == "enum") | (F.size(r["closest"]) > 0), "ENUM_MISMATCH").when(r["errors"].isNotNull(), "LIST_ITEM_COERCION_FAILED").otherwise("TYPE_MISMATCH"))
            every = F.array_distinct(F.coalesce(F.flatten(e["enum_lists"]), e["enum_values"]))
            near = F.when(issue == "ENUM_MISMATCH", F.get(closest_of(F.trim(plain(v)), every), 0))
            return out(origin="provided", value=r["value"], original=v, changed=r["changed"], code=r["code"], issue=issue, reason=r["reason"], closest=near, errors=r["errors"])

        # each claiming type's list in turn; the first that takes the value, else what the last one says
        lists = F.coalesce(e["enum_lists"], F.array(e["enum_values"]))
        tries = F.transform(lists, lambda l: dispatch(v, e["field_type"], e["list_item_type"], l))
        picked = let(tries, lambda t: F.coalesce(F.get(F.filter(t, lambda r: r["ok"]), 0), F.element_at(t, -1)))
        return (F.when(e.isNull(), out(origin="orphan", value=v, original=v)).when(has & v.isNull(), out(origin="null", issue=missing, reason=F.when(e["required"], "a required field can't be null")))
                .when(~has & use, out(origin="defaulted", value=default, default_source=e["default_source"])).when(~has, out(origin="absent", issue=missing, reason=F.when(e["required"], "a required field is missing")))
                .otherwise(let(picked, judged)))

    v = F.try_element_at(given, n)
    return let(F.struct(F.try_element_at(eff, n).alias("e"), F.when(v != "null", v).alias("v"), F.map_contains_key(given, n).alias("has")), rule)


def coerced_state(proposed: DataFrame, claims: DataFrame, fields: DataFrame, defaults: bool = True, now_ms: int = 0) -> DataFrame:
    """``STATE`` of every field that ``proposed(id, types, fields map<string, JSON>)`` gives or its types claim.

    Claims are merged once per distinct type list and joined by it, as a table of a known size: the few lists go to the nodes,
    who would meet in a task for each list else. All else happens within a node's row, without a shuffle.
    ``origin``: provided, defaulted, orphan (no type claims it), null (given as null) or absent. ``issue``: what is wrong,
    null where the value holds. ``created_ms`` and ``modified_ms`` of ``proposed``, if there, serve the date tokens of defaults.
    """
    has = lambda c: F.col(c) if c in proposed.columns else F.lit(None).cast("long")
    p = proposed.select("id", "types", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("given"), F.array_join("types", "\u0001").alias("key"), has("created_ms").alias("created_ms"), has("modified_ms").alias("modified_ms"))
    p = p.join(cut(effective(p.select("key", "types").distinct(), claims, fields)), "key", "left").withColumn("now_ms", F.lit(now_ms).cast("long"))
    rows = p.select(F.col("id").alias("node_id"), "types", F.explode(_states(p.sparkSession.sparkContext.applicationId, defaults)).alias("s"))
    return rows.select("node_id", "s.*", "types").filter("origin <> 'absent' or issue is not null")


@lru_cache(maxsize=4)
def _states(application: str, defaults: bool) -> Column:
    """The states of all fields of a row; its expression is large, so each application makes it once."""
    names = F.array_union(F.map_keys("given"), F.coalesce(F.map_keys("eff"), F.array().cast("array<string>")))
    times = F.col("created_ms"), F.col("modified_ms"), F.col("now_ms")
    return F.transform(names, lambda n: _state(n, F.col("given"), F.col("eff"), defaults, times))


def field_rows(state: DataFrame) -> DataFrame:
    """The rows to store: values that hold."""
    good = state.filter("issue is null and value is not null and value <> 'null'")
    return good.select("node_id", F.col("field").alias("field_name"), *classified(F.col("value")))


def issue_rows(state: DataFrame) -> DataFrame:
    return state.filter("issue is not null").select("node_id", "field", F.col("issue").alias("code"), F.col("original").alias("value"), "reason", "closest", "errors")


def log_rows(state: DataFrame, source: str, at_ms: int, retained: DataFrame | None = None) -> DataFrame:
    """``node_id, timestamp, event_type, details``: values that were converted, defaults, and for a watcher what was refused
    (``retained(node_id, field, kept)`` holds the stored value that stays)."""
    s = state.withColumn("source", F.lit(source))
    row = lambda df, event, *cols: df.select("node_id", F.lit(at_ms).cast("long").alias("timestamp"), F.lit(event).alias("event_type"), F.to_json(F.struct("source", "field", *cols, F.col("types").alias("node_types")), {"ignoreNullFields": "false"}).alias("details"))
    out = row(s.filter("origin = 'provided' and changed and issue is null"), "value-coerced", F.col("original").alias("original_value"), F.col("value").alias("coerced_value"), "code")
    out = out.unionByName(row(s.filter("origin = 'defaulted'"), "field-defaulted", F.col("value").alias("default_value"), "default_source"))
    if retained is not None:
        bad = s.filter("issue is not null").join(retained, ["node_id", "field"], "left")
        out = out.unionByName(row(bad, "value-rejected", F.col("original").alias("rejected_value"), F.col("kept").alias("retained_value"), F.col("issue").alias("reason_code"), "reason"))
    return out


def edges_of(field_rows: DataFrame, bodies: DataFrame, fields: DataFrame) -> DataFrame:
    """``source_id, target, rel_type, context``: what reference fields, lists of references, links in fields without a
    definition, and links in bodies say; one for each (source, target, rel_type), the first of a body kept.

    A field's edge has the field's name as type and context, a body's edge the text of its line.
    """
    kinds = fields.select(F.col("name").alias("field_name"), "field_type", "list_item_type")
    f = field_rows.join(kinds, "field_name", "left")
    text, json, kind = F.col("value_text"), F.col("value_json"), F.col("field_type")
    items = F.transform(F.filter(F.from_json("value_json", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
    loose = F.regexp_extract_all(F.coalesce(text, F.when(json.startswith("["), json), F.lit("")), F.lit(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"), F.lit(1))
    targets = (F.when((kind == "reference") & text.isNotNull(), F.array(text)).when((kind == "list") & (F.col("list_item_type") == "reference"), items).when(kind.isNull(), loose))
    own = f.select(F.col("node_id").alias("source_id"), F.explode(targets).alias("target"), F.col("field_name").alias("rel_type"), F.col("field_name").alias("context"), F.lit(0).alias("o"))
    links = bodies.select(F.col("id").alias("source_id"), F.posexplode(links_in("body")).alias("o", "l"))
    links = links.select("source_id", F.col("l.target").alias("target"), F.lit("wiki-link").alias("rel_type"), F.col("l.context").alias("context"), "o")
    return own.unionByName(links).groupBy("source_id", "target", "rel_type").agg(F.min_by("context", "o").alias("context"))
