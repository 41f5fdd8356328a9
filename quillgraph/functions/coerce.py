"""Value coercion as Column builders: each gives struct(ok, value, changed, code, reason)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import closest, closest_of

SCHEMA = "struct<ok:boolean,value:string,changed:boolean,code:string,reason:string>"


def _out(ok: Column | bool, value: Column | None, changed: Column | bool, code: Column | str | None, reason: Column | str | None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(ok).alias("ok"), lit(value).cast("string").alias("value"), lit(changed).alias("changed"), lit(code).cast("string").alias("code"), lit(reason).cast("string").alias("reason"))


def _fail(c: Column, target: str) -> Column:
    return _out(False, None, False, None, F.concat(F.lit(f"no {target}: "), c))


def _good(value: Column, code: str) -> Column:
    return _out(True, value, True, code, None)


def to_number(c: Column) -> Column:
    t = F.trim(c)
    hexa = t.rlike("^0[xX][0-9a-fA-F]+$")
    plain = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    n = F.when(hexa, F.conv(F.substring(t, 3, 64), 16, 10).try_cast("double")).when(plain, t.try_cast("double"))
    for letter, base in (("b", 2), ("o", 8)):
        n = F.when(t.rlike(f"^0[{letter}{letter.upper()}][0-{base - 1}]+$"), F.conv(F.substring(t, 3, 64), base, 10).try_cast("double")).otherwise(n)
    n = F.when(plain, t.try_cast("double")).otherwise(n)  # most are plain
    return let(n, lambda x: F.when(x.isNotNull() & (F.abs(x) < float("inf")), _good(x, "STRING_TO_NUMBER")).otherwise(_fail(c, "number")))


def to_date(c: Column) -> Column:
    """ISO dates and timestamps with a day that exists; the trimmed text is the value."""
    t = F.trim(c)
    shape = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$")
    real = F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd").isNotNull()
    return F.when(shape & real, _good(t, "STRING_TO_DATE")).otherwise(_fail(c, "date"))


def to_boolean(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "yes"), _good(F.lit("true"), "STRING_TO_BOOLEAN")).when(t.isin("false", "no"), _good(F.lit("false"), "STRING_TO_BOOLEAN")).otherwise(_fail(c, "boolean"))


def to_reference(c: Column) -> Column:
    t = F.trim(c)
    wrapped = t.startswith("[[") & t.endswith("]]")
    inner = F.split(F.regexp_extract(t, r"(?s)^\[\[(.*)\]\]$", 1), r"\|")[0]
    return F.when(wrapped, _good(inner, "STRING_TO_REFERENCE")).otherwise(_out(True, t, False, None, None))


def to_enum(c: Column, values: list[str]) -> Column:
    """The first value equal to the trimmed text, exactly or but for case; else suggestions."""
    t = F.trim(c)
    out = None
    for v in values:
        exact, loose = t == v, F.lower(t) == v.lower()
        hit = _out(True, F.lit(v), F.when(exact, c != t).otherwise(True), F.when(exact & (c == t), None).otherwise("STRING_TO_ENUM"), None)
        out = F.when(exact | loose, hit) if out is None else out.when(exact | loose, hit)
    fail = _out(False, None, False, None, F.concat(F.lit("not in the list: "), t, F.when(F.size(closest(t, values)) > 0, F.concat(F.lit("; closest: "), F.array_join(closest(t, values), ", "))).otherwise(F.lit(""))))
    return fail if out is None else out.otherwise(fail)


def coerce(c: Column, kind: str, enum_values: list[str] | None = None) -> Column:
    """Coerces a string column to a field type; null passes through."""
    if kind == "enum" and enum_values is None:
        out = _out(False, None, False, None, "no list of values")
    elif kind == "enum":
        out = to_enum(c, enum_values)
    else:
        make = {"number": to_number, "date": to_date_fuzzy, "boolean": to_boolean, "reference": to_reference, "string": lambda x: _out(True, x, False, None, None), "list": lambda x: _fail(x, "list")}
        out = make[kind](c)
    return F.when(c.isNull(), _out(True, None, False, None, None)).otherwise(out)


def coerce_list(c: Column, item: str, enum_values: list[str] | None = None) -> Column:
    """An array column: each element coerced; struct(ok, values, changed, bad) where ``bad`` counts failures."""
    each = F.transform(c, lambda x: coerce(x, item, enum_values))
    return F.struct((~F.exists(each, lambda r: ~r["ok"])).alias("ok"), F.transform(each, lambda r: r["value"]).alias("values"),
                    F.exists(each, lambda r: r["changed"]).alias("changed"), F.size(F.filter(each, lambda r: ~r["ok"])).alias("bad"))


# Formats of written dates beside ISO, tried in this order; a documented subset of natural language.
WRITTEN = ["MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/M/d", "M/d/yyyy", "d.M.yyyy"]


def to_date_fuzzy(c: Column) -> Column:
    """ISO dates as they are; written ones as ``YYYY-MM-DD``, with ``THH:mm`` where a time follows."""
    t = F.trim(F.regexp_replace(c, r"[|\[\]]+", " "))
    clock = F.regexp_extract(t, r"(?:\s+|\s+at\s+)(\d{1,2}:\d{2})$", 1)
    day = F.trim(F.regexp_replace(t, r"(?:\s+at)?\s+\d{1,2}:\d{2}$", ""))
    found = F.coalesce(*(F.try_to_timestamp(day, F.lit(f)) for f in WRITTEN))
    hour = F.lpad(clock, 5, "0")
    value = lambda x: F.concat(F.date_format(x, "yyyy-MM-dd"), F.when(clock != "", F.concat(F.lit("T"), hour)).otherwise(""))
    written = let(found, lambda x: F.when(x.isNotNull(), _good(value(x), "STRING_TO_DATE_FUZZY")).otherwise(_fail(c, "date")))
    return let(to_date(c), lambda iso: F.when(iso["ok"], iso).otherwise(written))


def to_string(c: Column, source: str) -> Column:
    """Numbers, dates and booleans as text."""
    value = c
    if source == "number":  # whole numbers have no point
        value = F.when(c == F.floor(c), F.format_string("%.0f", c.cast("double"))).otherwise(c.cast("string"))
    return F.when(c.isNull(), _out(True, None, False, None, None)).otherwise(_good(value, {"number": "NUMBER_TO_STRING", "date": "DATE_TO_STRING", "boolean": "BOOLEAN_TO_STRING"}[source]))


def wrap_list(c: Column, item: str, enum_values: list[str] | None = None) -> Column:
    """A single value as a list of one: struct(ok, values, code, reason)."""
    one = coerce(c, item, enum_values)
    return F.struct(one["ok"].alias("ok"), F.when(one["ok"], F.array(one["value"])).alias("values"), F.when(one["ok"], "SINGLE_TO_LIST").alias("code"), F.when(~one["ok"], F.concat(F.lit("Not an element: "), one["reason"])).alias("reason"))


def list_errors(c: Column, item: str, enum_values: list[str] | None = None) -> Column:
    """An array column: struct(ok, values, changed, code, errors), ``errors`` being (index, value, reason) of each element that fails."""
    each = F.transform(c, lambda x, i: F.struct(i.cast("int").alias("index"), x.alias("value"), coerce(x, item, enum_values).alias("r")))
    errors = F.transform(F.filter(each, lambda e: ~e["r"]["ok"]), lambda e: F.struct(e["index"].alias("index"), e["value"].alias("value"), e["r"]["reason"].alias("reason")))
    ok = F.size(errors) == 0
    changed = ok & F.exists(each, lambda e: e["r"]["changed"])
    return F.struct(ok.alias("ok"), F.when(ok, F.transform(each, lambda e: e["r"]["value"])).alias("values"), changed.alias("changed"), F.when(changed, "LIST_ELEMENT_COERCION").alias("code"), errors.alias("errors"))


def quoted(text: Column) -> Column:
    """The JSON of a string column."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def plain(json: Column) -> Column:
    """The text of a JSON string; other JSON stays as it is written."""
    return F.when(json.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>"), 0)).otherwise(json)


def json_kind(json: Column) -> Column:
    """null, string, boolean, list, object or number."""
    return (F.when(json.isNull() | (json == "null"), "null").when(json.startswith('"'), "string").when(json.isin("true", "false"), "boolean")
            .when(json.startswith("["), "list").when(json.startswith("{"), "object").otherwise("number"))


def json_items(json: Column) -> Column:
    """The elements of a JSON list, each as JSON; null for anything else."""
    return F.transform(F.from_json(F.when(json.startswith("["), json), "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))


def json_number(n: Column) -> Column:
    """A double as JSON; whole numbers have no point."""
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("bigint").cast("string")).otherwise(n.cast("string"))


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once."""
    return F.get(F.transform(F.array(x), f), 0)


RESULT = {"ok": "boolean", "value": "string", "changed": "boolean", "code": "string", "reason": "string", "closest": "array<string>", "errors": "array<struct<index:int,value:string,reason:string>>"}


def _result(**given) -> Column:
    """A struct of ``RESULT``; what isn't given is null, ``changed`` false."""
    given = {"changed": False, **given}
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(*(lit(given.get(n)).cast(t).alias(n) for n, t in RESULT.items()))


def _scalar(v: Column, kind: Column, values: Column) -> Column:
    """``RESULT`` of a JSON value for a field type that is no list."""

    def bound(b: Column) -> Column:
        src, text = b["src"], b["text"]
        string, t = src == "string", F.trim(text)
        lift = lambda r, to_json: let(r, lambda x: _result(ok=x["ok"], value=F.when(x["ok"], to_json(x["value"])), changed=x["changed"], code=x["code"], reason=x["reason"]))
        same = _result(ok=True, value=v)
        wrong = _result(ok=False, reason=F.concat(F.lit("a "), src, F.lit(" is no "), kind, F.lit(": "), v))

        def listed(x: Column) -> Column:
            new = (x["hit"] != t) | ~string | (text != t)
            good = _result(ok=True, value=quoted(x["hit"]), changed=new, code=F.when(new, "STRING_TO_ENUM"))
            return F.when(x["hit"].isNotNull(), good).otherwise(_result(ok=False, reason=F.concat(F.lit("not in the list: "), t), closest=closest_of(t, values)))

        first = F.struct(F.get(F.filter(values, lambda x: F.lower(x) == F.lower(t)), 0).alias("hit"))
        enum = F.when(values.isNull(), _result(ok=False, reason="no list of values")).otherwise(let(first, listed))
        as_text = F.when(src == "number", json_number(v.try_cast("double"))).otherwise(v)
        written = _result(ok=True, value=quoted(as_text), changed=True, code=F.when(src == "number", "NUMBER_TO_STRING").otherwise("BOOLEAN_TO_STRING"))
        return (F.when(src == "null", _result(ok=True)).when(kind == "enum", enum)
                .when(kind == "string", F.when(string, same).when(src.isin("number", "boolean"), written).otherwise(wrong))
                .when(kind == "number", F.when(src == "number", same).when(string, lift(to_number(text), lambda x: json_number(x.try_cast("double")))).otherwise(wrong))
                .when(kind == "boolean", F.when(src == "boolean", same).when(string, lift(to_boolean(text), lambda x: x)).otherwise(wrong))
                .when(kind == "reference", F.when(string, lift(to_reference(text), quoted)).otherwise(wrong))
                .when(kind == "date", F.when(string, lift(to_date_fuzzy(text), quoted)).otherwise(wrong)).otherwise(wrong))

    return let(F.struct(json_kind(v).alias("src"), plain(v).alias("text")), bound)


def dispatch(v: Column, kind: Column, item: Column, values: Column) -> Column:
    """A JSON value for the field type in column ``kind``: struct(ok, value, changed, code, reason, closest, errors).

    All arguments are columns, so one plan serves every field: ``item`` is a list's element type (null: any), ``values`` an
    enum's list. ``value`` is JSON; null stays null. ``errors`` holds (index, value, reason) of a list's elements that fail.
    """
    src, is_list = json_kind(v), kind == "list"
    # one value is looked at as a list of one, so that the rules of scalars stand in the plan once
    items = F.when(is_list & item.isNotNull() & (src == "list"), json_items(v)).otherwise(F.array(v))
    each = F.transform(items, lambda x, i: F.struct(i.cast("int").alias("index"), x.alias("value"), _scalar(x, F.when(is_list, item).otherwise(kind), values).alias("r")))

    def judged(each: Column) -> Column:
        first = F.get(each, 0)["r"]
        bad = F.transform(F.filter(each, lambda e: ~e["r"]["ok"]), lambda e: F.struct(e["index"].alias("index"), e["value"].alias("value"), e["r"]["reason"].alias("reason")))
        moved = F.exists(each, lambda e: e["r"]["changed"])
        joined = F.concat(F.lit("["), F.array_join(F.transform(each, lambda e: F.coalesce(e["r"]["value"], F.lit("null"))), ","), F.lit("]"))
        good = _result(ok=True, value=F.when(moved, joined).otherwise(v), changed=moved, code=F.when(moved, "LIST_ELEMENT_COERCION"))
        return (F.when(src == "null", _result(ok=True)).when(~is_list, first)
                .when(item.isNull(), _result(ok=src == "list", value=F.when(src == "list", v), reason=F.when(src != "list", F.concat(F.lit("a "), src, F.lit(" is no list: "), v))))
                .when((src == "list") & F.exists(each, lambda e: ~e["r"]["ok"]), _result(ok=False, reason=F.lit("elements fail"), errors=bad)).when(src == "list", good)
                .when(first["ok"], _result(ok=True, value=F.concat(F.lit("["), first["value"], F.lit("]")), changed=True, code="SINGLE_TO_LIST"))
                .otherwise(_result(ok=False, reason=F.concat(F.lit("no element: "), first["reason"]))))

    return let(each, judged)
