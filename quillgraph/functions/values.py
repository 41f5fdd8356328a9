"""The four typed value columns of a field row."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


KINDS = {"value_text": "string", "value_number": "double", "value_date": "string", "value_json": "string"}


def classify(v: object) -> tuple[str | None, float | None, str | None, str | None]:
    """Text, number, date and JSON columns of a value: strings and numbers have their own, dates too, all else is JSON."""
    if isinstance(v, str):
        return v, None, None, None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return None, float(v), None, None
    if isinstance(v, dt.datetime):
        utc = v.astimezone(dt.timezone.utc) if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        return None, None, utc.isoformat(timespec="milliseconds").replace("+00:00", "Z"), None
    if isinstance(v, dt.date):
        return None, None, f"{v.isoformat()}T00:00:00.000Z", None
    return None, None, None, json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def classified(c: Column) -> list[Column]:
    """The same for a column of JSON texts: a quoted string, a number, or JSON that stays as it is."""
    text = F.when(c.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), 0))
    number = F.when(c.rlike(r"^-?\d"), c.try_cast("double"))
    rest = F.when(text.isNull() & number.isNull(), c)
    return [text.alias("value_text"), number.alias("value_number"), F.lit(None).cast("string").alias("value_date"), rest.alias("value_json")]


def as_text() -> Column:
    """Text, else number, date, JSON: the key of value histograms."""
    return F.coalesce("value_text", F.col("value_number").cast("string"), "value_date", "value_json")


def rebuilt(row: str | None = None) -> Column:
    """JSON, else number, date, text: the value a reader sees; of the columns of the struct ``row`` if one is given."""
    at = lambda name: F.col(f"{row}.{name}" if row else name)
    return F.coalesce(at("value_json"), at("value_number").cast("string"), at("value_date"), at("value_text"))


def as_json() -> Column:
    """A stored value as JSON: dates and texts are quoted."""
    listed = F.to_json(F.array(F.coalesce("value_date", "value_text")))
    return F.coalesce("value_json", F.col("value_number").cast("string"), F.substr(listed, F.lit(2), F.length(listed) - 2))


def literal(v: object) -> Column:
    """A struct of the four columns that hold ``v``; all null for None."""
    values = (None,) * 4 if v is None else classify(v)
    return F.struct(*(F.lit(x).cast(KINDS[k]).alias(k) for k, x in zip(KINDS, values)))


def kind() -> Column:
    return F.when(F.col("value_json").isNotNull(), "json").when(F.col("value_number").isNotNull(), "number").when(F.col("value_date").isNotNull(), "date").otherwise("text")


def declared_kind() -> Column:
    """The type that a stored value suggests: number, date, boolean, list, string."""
    j = F.col("value_json")
    return (F.when(F.col("value_number").isNotNull(), "number").when(F.col("value_date").isNotNull(), "date")
            .when(j.isin("true", "false"), "boolean").when(j.startswith("["), "list").otherwise("string"))


def comparable(literal: object) -> Column:
    """The column a literal is compared with: its own type decides, not the field's declared one."""
    return F.col("value_number") if isinstance(literal, (int, float)) and not isinstance(literal, bool) else F.coalesce("value_date", "value_text")


def millis(name: str) -> Column:
    """Epoch milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', CAST({name} AS TIMESTAMP_NTZ))")
