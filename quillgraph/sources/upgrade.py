"""Tables of earlier versions read as those of today."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.discovery import sort_orders
from ..schema import TABLES


def columns(df: DataFrame, name: str) -> DataFrame:
    """All columns of ``TABLES[name]``, the missing ones null; others stay behind them. Twice is as once."""
    want = T._parse_datatype_string(TABLES[name])
    have = set(df.columns)
    out = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields]
    return df.select(*out, *(c for c in df.columns if c not in {f.name for f in want.fields}))


def created_at(nodes: DataFrame) -> DataFrame:
    """A missing time of creation is that of indexing."""
    return nodes.withColumn("created_at", F.coalesce("created_at", "indexed_at"))


def split_overrides(fields: DataFrame) -> DataFrame:
    """One flag for all overrides becomes those for required and default, not that for enums."""
    if "overrides_allowed" not in fields.columns:
        return fields
    flag = F.coalesce("overrides_allowed", F.lit(False)).cast("boolean")
    return fields.withColumns({"ov_required": flag, "ov_default": flag, "ov_enum": F.lit(False)}).drop("overrides_allowed")


def claim_overrides(claims: DataFrame) -> DataFrame:
    """Renamed columns; a default that was given is an override."""
    for old, new in (("required", "required_override"), ("default_value", "default_override")):
        if old in claims.columns and new not in claims.columns:
            claims = claims.withColumnRenamed(old, new)
    if "default_overridden" not in claims.columns:
        claims = claims.withColumn("default_overridden", F.col("default_override").isNotNull())
    return claims


def claim_shape(claims: DataFrame) -> DataFrame:
    """Claims as they are read: required is yes, no or inherited, a default is one's own or inherited."""
    return claims.select("schema_name", "field", F.when(F.col("required_override").isNull(), "inherit").when(F.col("required_override"), "yes").otherwise("no").alias("required"),
                         F.when(F.col("default_overridden"), "override").otherwise("inherit").alias("default_from"), F.when(F.col("default_overridden"), F.col("default_override")).alias("default_value"))


def node_types(types: DataFrame) -> DataFrame:
    """Sort orders for types that have none."""
    return sort_orders(types if "sort_order" in types.columns else types.withColumn("sort_order", F.lit(None).cast("int")))
