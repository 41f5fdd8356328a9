"""Star-schema tables as a typed graph.

One specification gives the Spark plan and the DuckDB SQL of each graph table. Every (entity, field) is a branch of a
union with a literal type or field name, so a filter on those prunes all other branches before a file is opened.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..tables import Graph, load, save, stored


@dataclass
class Entity:
    table: str
    key: str
    path: str
    title: str
    body: str = "CAST(NULL AS STRING)"
    mtime: str = "CAST(NULL AS BIGINT)"
    types: list[tuple[str, str, int]] = field(default_factory=list)  # name, condition, order
    fields: list[tuple[str, str, str]] = field(default_factory=list)  # name, column kind, expression

    @property
    def id(self) -> str:
        return f"'{self.types[0][0]}:' || CAST({self.key} AS STRING)"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _pad(x: str) -> str:
    return f"lpad({_s(x)}, 9, '0')"


ENTITIES = [
    Entity("region", "r_regionkey", f"'regions/' || {_s('r_regionkey')} || '.md'", "r_name", types=[("region", "TRUE", 0)]),
    Entity("nation", "n_nationkey", "'nations/' || n_name || '.md'", "n_name", types=[("nation", "TRUE", 0)]),
    Entity("supplier", "s_suppkey", "'suppliers/' || s_name || '.md'", "s_name", types=[("supplier", "TRUE", 0)], fields=[("acctbal", "number", "s_acctbal")]),
    Entity("customer", "c_custkey", "'customers/' || c_mktsegment || '/' || c_name || '.md'", "c_name", types=[("customer", "TRUE", 0)],
           fields=[("mktsegment", "text", "c_mktsegment"), ("acctbal", "number", "c_acctbal")]),
    Entity("part", "p_partkey", f"'parts/' || p_brand || '/part-' || {_s('p_partkey')} || '.md'", "p_name", types=[("part", "TRUE", 0), ("economy", "p_type = 'ECONOMY'", 1)],
           fields=[("brand", "text", "p_brand"), ("size", "number", "CAST(p_size AS DOUBLE)"), ("retailprice", "number", "p_retailprice"),
                   ("tags", "json", "'[\"' || p_brand || '\",\"' || p_type || '\"]'")]),
    Entity("orders", "o_orderkey", f"'orders/' || o_orderstatus || '/order-' || {_s('o_orderkey')} || '.md'", f"'order-' || {_s('o_orderkey')}", mtime="{ms:o_orderdate}",
           types=[("order", "TRUE", 0), ("urgent", "o_orderpriority = '1-URGENT'", 1)],
           fields=[("orderstatus", "text", "o_orderstatus"), ("totalprice", "number", "o_totalprice"), ("orderpriority", "text", "o_orderpriority"),
                   ("orderdate", "date", _s("CAST(o_orderdate AS DATE)")), ("ref_text?o_orderkey % 5 <> 0", "text", "'ref-' || " + _s("o_orderkey % 7")), ("ref_text?o_orderkey % 5 = 0", "number", "CAST(o_orderkey % 7 AS DOUBLE)")]),
    Entity("documents", "doc_id", f"'docs/' || source || '/doc-' || {_s('doc_id')} || '.md'", f"'doc-' || {_s('doc_id')}", body="text", mtime="doc_id * 1000",
           types=[("document", "TRUE", 0), ("english", "lang = 'en'", 1)], fields=[("lang", "text", "lang"), ("source", "text", "source"), ("n_chars", "number", "CAST(n_chars AS DOUBLE)")]),
]

#: rel_type, table, source id, target text, resolved id (NULL: dangling), whether rows can repeat
EDGES = [
    ("region", "nation", f"'nation:' || {_s('n_nationkey')}", f"'regions/' || {_s('n_regionkey')} || '.md'", f"'region:' || {_s('n_regionkey')}", False),
    ("nation", "customer", f"'customer:' || {_s('c_custkey')}", f"'NATION_' || {_s('c_nationkey')}", f"'nation:' || {_s('c_nationkey')}", False),
    ("nation", "supplier", f"'supplier:' || {_s('s_suppkey')}", f"'NATION_' || {_s('s_nationkey')}", f"'nation:' || {_s('s_nationkey')}", False),
    ("customer", "orders", f"'order:' || {_s('o_orderkey')}", f"CASE WHEN o_orderkey % 97 = 0 THEN 'Ghost' ELSE 'Customer#' || {_pad('o_custkey')} END", f"CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'customer:' || {_s('o_custkey')} END", False),
    ("part", "lineitem", f"'order:' || {_s('l_orderkey')}", f"'Part-' || {_s('l_partkey')}", f"'part:' || {_s('l_partkey')}", True),
    ("supplier", "lineitem", f"'order:' || {_s('l_orderkey')}", f"'Supplier#' || {_pad('l_suppkey')}", f"'supplier:' || {_s('l_suppkey')}", True),
]
_VALUES = {"text": "value_text", "number": "value_number", "date": "value_date", "json": "value_json"}
_KINDS = {"value_text": "STRING", "value_number": "DOUBLE", "value_date": "STRING", "value_json": "STRING"}


def _selects() -> dict[str, list[tuple[str, str]]]:
    """(table, SELECT) pairs of each graph table; ``{ms:x}`` stands for epoch milliseconds."""
    out: dict[str, list[tuple[str, str]]] = {"nodes": [], "node_types": [], "node_fields": [], "relationships": []}
    for e in ENTITIES:
        out["nodes"].append((e.table, f"SELECT {e.id} AS id, {e.path} AS file_path, {e.title} AS title, {e.body} AS body, CAST({e.mtime} AS BIGINT) AS file_mtime, 1 AS version FROM {e.table}"))
        for name, cond, order in e.types:
            out["node_types"].append((e.table, f"SELECT {e.id} AS node_id, '{name}' AS schema_type, {order} AS sort_order FROM {e.table} WHERE {cond}"))
        for name, kind, expr in e.fields:
            name, _, cond = name.partition("?")
            cols = ", ".join(f"{expr if c == _VALUES[kind] else f'CAST(NULL AS {_KINDS[c]})'} AS {c}" for c in _VALUES.values())
            out["node_fields"].append((e.table, f"SELECT {e.id} AS node_id, '{name}' AS field_name, {cols} FROM {e.table} WHERE ({expr}) IS NOT NULL" + (f" AND {cond}" if cond else "")))
    for rel, table, source, target, resolved, repeats in EDGES:
        out["relationships"].append((table, f"SELECT {'DISTINCT ' if repeats else ''}{source} AS source_id, {target} AS target, '{rel}' AS rel_type, {resolved} AS resolved_target_id FROM {table}"))
    return out


def _spark_sql(text: str) -> str:
    return re.sub(r"\{ms:(\w+)\}", r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', CAST(\1 AS TIMESTAMP_NTZ))", text)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The four graph tables over the Parquet files of ``sf_dir``; nothing is read until a plan needs it."""
    parts: dict[str, DataFrame] = {}
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in {t for x in _selects().values() for t, _ in x}}
    for name, selects in _selects().items():
        union = None
        for table, text in selects:
            source = tables[table]
            head, _, tail = _spark_sql(text).partition(f" FROM {table}")
            head = head.removeprefix("SELECT ")
            distinct = head.startswith("DISTINCT ")
            where = tail.removeprefix(" WHERE ") if tail else ""
            if where and where != "TRUE":
                source = source.filter(where)
            if distinct:  # of the keys, which the ids spell out: numbers are shuffled, not texts
                source = source.select(*(c for c in source.columns if re.search(rf"\b{c}\b", head))).distinct()
            df = source.selectExpr(*_split(head.removeprefix("DISTINCT ")))
            union = df if union is None else union.unionByName(df)
        parts[name] = union
    return Graph(**parts)


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The same, written once a session. A plan over the unions repeats each predicate's right side in every branch; over
    the tables a predicate is one scan."""
    sources = sorted({t for x in _selects().values() for t, _ in x})
    return load(spark, stored(spark, "graph", [f"{sf_dir}/{t}.parquet" for t in sources], lambda path: save(graph(spark, sf_dir), path)))


def _split(head: str) -> list[str]:
    """Top-level commas of a SELECT list."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(head):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(head[start:i].strip())
                start = i + 1
    return [*out, head[start:].strip()]


def prelude() -> str:
    """WITH clauses that define the same tables in DuckDB."""
    ctes = []
    for name, selects in _selects().items():
        body = " UNION ALL ".join(re.sub(r"\{ms:(\w+)\}", r"epoch_ms(\1)", t) for _, t in selects)
        ctes.append(f"{name} AS ({body})")
    return "WITH " + ", ".join(ctes) + " "
