"""Ids of an operation against plain joins, and what reaches the scan."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import keys as K
from quillgraph.operators import undo as U
from quillgraph.operators import write as W
from quillgraph.tables import Graph, cut, table


@pytest.mark.parametrize(("few", "ranges", "most"), [(1000, 32, 1 << 21), (1, 32, 1 << 21), (2, 1, 1 << 21), (0, 32, 0)])
def test_like_plain_joins(spark, monkeypatch, few, ranges, most):
    for name, value in (("FEW", few), ("RANGES", ranges), ("MOST", most)):
        monkeypatch.setattr(K, name, value)
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(["part:1", "part:3", "part:5", "order:2", None, "x", "part:4", "part:3"])], "id string, n int")
    for ids in (["part:1", "part:5", "order:2", None, "part:1"], [None], []):
        wanted = spark.createDataFrame([(x,) for x in ids], "id string")
        k, known = K.Keys(wanted), {x for x in ids if x}
        numbers = lambda df: sorted(r.n for r in df.collect())
        mine = sorted(r.n for r in rows.collect() if r.id in known)
        assert numbers(k.only(rows, "id")) == mine and numbers(k.without(rows, "id")) == sorted(set(range(8)) - set(mine))
        assert sorted(r.n for r in k.mark(rows, "id", "m").collect() if r.m) == mine and k.mark(rows, "id", "m").filter("not m").count() == 8 - len(mine)
        other = wanted.filter("id is not null").distinct().withColumn("v", F.upper("id"))
        assert {(r.n, r.v) for r in k.add(rows, "id", other, F.col("n") < 5).collect()} == {(r.n, r.id.upper() if r.id in known and r.n < 5 else None) for r in rows.collect()}


def test_few_ids_reach_the_scan(spark):
    edges = cut(spark.createDataFrame([("a", "B", "near", None, "b"), ("b", "A", "near", None, "a")], "source_id string, target string, rel_type string, context string, resolved_target_id string"))
    nodes = cut(spark.createDataFrame([("a", "A.md", "A", "", 1), ("b", "B.md", "B", "", 1)], "id string, file_path string, title string, body string, version int"))
    none = [cut(table(spark, n)) for n in ("node_types", "node_fields")]
    own = U._of(Graph(nodes, *none, edges), spark.createDataFrame([("a",)], "id string"))
    for df in (own.nodes, own.node_types, own.node_fields, own.relationships):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "_id,a)" in plan.replace("(id,a)", "(_id,a)") and "Join" not in plan
    assert [r.source_id for r in own.relationships.collect()] == ["a"]


def test_odd_names_are_answered(spark):
    nodes = spark.createDataFrame([("a", "x/Über.md", "t", "", 1), ("b", "x/UBER.md", "u", "", 1), ("c", "x/end.md\n", None, "", 1), ("d", "K.md", "v", "", 1), ("e", "other.md", "u", "", 1)], "id string, file_path string, title string, body string, version int")
    asked = ["über", "uber.md", "end\n", "k", "u", "x/Über.md", "none", "OTHER"]
    got = {r.target: r.id for r in G.resolve(nodes, spark.createDataFrame([(x,) for x in asked], "target string")).collect()}
    assert got == {"über": "a", "uber.md": "b", "end\n": "c", "k": "d", "u": "e", "x/Über.md": "a", "OTHER": "e"}
    texts = ["n.md", "N", "p/n.md", "t", "n.md\n", "ñ", "m"]
    found = spark.createDataFrame([(x,) for x in texts], "target string").filter(W._may_name("p/n.md", "t"))
    assert {r.target for r in found.collect()} >= {"n.md", "N", "p/n.md", "t"} and "m" not in {r.target for r in found.collect()}
