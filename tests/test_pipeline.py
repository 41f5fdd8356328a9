"""The coerced write pipeline, undo with its conflicts, batches and versions on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.coerce import dispatch
from quillgraph.functions.text import links_in
from quillgraph.operators import batch as B
from quillgraph.operators import mutate as M
from quillgraph.operators import undo as U
from quillgraph.operators import write as W
from quillgraph.tables import Conflict, Graph, cut, load_version, save_version, table, versions

PROPOSAL = "id string, file_path string, title string, body string, types array<string>, fields map<string,string>"


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("a", "A.md", "Alpha", "to [[Beta]]", "h", 10, 20, 30, 3), ("b", "B.md", "Beta", "", "h", 11, 21, 31, 1), ("c", "sub/Gamma.md", "Gamma", None, "h", 12, 22, 32, 1)]
    fields = [("a", "size", None, 4.0, None, None), ("a", "due", None, None, "2024-01-01T00:00:00.000Z", None)]
    edges = [("a", "Beta", "wiki-link", "to [[Beta]]", "b"), ("b", "Alpha", "near", None, "a"), ("b", "Delta", "near", None, None)]
    return Graph(spark.createDataFrame(nodes, "id string, file_path string, title string, body string, content_hash string, file_mtime long, indexed_at long, created_at long, version int"),
                 spark.createDataFrame([("a", "thing", 0), ("b", "thing", 0)], "node_id string, schema_type string, sort_order int"),
                 spark.createDataFrame(fields, "node_id string, field_name string, value_text string, value_number double, value_date string, value_json string"),
                 spark.createDataFrame(edges, "source_id string, target string, rel_type string, context string, resolved_target_id string"))


@pytest.fixture(scope="module")
def dims(spark):
    f = lambda name, kind, values=None, default=None, required=False, item=None: (name, kind, values, default, required, True, True, True, item)
    fields = [f("size", "number"), f("sizes", "list", item="number"), f("kind", "enum", ["Oak", "Elm"], '"Oak"', True), f("near", "list", item="reference"), f("made", "string", None, '"$ctime:YYYY"', True)]
    claims = [("thing", n, None, None, 1, None, False, None, None) for n in ("size", "sizes", "kind", "near", "made")]
    return table(spark, "claims", claims), table(spark, "global_fields", fields), table(spark, "schemas", [("thing", None, None, "things")])


def proposal(spark, *rows):
    return spark.createDataFrame(list(rows), PROPOSAL)


def rows_of(g):
    return {(r.node_id, r.field_name): (r.value_text, r.value_number, r.value_json) for r in g.node_fields.collect()}


def edges_of(g):
    return {(r.source_id, r.target, r.rel_type, r.resolved_target_id) for r in g.relationships.collect()}


def test_values_edges_times_and_log(spark, g, dims):
    p = proposal(spark, ("a", "A.md", "Alpha", "now [[Gamma]] `[[Beta]]`\n\n```\n[[Beta]]\n```", ["thing"], {"size": '"5"', "sizes": '["1", 2.5]', "kind": '"oak "', "near": '["[[Beta|b]]", "Nowhere"]', "loose": '"see [[Gamma|g]]"', "made": '"x"'}),
                 ("d", "sub/Delta.md", "Delta", "", ["thing"], {"sizes": '"7"'}))
    out, log, bad = W.apply(g, p, *dims, at_ms=1_700_000_000_000)
    got = rows_of(out)
    assert bad.count() == 0 and got["a", "size"] == (None, 5.0, None) and got["a", "sizes"] == (None, None, "[1,2.5]") and got["a", "kind"] == ("Oak", None, None) and ("a", "due") not in got
    assert got["d", "sizes"] == (None, None, "[7]") and got["d", "kind"] == ("Oak", None, None) and got["d", "made"] == ("2023", None, None)  # a new node's time is now
    assert edges_of(out) == {("a", "Gamma", "wiki-link", "c"), ("a", "Beta", "near", "b"), ("a", "Nowhere", "near", None), ("a", "Gamma", "loose", "c"), ("b", "Alpha", "near", "a"), ("b", "Delta", "near", "d")}
    row = {r.id: r for r in out.nodes.collect()}
    assert (row["a"].version, row["a"].created_at, row["a"].file_mtime, row["a"].indexed_at) == (4, 30, 1_700_000_000_000, 1_700_000_000_000) and row["a"].content_hash not in (None, "h")
    assert (row["b"].version, row["b"].file_mtime, row["b"].content_hash) == (1, 11, "h") and row["d"].created_at == 1_700_000_000_000
    logged = {(r.node_id, r.event_type, json.loads(r.details)["field"]) for r in log.collect()}
    assert logged == {("a", "value-coerced", x) for x in ("size", "sizes", "kind", "near")} | {("d", "value-coerced", "sizes"), ("d", "field-defaulted", "kind"), ("d", "field-defaulted", "made")}
    again, log, _ = W.apply(out, proposal(spark, ("a", "A.md", "Alpha", "now [[Gamma]] `[[Beta]]`\n\n```\n[[Beta]]\n```", ["thing"], {"size": "5", "sizes": "[1,2.5]", "kind": '"Oak"', "near": '["Beta","Nowhere"]', "loose": '"see [[Gamma|g]]"', "made": '"x"'})), *dims)
    assert {r.id: r.version for r in again.nodes.collect()}["a"] == 4 and log.count() == 0


def test_issues_by_source(spark, g, dims):
    p = proposal(spark, ("a", "A.md", "Alpha", "", ["thing"], {"size": '"big"', "sizes": '["x",1,[2]]', "kind": "null", "near": "3"}), ("b", "B.md", "Beta", "", ["thing"], {"kind": '"Okk"', "made": "5"}))
    out, log, bad = W.apply(g, p, *dims)
    found = {(r.node_id, r.field, r.code): (r.closest, r.errors and len(r.errors)) for r in bad.collect()}
    assert found == {("a", "size", "TYPE_MISMATCH"): (None, None), ("a", "sizes", "LIST_ITEM_COERCION_FAILED"): (None, 2), ("a", "kind", "REQUIRED_MISSING"): (None, None), ("a", "near", "TYPE_MISMATCH"): (None, None), ("b", "kind", "ENUM_MISMATCH"): ("Oak", None)}
    assert {r.id: r.version for r in out.nodes.collect()} == {"a": 3, "b": 1, "c": 1} and log.count() == 0
    seen, log, _ = W.apply(g, p, *dims, source="watcher", at_ms=5)
    got = rows_of(seen)
    assert got["a", "size"] == (None, 4.0, None) and ("a", "kind") not in got and got["b", "made"] == ("5", None, None)  # the stored value stays
    assert {(r.node_id, json.loads(r.details)["field"], json.loads(r.details)["retained_value"]) for r in log.filter("event_type = 'value-rejected'").collect()} == {("a", "size", "4.0"), ("a", "sizes", None), ("a", "kind", None), ("a", "near", None), ("b", "kind", None)}
    lax, log, _ = W.apply(g, proposal(spark, ("b", "B.md", "Beta", "x", ["unknown"], {}), ("a", "A.md", "Alpha", "x", ["thing"], {})), *dims, source="normalizer")
    assert {r.id: r.version for r in lax.nodes.collect()} == {"a": 4, "b": 2, "c": 1} and log.count() == 0  # no defaults


@pytest.mark.parametrize("value,kind,item,want", [
    ('"0b101"', "number", None, "5"), ('"0o17"', "number", None, "15"), ("1.50", "number", None, "1.50"), ("5", "string", None, '"5"'), ("5.0", "string", None, '"5"'), ("true", "string", None, '"true"'), ("[1]", "string", None, None), ('"January 5, 2024"', "date", None, '"2024-01-05"'),
    ("5", "date", None, None), ('"a"', "list", None, None), ('["a",1]', "list", None, '["a",1]'), ('"3"', "list", "number", "[3]"), ('["yes",false,null]', "list", "boolean", "[true,false,null]"), ("{}", "reference", None, None), ("null", "number", None, None), ("5", "enum", None, '"5"'),
])
def test_dispatch(spark, value, kind, item, want):
    df = spark.createDataFrame([(value, kind, item, ["5", "Six"])], "v string, k string, i string, e array<string>")
    assert df.select(dispatch(F.col("v"), F.col("k"), F.col("i"), F.col("e")).alias("r")).first().r.value == want


def test_context_is_the_block(spark):
    body = "# On [[One]] **now**\nfirst line\nof [[Two|2]] a paragraph\n\n- item [[Three]]\n- [x] other\n\n| a | with [[Four|f]] |\n|---|---|\n```\n[[No]]\n```\n1. `[[No]]` " + "y" * 300 + " [[Five]]"
    got = {r.target: r.context for r in spark.createDataFrame([(body,)], "b string").select(links_in("b").alias("l")).first().l}
    assert got == {"One": "On [[One]] now\nfirst line\nof [[Two|2]] a paragraph", "Two": "On [[One]] now\nfirst line\nof [[Two|2]] a paragraph", "Three": "item [[Three]]", "Four": "with [[Four|f]]", "Five": "[[No]] " + "y" * 193}


def test_undo_brings_all_back(spark, g, dims):
    ops, snaps = table(spark, "undo_operations"), table(spark, "undo_snapshots")
    now = g
    steps = [("change", "a", lambda x: M.set_fields(x, x.nodes.filter("id = 'a'"), {"size": 9, "due": None})), ("drop", "a", lambda x: M.delete(x, x.nodes.filter("id = 'a'"))), ("name", "c", lambda x: W.rename(x, "c", "Other"))]
    for i, (name, node, change) in enumerate(steps):
        ops = U.begin(ops, name, i, "tool", "")
        mine = U.capture(now, now.nodes.filter(F.col("id") == node), name)
        after = change(now)
        now = Graph(*(cut(t) for t in (after.nodes, after.node_types, after.node_fields, after.relationships)))
        snaps = cut(snaps.unionByName(U.committed(now, mine, name)))
    assert ("b", "Alpha", "near", None) in edges_of(now) and "a" not in {r.id for r in now.nodes.collect()}
    back, done = U.undo(now, ops, snaps, [s[0] for s in steps])
    assert edges_of(back) == edges_of(g) and rows_of(back) == rows_of(g) and back.node_types.exceptAll(g.node_types).isEmpty()
    keep = ("id", "file_path", "title", "body", "file_mtime", "created_at")
    assert back.nodes.select(*keep).exceptAll(g.nodes.select(*keep)).isEmpty() and {r.status for r in done.collect()} == {"undone"}
    assert back.node_fields.filter("field_name = 'due'").first().value_date == "2024-01-01T00:00:00.000Z"
    # alone, the first operation has two later ones against it, unless it is told to go on
    reasons = lambda *ids: {(r.node_id, r.reason) for r in U.conflicts(now, ops, snaps, list(ids)).collect()}
    assert reasons("change") == {("a", "superseded_by_later_op")} and reasons("drop") == set()
    other = now.replace(nodes=now.nodes.unionByName(g.nodes.filter("id = 'a'").withColumn("id", F.lit("z"))))
    assert {(r.node_id, r.reason) for r in U.conflicts(other, ops, snaps, ["drop"]).collect()} == {("a", "path_occupied")}
    drifted = M.set_fields(now, now.nodes.filter("id = 'c'"), {"size": 1})
    assert {(r.node_id, r.reason) for r in U.conflicts(drifted, ops, snaps, ["name"]).collect()} == {("c", "modified_after_operation")}
    assert U.undo(drifted, ops, snaps, ["name"])[0].nodes.filter("title = 'Other'").count() == 1 and U.undo(drifted, ops, snaps, ["name"], ["c"])[0].nodes.filter("title = 'Gamma'").count() == 1


def test_dimensions_come_back_first(spark, g, dims):
    ops = U.begin(table(spark, "undo_operations"), "one", 1, "tool", "")
    held = U.capture_rows(dims[2], "name", ["thing", "fresh"], "one").select("operation_id", F.lit("schemas").alias("kind"), "name", "row").unionByName(spark.createDataFrame([("one", "schemas", "fresh", None)], "operation_id string, kind string, name string, row string"))
    after = table(spark, "schemas", [("thing", "Changed", None, None), ("fresh", None, None, None)])
    _, out, ops = U.undo_with(g, {"schemas": (after, "name")}, ops, table(spark, "undo_snapshots"), held, ["one"])
    assert [tuple(r) for r in out["schemas"].collect()] == [("thing", None, None, "things")] and ops.first().status == "undone"


def ops_table(spark, *rows):
    names = [c.split(" ")[0] for c in B.OPS.split(", ")]
    return spark.createDataFrame([tuple(({"seq": i} | r).get(n) for n in names) for i, r in enumerate(rows)], B.OPS)


def test_batch_is_all_or_none(spark, g, dims):
    good = [{"op": "update", "id": "a", "fields": {"size": "7", "due": "null"}, "title": "First"}, {"op": "update", "id": "a", "append": "more", "add_types": ["thing"]}, {"op": "delete", "id": "b"},
            {"op": "create", "id": "n", "title": "New/One", "types": ["thing"]}, {"op": "update", "id": "n", "fields": {"kind": '"elm"'}}, {"op": "update", "id": "c", "title": "x", "expected_version": 7}]
    out = B.run(g, ops_table(spark, *good), *dims)
    row = {r.id: r for r in out.graph.nodes.collect()}
    assert set(row) == {"a", "c", "n"} and (row["a"].title, row["a"].body, row["a"].version) == ("First", "to [[Beta]]\n\nmore", 5) and (row["n"].file_path, row["n"].version) == ("things/New-One.md", 2)
    assert rows_of(out.graph)["n", "kind"] == ("Elm", None, None) and out.errors.isEmpty() and ("a", "Beta", "wiki-link", None) in edges_of(out.graph)
    assert {(r.id, r.status) for r in out.status.collect()} == {("a", "applied"), ("b", "applied"), ("n", "applied"), ("c", "stale")}
    for bad, code in ((({"op": "update", "id": "a", "fields": {"size": '"big"'}}), "TYPE_MISMATCH"), ({"op": "update", "id": "zz"}, "NOT_FOUND"), ({"op": "create", "id": "q", "title": "Q", "types": ["none"]}, "UNKNOWN_TYPE"), ({"op": "paint", "id": "a"}, "UNKNOWN_OP"),
                      ({"op": "update", "id": "b"}, "OUT_OF_ORDER"), ({"op": "create", "id": "m", "title": "New-One", "types": ["thing"]}, "PATH_TAKEN"), ({"op": "update", "id": "a", "body": "x", "append": "y"}, "BODY_SET_AND_APPENDED")):
        tried = B.run(g, ops_table(spark, *good, bad), *dims)
        assert tried.graph is g and code in {r.code for r in tried.errors.collect()}, code


def test_a_batch_of_any_size_is_one_plan(spark, g, dims):
    size = lambda n: len(B.fold(ops_table(spark, *({"op": "update", "id": "a", "fields": {"size": str(i)}} for i in range(n))))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(1000) - size(2)) < 200


def test_versions_are_committed_at_once(spark, g, tmp_path):
    root = f"file://{tmp_path}/graph"
    assert versions(spark, root) == [] and save_version(g, root, -1) == 0
    assert save_version(M.delete(g, g.nodes.filter("id = 'a'")), root, 0) == 1
    assert load_version(spark, root).nodes.count() == 2 and load_version(spark, root, 0).nodes.count() == 3
    with pytest.raises(Conflict):  # made from the first version, like the one that won
        save_version(g, root, 0)
    assert versions(spark, root) == [0, 1] and load_version(spark, root).nodes.count() == 2


def test_nodes_do_not_meet_by_their_types(spark, dims):
    from quillgraph.operators import coerced as S

    p = cut(proposal(spark, *((f"x{i}", f"x{i}.md", f"x{i}", "", ["thing"], {"size": '"5"', "kind": '"elm"'}) for i in range(20))))
    state = S.coerced_state(p, *dims[:2])
    assert {r.value for r in state.filter("field = 'size'").collect()} == {"5"} and state.filter("origin = 'provided' and issue is null").count() == 40
    assert "Exchange hashpartitioning" not in state._jdf.queryExecution().executedPlan().toString()


def test_an_edge_nobody_moves_is_not_looked_up(spark, g, monkeypatch):
    asked = []
    once = W.resolve
    monkeypatch.setattr(W, "resolve", lambda nodes, targets: asked.append(1) or once(nodes, targets))
    moved = spark.createDataFrame([("c", "Gamma", "sub/Gamma.md")], "id string, title string, file_path string")
    out = W.refresh(g.relationships, g.nodes, moved)
    assert not asked and sorted(map(str, out.collect())) == sorted(map(str, g.relationships.collect()))
