"""Writing, undo, schemas, ingest, extraction and small rules on hand-made rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import coerce as CO
from quillgraph.functions import templates as TP
from quillgraph.functions.text import rewrite_links
from quillgraph.functions.values import classify
from quillgraph.operators import claims as C
from quillgraph.operators import mutate as M
from quillgraph.operators import nodes as N
from quillgraph.operators import schemas as SC
from quillgraph.operators import search as S
from quillgraph.operators import undo as U
from quillgraph.operators import write as W
from quillgraph.plans.filters import InvalidParams
from quillgraph.sources import extract as X
from quillgraph.sources import ingest as IN
from quillgraph.sources import markdown as MD
from quillgraph.sources import upgrade as UP
from quillgraph.tables import Graph, table


def build(spark, nodes, types=(), fields=(), edges=()):
    return Graph(spark.createDataFrame(nodes, "id string, file_path string, title string, body string, version int"),
                 spark.createDataFrame(list(types), "node_id string, schema_type string, sort_order int"),
                 spark.createDataFrame(list(fields), "node_id string, field_name string, value_text string, value_number double, value_date string, value_json string"),
                 spark.createDataFrame(list(edges), "source_id string, target string, rel_type string, resolved_target_id string"))


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("oak", "trees/Oak.md", "Oak", "grows near [[Pond|water]] and `[[Pond]]`", 1), ("pond", "Pond.md", "Pond", "see ![[map.png]] ![[Oak]]", 1), ("elm", "trees/Elm.md", "Elm", "[[pond]]", 4)]
    fields = [("oak", "place", "Pond", None, None, None), ("oak", "near", None, None, None, '["Pond","Hill"]'), ("elm", "height", None, 12.0, None, None)]
    edges = [("oak", "Pond", "place", "pond"), ("oak", "Pond", "wiki-link", "pond"), ("elm", "pond", "wiki-link", "pond"), ("elm", "Lake", "wiki-link", None)]
    return build(spark, nodes, [("oak", "tree", 0), ("elm", "tree", 0), ("pond", "place", 0)], fields, edges)


def fields_of(g, node):
    return {r.field_name: (r.value_text, r.value_number, r.value_date, r.value_json) for r in g.node_fields.filter(F.col("node_id") == node).collect()}


def test_values_round_trip(g):
    values = {"a": ["y", "z"], "b": True, "c": {"k": [1, None]}, "d": 3, "e": "text", "f": []}
    after = M.set_fields(g, g.nodes.filter("id = 'elm'"), {**values, "height": None})
    assert fields_of(after, "elm") == {k: classify(v) for k, v in values.items()}
    seen = {(r.id, r.field): (r.old, r.new, r.changed) for r in M.bulk_preview(after, {"node_ids": ["elm"]}, {"a": ["y", "z"], "b": True, "d": 3, "e": None}).collect()}
    assert seen == {("elm", "a"): ('["y","z"]', '["y","z"]', False), ("elm", "b"): ("true", "true", False), ("elm", "d"): ("3.0", "3.0", False), ("elm", "e"): ("text", None, True)}


def test_rename(g):
    after = W.rename(g, "pond", "Lake")
    row = {r.id: r for r in after.nodes.collect()}
    assert (row["pond"].title, row["pond"].file_path, row["pond"].version) == ("Lake", "Lake.md", 2)
    assert row["oak"].body == "grows near [[Lake|water]] and `[[Pond]]`" and row["oak"].version == 2
    assert row["elm"].body == "[[Lake]]" and row["elm"].version == 5
    assert fields_of(after, "oak") == {"place": ("Lake", None, None, None), "near": (None, None, None, '["Lake","Hill"]')}
    assert {(r.source_id, r.target, r.resolved_target_id) for r in after.relationships.collect()} == {("oak", "Lake", "pond"), ("elm", "Lake", "pond")}
    with pytest.raises(InvalidParams):
        W.rename(g, "none", "x")


def test_rewriting_leaves_code_and_quotes(spark):
    df = spark.createDataFrame([("[[a.b]] [[axb]] ```\n[[a.b]]\n``` [[a.b|x$1]]",)], "t string")
    assert df.select(rewrite_links("t", ["a.b"], "n$w\\e")).first()[0] == "[[n$w\\e]] [[axb]] ```\n[[a.b]]\n``` [[n$w\\e|x$1]]"


def test_get_node(g):
    with pytest.raises(InvalidParams):
        N.find(g)
    assert [r.id for r in N.find(g, title="POND").collect()] == ["pond"] and [r.id for r in N.find(g, file_path="trees/Elm.md").collect()] == ["elm"]
    r = N.full(g, N.find(g, title="Pond")).first()
    assert r.types == ["place"] and r.outgoing is None and {k: [(e.name, e.other) for e in v] for k, v in r.incoming.items()} == {"place": [("Oak", "oak")], "wiki-link": [("Elm", "elm"), ("Oak", "oak")]}
    assert {r.id: (r.fields, r.outgoing, r.incoming) for r in N.delete_preview(g, g.nodes).collect()} == {"oak": (2, 2, 0), "elm": (1, 2, 0), "pond": (0, 0, 3)}


def test_apply(spark, g):
    fields = table(spark, "global_fields", [("height", "number", None, None, True, True, True, True, None), ("kind", "enum", ["leaf", "needle"], '"leaf"', True, True, True, True, None)])
    claims = table(spark, "claims", [("tree", "height", None, None, 1, None, False, None, None), ("tree", "kind", None, None, 2, None, False, None, None)])
    schemas = table(spark, "schemas", [("tree", None, None, None)])
    kind = "id string, file_path string, title string, body string, types array<string>, fields map<string,string>"
    rows = [("elm", "trees/Elm.md", "Elm", "[[pond]]", ["tree"], {"height": "12"}), ("fir", "Fir.md", "Fir", "", ["tree"], {"height": '"tall"'}), ("yew", "Yew.md", "Yew", "", ["bush"], {"height": "3"})]
    out, log, bad = W.apply(g, spark.createDataFrame(rows, kind), claims, fields, schemas, at_ms=5)
    assert {r.id: r.version for r in out.nodes.collect()} == {"oak": 1, "pond": 1, "elm": 5}  # a bad value and an unknown type are refused
    assert fields_of(out, "elm")["kind"][0] == "leaf" and [(r.node_id, r.event_type) for r in log.collect()] == [("elm", "field-defaulted")]
    assert {(r.node_id, r.code) for r in bad.collect()} == {("fir", "TYPE_MISMATCH")}
    again, log, _ = W.apply(out, spark.createDataFrame([("elm", "trees/Elm.md", "Elm", "[[pond]]", ["tree"], {"height": "12", "kind": '"leaf"'})], kind), claims, fields, schemas)
    assert {r.id: r.version for r in again.nodes.collect()} == {"oak": 1, "pond": 1, "elm": 5} and log.count() == 0
    seen, log, _ = W.apply(out, spark.createDataFrame([("elm", "trees/Elm.md", "Elm", "new", ["tree"], {"height": '"tall"', "kind": '"leaf"'})], kind), claims, fields, schemas, "watcher")
    assert fields_of(seen, "elm")["height"][1] == 12.0 and [r.event_type for r in log.collect()] == ["value-rejected"]


def test_batch_and_move(g):
    out, skipped, counts = W.batch(g, [{"op": "set_fields", "id": "elm", "fields": {"x": 1}}, {"op": "add_types", "id": "elm", "types": ["old"]}, {"op": "delete", "id": "pond"}], {"pond": 7})
    assert skipped == ["pond"] and counts == {"set_fields": 1, "add_types": 1}
    assert out.nodes.count() == 3 and out.nodes.filter("id = 'elm'").first().version == 6
    with pytest.raises(InvalidParams):
        W.batch(g, [{"op": "paint", "id": "elm"}])
    assert {r.file_path for r in W.move(g, g.nodes.filter("id = 'elm'"), "old/").nodes.collect()} == {"trees/Oak.md", "Pond.md", "old/Elm.md"}


def test_undo(spark, g):
    ids = g.nodes.filter("id in ('oak', 'elm')")
    snaps = U.capture(g, ids, "one").unionByName(U.capture(g, spark.createDataFrame([("new",)], "id string"), "one"))
    ops = U.begin(table(spark, "undo_operations"), "one", 10, "tool", "")
    changed = M.set_fields(g, ids, {"place": "x", "height": 1, "near": True})
    changed = changed.replace(nodes=changed.nodes.unionByName(spark.createDataFrame([("new", "n.md", "N", "", 1)], changed.nodes.schema)))
    back, ops = U.undo(changed, ops, snaps, ["one"])
    assert all(fields_of(back, n) == fields_of(g, n) for n in ("oak", "elm", "pond")) and {r.id for r in back.nodes.collect()} == {"oak", "elm", "pond"}
    assert [r.status for r in ops.collect()] == ["undone"] and U.finish(ops, snaps).first().node_count == 3
    later = U.begin(ops.withColumn("status", F.lit("active")), "two", 20, "tool", "")
    kept, _ = U.undo(changed, later, snaps.unionByName(U.capture(changed, ids.filter("id = 'oak'"), "two")), ["one"])
    assert fields_of(kept, "oak") == fields_of(changed, "oak") and fields_of(kept, "elm") == fields_of(g, "elm")
    assert W.next_time(later, 5) == 21
    dims = table(spark, "schemas", [("tree", "T", None, None)])
    held = U.capture_rows(dims, "name", ["tree", "new"], "op")
    assert U.put_back(table(spark, "schemas", [("tree", "other", None, None), ("new", "N", None, None)]), "name", held, ["tree", "new"]).collect() == dims.collect()


def test_schema_edits(spark, g):
    fields = table(spark, "global_fields", [("place", "string", None, None, False, False, True, True, None), ("height", "number", None, None, False, True, True, True, None)])
    claims = table(spark, "claims", [("tree", "place", None, None, 1, True, False, None, None), ("tree", "height", None, None, 1, None, False, None, ["a"]), ("tree", "gone", None, None, 1, None, False, None, None)])
    assert {(r.field, r.code) for r in SC.claim_issues(claims, fields).collect()} == {("place", "OVERRIDE_NOT_ALLOWED"), ("height", "STRUCTURAL_INCOMPAT"), ("gone", "UNKNOWN_FIELD")}
    less = SC.edit_claims(claims, "tree", remove=["height"])
    assert {r.field for r in less.collect()} == {"place", "gone"}
    assert [(r.field_name, r.n) for r in SC.orphaned_by(g, claims, less).collect()] == [("height", 1)]
    with pytest.raises(InvalidParams):
        SC.edit_claims(claims, "tree", remove=["place"], replace=less)
    with pytest.raises(InvalidParams):
        SC.retype(g, "place", "number")
    out, log = SC.retype(g, "place", "number", discard=True)
    assert fields_of(out, "oak").keys() == {"near"} and [r.event_type for r in log.collect()] == ["value-removed"]
    a, b, c = SC.rename_field(g, claims, fields, "place", "spot")
    assert "spot" in fields_of(a, "oak") and {r.rel_type for r in a.relationships.collect()} == {"spot", "wiki-link"} and b.filter("field = 'spot'").count() == c.filter("name = 'spot'").count() == 1
    assert SC.widget("list") == "tags" and SC.check_hints({"label": "x" * 81, "colour": 1}) == ["unknown hint colour", "label is longer than 80"]
    assert SC.columns([{"name": "a", "field_type": "string", "widget": "textarea"}, {"name": "b", "field_type": "number"}]) == ["title", "b"]


def test_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.md").write_text('---\ntypes: [note]\nlink: "see [[B]] there"\n---\n[[B]]')
    (tmp_path / "B.md").write_text("plain")
    (tmp_path / ".sync-conflict-1.md").write_text("no")
    (tmp_path / "a.sync-conflict-1.md").write_text("yes")
    empty = Graph(*(table(spark, n) for n in ("nodes", "node_types", "node_fields", "relationships")))
    g, log, counts = IN.index(empty, MD.read_folder(spark, f"file://{tmp_path}"), 7)
    assert {r.action: r.n for r in counts.collect()} == {"indexed": 3, "errors": 0}
    assert {r.target for r in g.relationships.filter("resolved_target_id is not null").collect()} == {"B"}
    assert g.node_fields.filter("field_name = 'link'").first().value_raw_text == "see [[B]] there" and log.count() == 3
    g = Graph(*(spark.createDataFrame(df.collect(), df.schema) for df in (g.nodes, g.node_types, g.node_fields, g.relationships)))
    (tmp_path / "B.md").unlink()
    (tmp_path / "sub" / "A.md").write_text("now plain")
    after, log, counts = IN.index(g, MD.read_folder(spark, f"file://{tmp_path}"), 9)
    assert {r.action: r.n for r in counts.collect()} == {"indexed": 1, "skipped": 1, "deleted": 1, "errors": 0}
    assert {(r.file_path, r.version) for r in after.nodes.collect()} == {("sub/A.md", 2), ("a.sync-conflict-1.md", 1)} and after.relationships.count() == 0
    assert {r.event_type for r in log.collect()} == {"file-indexed", "file-deleted"}


def test_files(tmp_path):
    path = str(tmp_path / "x" / "a.yaml")
    h = IN.write_file(path, "one")
    IN.write_file(path, "two", h)
    with pytest.raises(ValueError):
        IN.write_file(path, "three", h)
    with pytest.raises(RuntimeError):
        IN.with_backup([path], lambda: (IN.write_file(path, "bad"), (_ for _ in ()).throw(RuntimeError())))
    assert open(path).read() == "two"
    claims = [{"field": "b"}, {"field": "a", "sort_order": 1, "required_override": True}]
    hashes, blocked = IN.render_schemas(str(tmp_path), {"tree": claims}, {})
    assert open(tmp_path / "tree.yaml").read() == "name: tree\nfields:\n  - field: a\n    sort_order: 1\n    required_override: true\n  - field: b\n" and not blocked
    (tmp_path / "tree.yaml").write_text("edited")
    assert IN.render_schemas(str(tmp_path), {"tree": claims}, hashes)[1] == ["tree"] and not IN.delete_schema_file(str(tmp_path), "tree", hashes["tree"])


def test_extraction(spark, g):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>Hello </w:t><w:t>you</w:t></w:p><w:p><w:t>bye</w:t></w:p></w:d>')
    files = spark.createDataFrame([("a/x.docx", buf.getvalue()), ("b/y.txt", b"text"), ("z.docx", b"broken"), ("map.png", b"p"), ("old/map.png", b"q")], "file_path string, content binary")
    got = X.extract(files).collect()
    assert {r.text for r in got} == {"Hello you\nbye", "text", None} and sum(r.error is not None for r in got) == 1
    assert X.extract(files, spark.createDataFrame(got, "content_hash string, text string, error string")).count() == 3
    assert {r.file_path: r.available for r in X.availability(files).collect()}["map.png"] is False
    sized = files.select("file_path", F.length("content").alias("size"))
    assert X.read_embedded(sized, "y.txt").first().file_path == "b/y.txt" and X.read_embedded(sized.filter("file_path <> 'map.png'").unionByName(sized.filter("file_path = 'map.png'").withColumn("file_path", F.lit("n/map.png"))), "map.png").first().status == "AMBIGUOUS_FILENAME"
    rows, errors = X.assemble(g, sized, g.nodes.filter("id = 'pond'"))
    assert [(r.depth, r.place, r.ref, r.file_path) for r in rows.orderBy("place").collect()] == [(0, 1, "map.png", "map.png"), (0, 2, "Oak", "trees/Oak.md")] and errors.count() == 0
    _, errors = X.assemble(g, sized.filter("file_path not like '%map%'"), g.nodes.filter("id = 'pond'"), max_embeds=0)
    assert {(r.ref, r.code) for r in errors.collect()} == {("map.png", "TRUNCATED")}
    notes = [("r", "r.md", "r", "![[a]] ![[a]] ![[r]] ![[none]]", 1), ("a", "a.md", "a", "![[b]] ![[x.bin]]", 1), ("b", "b.md", "b", "![[c]]", 1), ("c", "c.md", "c", "![[d]] ![[a]]", 1), ("d", "d.md", "d", "![[e]]", 1), ("e", "e.md", "e", "![[f]]", 1), ("f", "f.md", "f", "![[h]]", 1), ("h", "h.md", "h", "![[b]]", 1)]
    deep = build(spark, notes)
    paths = spark.createDataFrame([(n[1], 5) for n in notes] + [("x.bin", 99)], "file_path string, size long")
    rows, errors = X.assemble(deep, paths, deep.nodes.filter("id = 'r'"), max_bytes=50, texts=deep.nodes.select("file_path", F.col("body").alias("text")))
    got = [(r.ref, r.depth, r.source) for r in rows.orderBy("place").collect()]
    assert got == [("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c"), ("e", 4, "d"), ("f", 5, "e"), ("a", 3, "c"), ("a", 0, None), ("r", 0, None)]  # six levels, each embed listed
    assert {(r.ref, r.code) for r in errors.collect()} == {("x.bin", "FILE_TOO_LARGE"), ("none", "UNRESOLVED")} and rows.filter("ref = 'b'").first().text == "![[c]]"
    rows, errors = X.assemble(deep, paths, deep.nodes.filter("id = 'r'"), max_embeds=3)
    assert rows.count() == 3 and sorted((r.ref, r.code) for r in errors.collect()) == [("a", "TRUNCATED"), ("d", "TRUNCATED"), ("x.bin", "TRUNCATED")]  # one for each list that is cut


def test_small_rules(spark):
    assert TP.since_ms("2h", 10_000_000) == 2_800_000 and TP.since_ms("1970-01-01T00:00:01Z", 0) == 1000 and TP.since_ms("soon", 0) is None
    assert TP.safe_path("/r", "a/../b") == "/r/b"
    with pytest.raises(InvalidParams):
        TP.safe_path("/r", "../rx")
    assert [w["operator"] for w in TP.operator_warnings({"a": {"includes": 1}, "b": {"eq": 1, "gt": 2}, "c": {"gt": 1}}, {"a": "string", "b": "list"})] == ["includes", "eq", "gt"]
    df = spark.range(1)
    assert df.select(TP.title_warnings(F.lit("a[b]|[c"))).first()[0] == ["[", "]", "|"]
    assert df.select(CO.wrap_list(F.lit("x"), "number").alias("r")).first().r.ok is False and df.select(CO.wrap_list(F.lit("2"), "number").alias("r")).first().r.values == ["2.0"]
    talk = spark.createDataFrame([([(1, 3725.5, "hi"), (2, 5.0, "yo")],)], "p array<struct<speaker:int,start:double,text:string>>")
    assert talk.select(TP.transcript(F.col("p"))).first()[0] == "[Speaker 1] 01:02:05\nhi\n\n[Speaker 2] 00:00:05\nyo"
    assert TP.size_text(512) == "512 B" and TP.size_text(3 << 20) == "3.0 MB"


def test_chunks():
    assert S.chunk("") == [] and S.chunk("  as it is \n", 10) == ["  as it is \n"]
    text = "# A\none two three\n\nfour five six\n## B\nseven. Eight nine ten. (eleven) twelve. thirteen x. y z"
    # the last sentence has six words: it is cut by characters, six a word, with one word's worth in common
    assert S.chunk(text, 5, 1) == ["# A\none two three", "four five six", "## B\nseven.", "Eight nine ten.", "(eleven) twelve. thirteen x. y", "n x. y z"]
    hard = "x" * 1000
    pieces = S.chunk(hard, 100, 10, len)  # a token a character: hard cuts with an overlap
    assert all(len(p) <= 100 for p in pieces) and pieces[0] + "".join(p[10:] for p in pieces[1:]) == hard
    assert S.chunk("a. b c. D e", 3, 0) == ["a. b c.", "D e"]  # no sentence begins with a small letter
    assert S.chunk("p one\n\n\np two\n\np three four five", 4, 0) == ["p one\n\np two", "p three four five"]


def test_upgrades(spark):
    df = UP.columns(spark.createDataFrame([("a", 5)], "id string, indexed_at long"), "nodes")
    assert UP.created_at(df).first().created_at == 5 and UP.columns(df, "nodes").columns == df.columns
    f = UP.split_overrides(spark.createDataFrame([("a", True)], "name string, overrides_allowed boolean")).first()
    assert (f.ov_required, f.ov_default, f.ov_enum) == (True, True, False)
    c = UP.claim_overrides(spark.createDataFrame([("s", "f", None, "x")], "schema_name string, field string, required boolean, default_value string")).first()
    assert c.default_overridden and c.default_override == "x" and c.required_override is None


def test_vectors(spark):
    chunks = spark.createDataFrame([("a", "node", None, 0, "h1"), ("a", "extraction", "m.pdf", 0, "h2"), ("b", "extraction", "old.pdf", 0, "h3")], "node_id string, source_type string, extraction_ref string, chunk_index int, content_hash string")
    fresh = chunks.filter("node_id = 'a' and source_type = 'node'").withColumn("content_hash", F.lit("new"))
    assert {r.content_hash for r in S.replace_group(chunks, fresh).collect()} == {"new", "h2", "h3"}
    assert {r.content_hash for r in S.prune_extractions(chunks, spark.createDataFrame([("a", "m.pdf")], "node_id string, extraction_ref string")).collect()} == {"h1", "h2"}
    v = S.hashed_vectors(spark.createDataFrame([("one two",), ("two one",), ("three",)], "content string"), 16).collect()
    assert v[0].vector == v[1].vector != v[2].vector and abs(sum(x * x for x in v[2].vector) - 1) < 1e-9
    meta = spark.createDataFrame([("search_version", "1")], "key string, value string")
    assert S.needs_rebuild(meta, "2") and not S.needs_rebuild(meta, "1")
    wide = S.ranked(spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7), F.desc("x")).collect()
    assert all(r.rank == 1000 - r.x for r in wide)


def test_retry_and_sweep(spark):
    tries = spark.createDataFrame([("a", 0, False), ("a", 3000, False), ("b", 0, False), ("b", 1, True), ("c", 9000, False)], "file_path string, ms long, ok boolean")
    assert [(r.file_path, r.tries) for r in IN.retry(tries, 10_000).collect()] == [("a", 2)]
    states = spark.createDataFrame([(0, "x", "x"), (0, "x", "y"), (9_999_999, "x", "y")], "file_mtime long, content_hash string, rendered_hash string")
    assert {r.status: r.n for r in IN.sweep(states, 10_000_000).collect()} == {"unchanged": 1, "rewritten": 1, "skipped": 1}


def test_a_filter_over_edges_is_few_scans(spark):
    from quillgraph.plans.compiler import compile_filter
    from quillgraph.sources.adapter import stored_graph

    g = stored_graph(spark, "/root/testdata/sf0.001")
    spec = {"types": ["order"], "join_filters": [{"rel_type": "customer", "target": {"types": ["customer"], "fields": {"mktsegment": {"eq": "BUILDING"}}}}]}
    plan = compile_filter(g, spec)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") < 10
    assert C.issues  # imported for the schema tests


def test_a_small_operation_writes_few_rows(spark, monkeypatch):
    from quillgraph import tables
    from quillgraph.operators import graph as GR

    n = 600
    big = build(spark, [(f"n{i}", f"n/n{i}.md", f"n{i}", f"[[n{i + 1}]]", 1) for i in range(n)], [(f"n{i}", "tree", 0) for i in range(n)], [(f"n{i}", "size", None, 1.0, None, None) for i in range(n)], [(f"n{i}", f"n{i + 1}", "wiki-link", f"n{i + 1}" if i + 1 < n else None) for i in range(n)])
    written = []

    def counted(df):
        out = tables.cut(df)
        written.append(out.count())
        return out

    for module in (W, U, GR):
        monkeypatch.setattr(module, "cut", counted, raising=False)
    ids = spark.createDataFrame([("n7",), ("n6",)], "id string")
    snaps = U.capture(big, ids, "one")
    after = W.rename(big, "n7", "Seven")
    ops = U.begin(table(spark, "undo_operations"), "one", 10, "tool", "")
    back, _ = U.undo(after, ops, U.committed(after, snaps, "one"), ["one"])
    assert {(r.target, r.resolved_target_id) for r in after.relationships.filter("source_id = 'n6'").collect()} == {("Seven", "n7")}
    assert sorted(back.relationships.collect()) == sorted(big.relationships.collect()) and max(written) < 20


def test_orphans_and_order_shuffle_once(spark, g):
    by_node = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(node_id")
    claims = table(spark, "claims", [("tree", "place", None, None, 3, None, False, None, None), ("tree", "near", None, None, 1, None, False, None, None), ("place", "place", None, None, 2, None, False, None, None)])
    two = g.replace(node_types=g.node_types.unionByName(spark.createDataFrame([("oak", "place", 1)], g.node_types.schema)))
    less = claims.filter("not (schema_name = 'tree' and field = 'place') and field <> 'near'")
    lost = SC.orphaned_by(two, claims, less)  # another type still claims the place
    assert by_node(lost) == 1 and [(r.field_name, r.n) for r in lost.collect()] == [("near", 1)]
    names = W.field_order(two.node_fields, two.node_types, claims)
    assert by_node(names) == 1 and {r.node_id: r.names for r in names.collect()} == {"oak": ["near", "place"], "elm": ["height"]}


def test_lists_are_resolved_once_for_all_roots(spark, monkeypatch):
    calls = []
    once = X.resolve_embeds
    monkeypatch.setattr(X, "resolve_embeds", lambda *a: calls.append(1) or once(*a))
    chain = build(spark, [(f"n{i}", f"n{i}.md", f"n{i}", f"![[n{i + 1}]]" if i < 4 else "", 1) for i in range(5)])
    rows, errors = X.assemble(chain, spark.createDataFrame([(f"n{i}.md", 5) for i in range(5)], "file_path string, size long"), chain.nodes.select("id"), max_depth=2)
    assert len(calls) == 1 and errors.count() == 0
    assert {(r.root, r.depth, r.ref) for r in rows.collect()} == {(f"n{i}", d, f"n{i + d + 1}") for i in range(4) for d in range(3) if i + d + 1 < 5}
