"""The filter compiler, graph operators, claims, coercion, ingest, mutations and streams on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.coerce import coerce, coerce_list
from quillgraph.functions.text import closest, embeds, like_ci, nfc, rewrite_links, snippet, wiki_links
from quillgraph.operators import claims as C
from quillgraph.operators import discovery as D
from quillgraph.operators import graph as G
from quillgraph.operators import mutate as M
from quillgraph.operators import page as P
from quillgraph.operators import search as S
from quillgraph.plans.compiler import compile_filter
from quillgraph.plans.filters import InvalidParams, NodeFilter, Page
from quillgraph.sources import markdown as MD
from quillgraph.streaming import debounce as E
from quillgraph.tables import Graph, load, save, table


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("kestrel", "birds/raptors/kestrel.md", "Common Kestrel", "hovers over verges", 500), ("siskin", "birds/siskin.md", "Siskin", "in alders", 1500),
             ("box7", "boxes/box-7.md", "Box Seven", "faces east", 2500), ("walk", "walks/2023 spring.md", "Spring Walk", "along the weir", 3500)]
    types = [("kestrel", "bird", 0), ("kestrel", "ringed", 1), ("siskin", "ringed", 0), ("box7", "box", 0), ("walk", "outing", 0)]
    f = lambda n, k, t=None, x=None, d=None, j=None: (n, k, t, x, d, j)
    fields = [f("kestrel", "wingspan", x=76.0), f("kestrel", "colours", j='["rufous","grey"]'), f("kestrel", "ring", "AX-19"), f("kestrel", "seen", "2023-03-02"), f("kestrel", "protected", j="true"), f("kestrel", "phase", "breeding"),
              f("siskin", "colours", j='["green"]'), f("siskin", "ring", "QR-4"), f("siskin", "seen", "2023-05-20"), f("siskin", "phase", "moult"),
              f("box7", "height", x=3.0), f("box7", "owner", "parish"), f("box7", "seen", d="2023-08-11"), f("box7", "phase", "breeding"), f("walk", "legacy_note", "muddy")]
    edges = [("kestrel", "Box Seven", "nests_in", "box7"), ("siskin", "Old Barn", "nests_in", None), ("walk", "Siskin", "wiki-link", "siskin")]
    return Graph(spark.createDataFrame(nodes, "id string, file_path string, title string, body string, file_mtime long").withColumn("version", F.lit(1)),
                 spark.createDataFrame(types, "node_id string, schema_type string, sort_order int"),
                 spark.createDataFrame(fields, "node_id string, field_name string, value_text string, value_number double, value_date string, value_json string"),
                 spark.createDataFrame(edges, "source_id string, target string, rel_type string, resolved_target_id string"))


@pytest.mark.parametrize("spec,want", [
    ({}, "box7 kestrel siskin walk"), ({"types": ["bird", "ringed"]}, "kestrel"), ({"without_types": ["ringed"]}, "box7 walk"), ({"fields": {"wingspan": {"exists": True}}}, "kestrel"),
    ({"fields": {"wingspan": {"exists": False, "eq": "zzz"}}}, "box7 siskin walk"), ({"fields": {"ring": {"eq": "ax-19"}}}, ""), ({"fields": {"ring": {"ne": "QR-4"}}}, "kestrel"),
    ({"fields": {"height": {"eq": 3}}}, "box7"), ({"fields": {"height": {"eq": "3"}}}, ""), ({"fields": {"seen": {"gte": "2023-05-01", "lt": "2023-09-01"}}}, "box7 siskin"),
    ({"fields": {"colours": {"contains": "GREEN"}}}, "siskin"), ({"fields": {"colours": {"includes": "grey"}}}, "kestrel"), ({"fields": {"protected": {"includes": True}}}, "kestrel"),
    ({"fields": {"ring": {"one_of": ["QR-4", "x"]}}}, "siskin"), ({"fields": {"seen": {"one_of": ["2023-08-11"]}}}, ""), ({"without_fields": ["wingspan", "legacy_note"]}, "box7 siskin"),
    ({"fields": {"ring": {"eq": "AX-19"}, "seen": {"exists": True}, "colours": {"includes": "rufous"}}}, "kestrel"),
    ({"references": {"target": "Box Seven"}}, "kestrel"), ({"references": {"target": "box seven"}}, ""), ({"references": {"target": "box-7.md", "direction": "incoming"}}, "kestrel"),
    ({"references": {"target": "Box Seven", "direction": "both"}}, "kestrel"), ({"references": {"target": "nothing", "direction": "incoming"}}, ""),
    ({"title_eq": "SISKIN"}, "siskin"), ({"title_contains": "n_k"}, "kestrel"), ({"without_titles": ["siskin"]}, "box7 kestrel walk"), ({"path_prefix": "BIRDS"}, "kestrel siskin"), ({"path_dir": ""}, ""), ({"path_dir": "birds"}, "siskin"),
    ({"modified_since": "1970-01-01T00:00:02Z"}, "box7 walk"), ({"join_filters": [{"rel_type": "nests_in"}]}, "kestrel"), ({"join_filters": [{"target": {"types": ["box"]}}]}, "kestrel"),
    ({"join_filters": [{"direction": "incoming", "rel_type": ["wiki-link", "x"]}]}, "siskin"), ({"without_joins": [{"rel_type": "nests_in"}]}, "box7 siskin walk"), ({"node_ids": []}, "box7 kestrel siskin walk"), ({"without_node_ids": ["walk"]}, "box7 kestrel siskin"),
])
def test_filters(g, spec, want):
    assert sorted(r.id for r in compile_filter(g, spec).collect()) == want.split()


@pytest.mark.parametrize("spec", [{"join_filters": [{}]}, {"join_filters": [{"target": {"join_filters": [{"rel_type": "x"}]}}]}, {"fields": {"a": {"one_of": []}}}, {"nope": 1}, {"fields": {"a": {"like": 1}}}])
def test_invalid_filters(spec):
    with pytest.raises(InvalidParams):
        NodeFilter.parse(spec)


def test_pages(g):
    with pytest.raises(InvalidParams):
        Page(limit=201)
    assert [r.id for r in P.page(g, {}, Page("file_mtime", "desc", 2, 1)).collect()] == ["box7", "siskin"]
    row = {r.id: r for r in P.enrich(g, P.page(g, {}), ["*"]).collect()}["kestrel"]
    assert row.types == ["bird", "ringed"] and row.field_count == 6 and row.fields["ring"] == "AX-19"


def test_resolver_tiers(spark):
    nodes = spark.createDataFrame([("a", "x/Note.md", "T"), ("b", "Note.md", "U"), ("c", "y/other.md", "Note"), ("d", "z/Café.md", "V")], "id string, file_path string, title string")
    got = {r.target: r.id for r in G.resolve(nodes, spark.createDataFrame([(t,) for t in ("Note.md", "Note", "note", "NOTE.MD", "café", "x/Note.md", "none")], "target string")).collect()}
    assert got == {"Note.md": "b", "Note": "c", "note": "b", "café": "d", "x/Note.md": "a"}


def test_expand_and_backfill(g):
    got = {(r.root, r.id) for r in G.expand(g, g.nodes).collect()}
    assert got == {("kestrel", "box7"), ("box7", "kestrel"), ("walk", "siskin"), ("siskin", "walk")}
    lost = g.replace(relationships=G.forget(g.relationships, g.nodes.filter("id = 'box7'")))
    assert lost.relationships.filter("resolved_target_id is null").count() == 2
    assert G.backfill(lost).filter("resolved_target_id = 'box7'").count() == 1


def test_discovery(spark, g):
    claims = table(spark, "claims", [("box", "owner", None, None, 1, True, False, None, None)])
    assert {r.field_name for r in D.orphan_counts(g, claims).collect()} >= {"legacy_note", "wingspan"}
    assert [(r.value, r.n) for r in D.field_values(g, "ring", ["ringed", "bird"]).orderBy("value").collect()] == [("AX-19", 2), ("QR-4", 1)]
    assert D.infer_type(g, "wingspan").first().proposed_type == "number"
    assert D.infer_type(g, "seen").first().proposed_type == "string"


def test_merge_claims(spark):
    fields = table(spark, "global_fields", [("f", "string", None, '"g"', False, True, True, True, None), ("h", "string", None, None, False, True, True, True, None)])
    claims = table(spark, "claims", [("a", "f", None, None, 1000, True, True, '"x"', None), ("b", "f", "B", "d", 7, True, True, '"y"', None), ("c", "f", "C", None, 3, False, False, None, None), ("a", "h", None, None, 1, None, True, None, None), ("a", "zz", None, None, 1, None, False, None, None)])
    lists = spark.createDataFrame([("ab", ["a", "b"]), ("ac", ["a", "c"]), ("cb", ["c", "b"])], "key string, types array<string>")
    got = {(r.key, r.field): r for r in C.merge_claims(lists, claims, fields).collect()}
    assert ("ab", "zz") not in got
    r = got["ab", "f"]
    assert (r.label, r.description, r.sort_order, r.required, r.default_value, r.default_source, r.claiming_types) == ("B", "d", 7, True, '"g"', "global", "a,b")
    assert got["ac", "f"].required is False and got["ac", "f"].default_value == '"x"'
    assert got["cb", "f"].label == "C" and got["cb", "f"].sort_order == 3
    assert got["ab", "h"].default_value is None and got["ab", "h"].default_source == "claim"


def test_enum_values_per_type(spark, g):
    fields = table(spark, "global_fields", [("phase", "enum", ["breeding", "moult"], None, False, True, True, True, None)])
    found = lambda *c: {(r.node_id, r.code) for r in C.issues(g, claims(*c), fields).collect()}
    claims = lambda *c: table(spark, "claims", [(t, "phase", None, None, 1, None, False, None, v) for t, v in c])
    assert found(("bird", None), ("ringed", None), ("box", None)) == set()
    assert found(("bird", ["moult"]), ("box", ["moult"])) == {("kestrel", "ENUM_MISMATCH"), ("box7", "ENUM_MISMATCH")}
    assert found(("bird", ["moult"]), ("ringed", None)) == set()  # the other type's list is the global one
    assert found(("bird", ["moult"]), ("ringed", ["egg", "breeding"])) == {("siskin", "ENUM_MISMATCH")}
    assert found(("box", [])) == {("box7", "ENUM_MISMATCH")}
    lists = spark.createDataFrame([("br", ["bird", "ringed"]), ("r", ["ringed"])], "key string, types array<string>")
    got = {r.key: r.enum_lists for r in C.merge_claims(lists, claims(("bird", ["moult"]), ("ringed", None)), fields).collect()}
    assert got == {"br": [["moult"], ["breeding", "moult"]], "r": None}
    assert [tuple(r) for r in C.claim_diff(claims(("box", ["a"]), ("ringed", None)), claims(("box", ["b"]), ("ringed", None))).collect()] == [("box", "phase", "changed")]


@pytest.mark.parametrize("kind,value,want", [
    ("number", " 1e3 ", (True, "1000.0", "STRING_TO_NUMBER")), ("number", "0x10", (True, "16.0", "STRING_TO_NUMBER")), ("number", "Infinity", (False, None, None)), ("number", "", (False, None, None)),
    ("date", "2024-02-30", (False, None, None)), ("date", " 2024-02-29 ", (True, "2024-02-29", "STRING_TO_DATE")), ("date", "2024-02-29T10:00Z", (True, "2024-02-29T10:00Z", "STRING_TO_DATE")),
    ("boolean", "YES", (True, "true", "STRING_TO_BOOLEAN")), ("boolean", "1", (False, None, None)), ("reference", "[[A|b]]", (True, "A", "STRING_TO_REFERENCE")), ("reference", " A ", (True, "A", None)),
    ("enum", "open", (True, "Open", "STRING_TO_ENUM")), ("enum", "Open", (True, "Open", None)), ("enum", "opne", (False, None, None)), ("string", "x", (True, "x", None)), ("number", None, (True, None, None)),
])
def test_coercion(spark, kind, value, want):
    r = spark.createDataFrame([(value,)], "v string").select(coerce(F.col("v"), kind, ["Open", "Closed"]).alias("r")).first().r
    assert (r.ok, r.value, r.code) == want


def test_functions(spark):
    df = spark.createDataFrame([("É[[a|b]] `[[no]]` ![[pic.png|x]]\n```\n[[no]]\n```\n[[c]]",)], "v string")
    r = df.select(wiki_links("v"), embeds("v"), like_ci("v", "é%"), like_ci("v", "É[[A%"), nfc(F.lit("é")), F.array_join(closest(F.lit("opne"), ["Open", "Closed"]), ",")).first()
    assert list(r) == [["a", "c"], ["pic.png"], False, True, "é", "Open"]
    r = spark.createDataFrame([(["1", "x"],)], "v array<string>").select(coerce_list(F.col("v"), "number").alias("r")).first().r
    assert not r.ok and r.bad == 1


BM = [(1, "Café plan", "alpha beta"), (2, "x", "alpha alpha"), (3, "y", "gamma"), (4, "don't stop", "e-mail foo_bar"), (5, "beta", "delta gamma epsilon zeta"), (6, "z", "theta"), (7, "w", "iota"), (8, "v", "kappa")]


@pytest.mark.parametrize("q,want", [
    ("alpha", {2: 1.356209792942168, 1: 0.8882219066452227}), ("alpha beta", {1: 1.7764438132904454}), ("beta OR gamma", {5: 1.5965507689066027, 3: 1.1466137340329239, 1: 0.8882219066452227}),
    ('"gamma epsilon"', {5: 1.3445936989955776}), ("kap*", {8: 1.9313254949209206}), ("foo", {4: 1.118135812848954}), ("alpha NOT beta", {2: 1.356209792942168}), ("e-mail", {}), ("cafe", {1: 1.118135812848954}),
])
def test_full_text(spark, q, want):
    got = {r.id: r.score for r in S.match(S.build_index(spark.createDataFrame(BM, "id long, title string, body string")), q).collect()}
    assert got.keys() == want.keys()
    if q != "cafe":
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_fusion_sums_over_chunks(spark):
    chunks = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "a", [0.1, 0.0]), (3, "b", [5.0, 0.0])], "id long, node_id string, vector array<double>").withColumns({"source_type": F.lit("node"), "chunk_index": F.lit(0)})
    text = spark.createDataFrame([("b", 2.0)], "id string, score double")
    got = {r.node_id: (round(r.score, 9), r.sources) for r in S.fuse(text, S.nearest(chunks, [0.0, 0.0])).collect()}
    assert got == {"a": (round(1 / 61 + 1 / 62, 9), "semantic"), "b": (round(1 / 61 + 1 / 63, 9), "fts,semantic")}
    marks = spark.createDataFrame([("the Alpha day",), ("x" * 60 + "alpha" + "y" * 200,), ("none",)], "t string").select(snippet("t", ["alpha"]).alias("s")).collect()
    assert [r.s for r in marks] == ["the <mark>Alpha</mark> day", "..." + "x" * 40 + "<mark>alpha</mark>" + "y" * 102 + "...", None]
    assert max(len(c.split()) for c in S.chunk("# A\n" + "w " * 500 + "\n\n# B\nshort", 100, 10)) <= 100


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.md").write_text("no")
    (tmp_path / "sub" / "Multi.md").write_text('---\ntypes: [outing, "[[ringed]]"]\nday: "[[2023-05-20]]"\ncount: 1\nwho:\n  - "[[Jo|J]]"\n  - Kim\n---\nFrom [[Hide]] `[[no]]`\n```\n[[no]]\n```\n')
    (tmp_path / "bad.md").write_text('---\nkey: "unterminated\n---\nbody')
    (tmp_path / "plain.md").write_text("no front")
    files = MD.read_folder(spark, f"file://{tmp_path}")
    parsed = {r.file_path: r for r in MD.parse_files(files).collect()}
    assert set(parsed) == {"sub/Multi.md", "bad.md", "plain.md"}
    m = parsed["sub/Multi.md"]
    assert m.title == "Multi" and m.types == ["outing", "ringed"] and m.fields["count"] == "1" and m.fields["who"] == '["Jo", "Kim"]'
    assert {(x.target, x.field) for x in m.links} == {("2023-05-20", "day"), ("Jo", "who"), ("Hide", None)}
    assert parsed["bad.md"].parse_error and parsed["bad.md"].body.startswith("---")
    nodes, types, fields, edges = MD.tables(MD.parse_files(files))
    assert fields.filter("field_name = 'count' and value_number = 1").count() == 1 and edges.count() == 3 and types.count() == 2
    known = nodes.select("file_path", F.lit("old").alias("content_hash"), F.lit(0).alias("file_mtime")).filter("file_path != 'plain.md'").unionByName(spark.createDataFrame([("gone.md", "h", 1)], "file_path string, content_hash string, file_mtime long"))
    assert {r.file_path: r.action for r in MD.changes(files, known).collect()} == {"sub/Multi.md": "changed", "bad.md": "changed", "plain.md": "added", "gone.md": "deleted"}
    text = MD.render(["task"], {"b": "x", "a": "Alice", "n": 3, "z": None}, ["a"], "Body\n", frozenset({"a"}))
    assert text == '---\ntypes:\n  - task\na: "[[Alice]]"\nb: x\nn: 3\n---\nBody\n'
    assert MD.render(["t"], {"d": dt.date(2024, 1, 2)}, [], "") == '---\ntypes:\n  - t\nd: "2024-01-02"\n---\n'


def test_mutations(spark, g, tmp_path):
    assert M.bulk_update(g, {}, {"ring": "x"}) is g
    after = M.bulk_update(g, {"types": ["ringed"]}, {"ring": "x", "wingspan": None}, dry_run=False)
    assert after.node_fields.filter("field_name = 'ring' and value_text = 'x'").count() == 2
    assert after.node_fields.filter("field_name = 'wingspan'").count() == 0
    assert {r.id: r.version for r in after.nodes.collect()} == {"kestrel": 2, "siskin": 2, "box7": 1, "walk": 1}
    typed = M.change_types(g, g.nodes.filter("id = 'kestrel'"), ["box"], ["ringed"])
    assert [r.schema_type for r in typed.node_types.filter("node_id = 'kestrel'").orderBy("sort_order").collect()] == ["bird", "box"]
    rest = M.delete(g, g.nodes.filter("id = 'siskin'"))
    assert rest.nodes.count() == 3 and {(r.source_id, r.resolved_target_id) for r in rest.relationships.collect()} == {("kestrel", "box7"), ("walk", None)}
    save(rest, f"{tmp_path}/v1")
    assert load(spark, f"{tmp_path}/v1").nodes.count() == 3
    up = M.upsert(g.nodes, spark.createDataFrame([("kestrel", "p.md", "T", "b", 5, 1), ("wren", "q.md", "Q", "b", 5, 1)], g.nodes.schema))
    assert {r.id: r.version for r in up.collect()} == {"kestrel": 2, "siskin": 1, "box7": 1, "walk": 1, "wren": 1}


def test_debounce(spark):
    assert E.cut([0, 1000, 2000, 3000, 4000, 5000, 6000], list("aaaaaaa")) == [("a", 0, 4000, 5), ("a", 5000, 6000, 2)]
    ev = spark.createDataFrame([("p", "add", 0), ("p", "change", 1000), ("p", "change", 9000), ("q", "unlink", 5)], "path string, event string, ms long")
    assert sorted((r.path, r.event, r.n) for r in E.debounce(ev).collect()) == [("p", "change", 1), ("p", "change", 2), ("q", "unlink", 1)]
    assert {r.path: r.event for r in E.latest(ev).collect()} == {"p": "change", "q": "unlink"}
    assert E.suppressed(ev, spark.createDataFrame([("p", 0)], "path string, ms long")).count() == 2


def test_debounce_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("p", "add", t0), ("p", "change", t0 + dt.timedelta(seconds=1)), ("p", "change", t0 + dt.timedelta(seconds=9)), ("z", "add", t0 + dt.timedelta(seconds=300))]
    schema = "path string, event string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = E.debounce_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([("z", "add", t0 + dt.timedelta(seconds=600))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        assert {(r.path, r.n) for r in spark.sql("select * from bursts").collect()} >= {("p", 2), ("p", 1)}
    finally:
        q.stop()


def test_the_store_shuffles_keys_and_sorts_nothing(spark, tmp_path):
    from quillgraph.sources.adapter import graph
    from quillgraph.tables import _open_files, get, put

    edges = graph(spark, "/root/testdata/sf0.001").relationships
    shuffles = [x for x in edges._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert shuffles and all("l_orderkey" in x and "supplier:" not in x and "Part-" not in x for x in shuffles)
    name = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(name)
    with _open_files(spark, 9):
        assert spark.conf.get(name) == "9"
    assert spark.conf.get(name) == was
    rows = spark.range(300).selectExpr("id", "cast(id % 70 as string) as kind")  # more kinds than files side by side
    put(rows, f"file://{tmp_path}/t", "kind")
    assert sorted(get(spark, f"file://{tmp_path}/t", "kind").collect()) == sorted(rows.collect()) and spark.conf.get(name) == was
