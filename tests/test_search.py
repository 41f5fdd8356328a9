"""The text query language against SQLite's full-text engine, and the index kept up to date against a fresh one."""

import random
import sqlite3

import pytest

from quillgraph.operators import search as S
from quillgraph.operators import textquery as Q

WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta9", "alp"]


def corpus(n=60, seed=2):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", ".", ",", "-x"]) for _ in range(rng.randint(0, k)))
    return [(i, text(3), text(14)) for i in range(1, n)] + [(n, None, None), (n + 1, "", "alpha " * 30)]


def sqlite(rows, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, body)")
    db.executemany("insert into t(rowid, title, body) values (?, ?, ?)", rows)
    try:
        return {i: -r for i, r in db.execute("select rowid, bm25(t) from t where t match ?", (query,))}
    except sqlite3.Error:
        return {}


QUERIES = [
    "alpha", "alpha beta", "alpha AND beta OR gamma", "alpha OR beta gamma", "alpha NOT beta", "alpha NOT beta NOT gamma", "alpha OR beta NOT gamma", "(alpha OR beta) AND gamma", "(alpha OR beta) NOT (gamma OR delta)", "alpha beta NOT gamma",
    '"alpha beta"', '"alpha beta gamma"', "alpha + beta", "alp*", '"beta alp" *', "alpha + bet*", "title:alpha", "body : beta", "title : alpha OR body : beta", "{title body} : alpha", "- title : alpha", "-{title body}:alpha", "title:(alpha OR beta)", "body:(alpha NOT title:beta)",
    "NEAR(alpha beta)", "NEAR(alpha beta, 1)", "NEAR(alpha gamma delta, 3)", 'NEAR("alpha beta" gamma, 2)', "body:NEAR(alpha beta, 0)", "NEAR(alpha) beta", "NEAR(alp* delta, 2) OR zeta9", "^alpha", "title:^beta", "^ alpha + beta", "epsilon", "ÉPSILON", "x", '"alpha-x"',
    "alpha-x", "alpha AND", "OR alpha", "(alpha", "alpha)", "nope:alpha", "alpha (beta OR gamma)", "(alpha) beta", "NEAR(alpha, x)", "", "  ", '"unclosed', "alpha NOT", "a:b:c", '""', '"" alpha', 'alpha OR "..."', "and", "near", '"AND"', "NEAR alpha", "beta*alpha", "alpha ** beta", "{title} alpha",
]


def test_language(spark):
    rows = corpus()
    index = S.build_index(spark.createDataFrame(rows, "id long, title string, body string").repartition(3).cache())
    index = S.Index(index.postings.cache(), index.size.cache())
    wrong = []
    for q in QUERIES:
        want, got = sqlite(rows, q), {r.id: r.score for r in S.match(index, q).collect()}
        if got.keys() != want.keys() or ("NEAR" not in q and any(abs(got[k] - want[k]) > 1e-9 for k in want)):
            wrong.append((q, sorted(got.keys() ^ want.keys())[:5], [(k, got[k], want[k]) for k in want if k in got and abs(got[k] - want[k]) > 1e-9][:2]))
    assert not wrong, "\n".join(map(str, wrong))
    assert sum(bool(sqlite(rows, q)) for q in QUERIES) > 35


def test_tree():
    assert Q.parse("a b NOT c OR d") == Q.Node("or", Q.Node("not", Q.Node("and", Q.Phrase(("a",)), Q.Phrase(("b",))), Q.Phrase(("c",))), Q.Phrase(("d",)))
    assert Q.parse("title : (a OR body : b)") == Q.Node("or", Q.Phrase(("a",), ("title",)), Q.Phrase(("b",), ()))
    for bad in ("a AND", "(a", "x : a", 'a "b', "NEAR(a, b)", "a + * b"):
        with pytest.raises(Q.Unreadable):
            Q.parse(bad)


def test_index_follows_changes(spark, tmp_path):
    rows = corpus()
    frame = lambda r: spark.createDataFrame(r, "id long, title string, body string")
    path = f"file://{tmp_path}/index"
    S.create_segments(frame(rows[:40]), path)
    first = [(i, t, f"{b} beta omega") for i, t, b in rows[5:12]]  # changed
    S.update_segments(spark, path, frame(first + rows[40:]), frame([(rows[0][0], None, None), (999, None, None)]).select("id"))
    S.update_segments(spark, path, frame([(rows[6][0], "alpha", "omega omega"), (rows[0][0], "back", "alpha")]), frame([(rows[7][0], None, None)]).select("id"))
    now = {r[0]: r for r in rows}
    now |= {r[0]: r for r in first}
    del now[rows[0][0]], now[rows[7][0]]
    now |= {rows[6][0]: (rows[6][0], "alpha", "omega omega"), rows[0][0]: (rows[0][0], "back", "alpha")}
    fresh = S.build_index(frame(list(now.values())))

    def same():
        for q in ("alpha", "omega OR back", "beta NOT omega", "title:alpha", "zeta*"):
            assert {r.id: round(r.score, 9) for r in S.match(S.load_segments(spark, path), q).collect()} == {r.id: round(r.score, 9) for r in S.match(fresh, q).collect()}, q

    same()
    assert S.load_segments(spark, path).size.first().n == len(now) and S.segments(spark, path) == [0, 1, 2]
    S.compact(spark, path)
    same()
    assert len(S.segments(spark, path)) == 1
    S.update_segments(spark, path, frame([(5000, "alpha", "late")]), None)
    assert 5000 in {r.id for r in S.match(S.load_segments(spark, path), "alpha").collect()} and len(S.segments(spark, path)) == 2


def test_postings_are_made_in_the_row(spark):
    from quillgraph.operators import search as S
    from quillgraph.operators import textquery as Q

    docs = spark.createDataFrame([(1, "A b", "b a b"), (2, None, None), (3, "", "x")], "id long, title string, body string")
    made = S.postings_of(docs)
    rows = {(r.id, r.len, r.term): r.places for r in made.collect()}
    assert rows == {(1, 5, "a"): [0, Q.BODY + 1], (1, 5, "b"): [1, Q.BODY, Q.BODY + 2], (3, 1, "x"): [Q.BODY]}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
