"""Queries of the text language and of the index that follows its documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import search as S
from .queries import _BM, _docs, _index, query
from .sources import extract as X
from .tables import Graph, own_folder, stored

_TOK = "list_filter(regexp_split_to_array(translate(lower({0}), '" + S.ACCENTS[0] + "', '" + S.ACCENTS[1] + "'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _words(*words: str) -> str:
    """Places in ``w`` where the words stand side by side; the last may be a prefix."""
    test = lambda k, x: f"w[i + {k}] LIKE '{x[:-1]}%'" if x.endswith("*") else f"w[i + {k}] = '{x}'"
    return f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {' AND '.join(test(k, x) for k, x in enumerate(words))})"


def _close(a: str, b: str, n: int) -> str:
    """Places of ``a`` with a place of ``b`` at most ``n`` words between."""
    return f"list_filter({a}, lambda i: len(list_filter({b}, lambda j: abs(i - j) <= {n + 1})) > 0)"


def _search(name: str, text: str, counted: list[tuple[str, str]], where: str, worth: list[str]) -> None:
    """``counted``: of each phrase the places that count and those of the phrase alone; ``worth``: when each counts."""
    tf = ", ".join(f"len({a}) AS tf{i}, len({b}) > 0 AS h{i}" for i, (a, b) in enumerate(counted))
    df = ", ".join(f"count(*) FILTER (h{i}) AS d{i}" for i in range(len(counted)))
    sums = " + ".join(f"CASE WHEN {w} THEN greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg)) ELSE 0 END" for i, w in enumerate(worth))
    sql = f"""WITH b AS (SELECT doc_id AS id, {_TOK.format("'doc-' || doc_id")} AS t, {_TOK.format("coalesce(text, '')")} AS w FROM documents), q AS (SELECT id, len(t) + len(w) AS len, len(t) > 0 AND list_contains(t, 'doc') AS titled, {tf} FROM b),
 d AS (SELECT count(*) AS n, avg(len) AS avg, {df} FROM q) SELECT id, round({sums}, 9) AS score FROM q, d WHERE {where}"""
    query(name, sql)(lambda s, d: S.match(_index(s, d), text).select("id", F.round("score", 9).alias("score")))


_THE, _THIN, _AND, _OF = _words("the"), _words("thin"), _words("and"), _words("of")
_BOTH = lambda a: (a, a)
_search("r02_not", "the NOT thin", [_BOTH(_THE), _BOTH(_THIN)], "tf0 > 0 AND tf1 = 0", ["TRUE", "FALSE"])
_search("r02_phrase", '"of the"', [_BOTH(_words("of", "the"))], "tf0 > 0", ["TRUE"])
_search("r02_prefix", '"the thin" *', [_BOTH(_words("the", "thin*"))], "tf0 > 0", ["TRUE"])
_search("r02_column", "title : the OR body : thin", [("[]", "[]"), _BOTH(_THIN)], "tf1 > 0", ["FALSE", "TRUE"])
_search("r02_near", "NEAR(the thin, 3)", [(_close(_THE, _THIN, 3), _THE), (_close(_THIN, _THE, 3), _THIN)], "tf0 > 0", ["TRUE", "TRUE"])
_search("r02_nested", "(the AND thin OR and) NOT (of OR title : nothing)", [_BOTH(_THE), _BOTH(_THIN), _BOTH(_AND), _BOTH(_OF)], "((tf0 > 0 AND tf1 > 0) OR tf2 > 0) AND tf3 = 0", ["tf0 > 0 AND tf1 > 0", "tf0 > 0 AND tf1 > 0", "tf2 > 0", "FALSE"])


def _followed(s, d) -> str:
    """An index of other and older documents, brought up to date by two updates."""

    def make(path: str) -> None:
        docs = _docs(s, d)
        old = docs.filter("id % 4 <> 3").withColumn("body", F.when(F.col("id") % 5 == 0, F.concat(F.lit("thin the "), F.reverse("body"))).otherwise(F.col("body")))
        extra = docs.filter("id % 6 = 0").withColumn("id", -F.col("id") - 1)
        S.create_segments(old.unionByName(extra), path)
        S.update_segments(s, path, docs.filter("id % 5 = 0 and id % 4 <> 3"), extra.filter("id % 12 <> -1").select("id"))
        S.update_segments(s, path, docs.filter("id % 4 = 3"), extra.select("id"))

    return stored(s, "followed", [f"{d}/documents.parquet"], make)


@query("k05_search", _BM)
def _search_followed(s, d):
    return S.match(S.load_segments(s, _followed(s, d)), "the thin").select("id", F.round("score", 9).alias("score"))


@query("k05_compacted", _BM)
def _search_compacted(s, d):
    path = own_folder(s, "compacted")
    docs = _docs(s, d)
    S.create_segments(docs.filter("id % 2 = 0"), path)
    S.update_segments(s, path, docs.filter("id % 2 = 1"), None)
    S.compact(s, path)
    return S.match(S.load_segments(s, path), "the thin").select("id", F.round("score", 9).alias("score"))


@query("k05_size", "SELECT count(*) AS n FROM documents")
def _size(s, d):
    return S.load_segments(s, _followed(s, d)).size.select("n")


def _notes(s, d) -> Graph:
    """Documents as notes that embed the two below them in a heap, the first once more, and a file that may be too large."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("k"))
    link = lambda e: F.concat(F.lit("![[note-"), (e).cast("string"), F.lit("]] "))
    body = F.concat(link(F.col("k") * 2 + 1), link(F.col("k") * 2 + 2), F.lit("![[pic-"), (F.col("k") % 7).cast("string"), F.lit(".txt]] "), link(F.col("k") * 2 + 1))
    nodes = docs.select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("notes/note-"), F.col("k").cast("string"), F.lit(".md")).alias("file_path"), F.concat(F.lit("note-"), F.col("k").cast("string")).alias("title"), body.alias("body"), F.lit(1).alias("version"))
    none = lambda ddl: s.createDataFrame([], ddl)
    return Graph(nodes, none("node_id string, schema_type string, sort_order int"), none("node_id string, field_name string, value_text string, value_number double, value_date string, value_json string"), none("source_id string, target string, rel_type string, resolved_target_id string"))


def _assembled(s, d) -> str:
    def make(path: str) -> None:
        g = _notes(s, d)
        pics = s.range(7).select(F.concat(F.lit("pics/pic-"), F.col("id").cast("string"), F.lit(".txt")).alias("file_path"), F.when(F.col("id") == 3, 5000).otherwise(10).cast("long").alias("size"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
        files = g.nodes.select("file_path", F.length("body").cast("long").alias("size"), F.col("body").alias("text")).unionByName(pics)
        rows, errors = X.assemble(g, files, g.nodes.select("id"), max_embeds=10_000, max_bytes=1000, texts=files)
        rows.write.parquet(f"{path}/rows")
        errors.write.parquet(f"{path}/errors")

    return stored(s, "assembled", [f"{d}/documents.parquet"], make)


_N = "(SELECT max(doc_id) FROM documents)"
_WALK = f"""WITH RECURSIVE e AS (SELECT d.doc_id AS k, p, CASE p WHEN 2 THEN 'pic-' || CAST(d.doc_id % 7 AS VARCHAR) || '.txt' WHEN 1 THEN 'note-' || CAST(2 * d.doc_id + 2 AS VARCHAR) ELSE 'note-' || CAST(2 * d.doc_id + 1 AS VARCHAR) END AS ref,
  CASE p WHEN 2 THEN NULL WHEN 1 THEN 2 * d.doc_id + 2 ELSE 2 * d.doc_id + 1 END AS child, d.doc_id % 7 AS pic FROM documents d, (SELECT unnest([0, 1, 2, 3]) AS p) x),
 good AS (SELECT *, CASE WHEN p = 2 AND pic = 3 THEN 'FILE_TOO_LARGE' WHEN p <> 2 AND child NOT IN (SELECT doc_id FROM documents) THEN 'UNRESOLVED' END AS code FROM e),
 t AS (SELECT k AS root, 0 AS depth, [p] AS path, ref, CAST(NULL AS VARCHAR) AS source, child, p, code, pic FROM good UNION ALL SELECT t.root, t.depth + 1, list_append(t.path, g.p), g.ref, t.ref, g.child, g.p, g.code, g.pic FROM t JOIN good g ON g.k = t.child WHERE t.code IS NULL AND t.p IN (0, 1) AND t.depth < 5)"""


@query("s18_assemble", _WALK + """ SELECT 'n' || CAST(root AS VARCHAR) AS root, CAST(row_number() OVER (PARTITION BY root ORDER BY path) AS INTEGER) AS place, depth, source, ref, CASE WHEN p = 2 THEN 'pics/' || ref ELSE 'notes/' || ref || '.md' END AS file_path, 'n' || CAST(child AS VARCHAR) AS node_id,
 CASE WHEN p = 2 THEN 'text ' || CAST(pic AS VARCHAR) ELSE '![[note-' || CAST(2 * child + 1 AS VARCHAR) || ']] ![[note-' || CAST(2 * child + 2 AS VARCHAR) || ']] ![[pic-' || CAST(child % 7 AS VARCHAR) || '.txt]] ![[note-' || CAST(2 * child + 1 AS VARCHAR) || ']] ' END AS text FROM t WHERE code IS NULL""")
def _assemble(s, d):
    return s.read.parquet(f"{_assembled(s, d)}/rows").select("root", "place", "depth", "source", "ref", "file_path", "node_id", "text")


@query("s18_errors", _WALK + " SELECT 'n' || CAST(root AS VARCHAR) AS root, ref, code FROM t WHERE code IS NOT NULL")
def _assemble_errors(s, d):
    return s.read.parquet(f"{_assembled(s, d)}/errors").select("root", "ref", "code")


class _LetterModel:
    """A stand-in for a model: letters counted by their code; so that the rows can be said in SQL."""

    def __call__(self):
        import numpy as np

        def predict(texts):
            texts = np.asarray(texts).reshape(-1)
            return np.array([[t.count(c) for c in "abcdefgh"] for t in texts], np.float32)

        return predict


@query("r09_embed", "SELECT doc_id AS node_id, CAST(0 AS INTEGER) AS chunk_index, [" + ", ".join(f"CAST(length('search_query: ' || coalesce(text, '')) - length(replace('search_query: ' || coalesce(text, ''), '{c}', '')) AS FLOAT)" for c in "abcdef") + "] AS vector FROM documents")
def _embed(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("node_id"), F.col("text").alias("content"))
    return S.embed(docs, _LetterModel(), 6, "search_query", size=10**9)


@query("t01_events", """SELECT 'docs/' || doc_id || '.md' AS path, CASE WHEN doc_id % 5 = 0 THEN 'add' ELSE 'change' END AS event, doc_id AS ms FROM documents WHERE doc_id % 5 < 2 UNION ALL SELECT 'docs/-' || doc_id || '.md', 'unlink', 77 FROM documents WHERE doc_id % 3 = 0""")
def _listing_events(s, d):
    """Two listings of the documents: some added, some changed in time or size, some gone."""
    from .streaming import listing as L

    docs = s.read.parquet(f"{d}/documents.parquet")
    k = F.col("doc_id")
    name = lambda e: F.concat(F.lit("docs/"), e.cast("string"), F.lit(".md")).alias("path")
    after = docs.select(name(k), k.alias("ms"), F.col("n_chars").cast("long").alias("size"))
    old = docs.filter(k % 5 != 0).select(name(k), F.when((k % 5 == 1) & (k % 2 == 0), k - 1).otherwise(k).alias("ms"), (F.col("n_chars") + F.when((k % 5 == 1) & (k % 2 == 1), 1).otherwise(0)).cast("long").alias("size"))
    gone = docs.filter(k % 3 == 0).select(F.concat(F.lit("docs/-"), k.cast("string"), F.lit(".md")).alias("path"), k.alias("ms"), F.lit(1).cast("long").alias("size"))
    return L.difference(old.unionByName(gone), after, 77)
