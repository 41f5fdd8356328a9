"""Full-text, vector and fused search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..tables import commit, cut, manifest, versions
from . import textquery as Q

K1, B = 1.2, 0.75
RRF = 60
NEAREST = 400
SLICE = 256  # documents whose words are gathered at once
CELLS = 64  # folders of an index; a term's rows lie in one
ACCENTS = Q.ACCENTS


def tokens(c: Column) -> Column:
    """Words of letters and digits, in lower case and without Latin-1 marks."""
    return F.filter(F.split(F.translate(F.lower(c), *ACCENTS), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass(frozen=True)
class Index:
    """``postings(id, len, term, places, cell)`` and ``size(n, avg)``, one row."""

    postings: DataFrame
    size: DataFrame


def postings_of(docs: DataFrame) -> DataFrame:
    """``id, len, term, places, cell`` of ``docs(id, title, body)``; places of the body begin at ``BODY``."""
    words = lambda c: tokens(F.coalesce(c, F.lit("")))
    kind = dict(docs.dtypes)["id"]
    # a document's places are gathered in its row, without a shuffle
    postings = docs.select("id", words("title").alias("t"), words("body").alias("b")).mapInArrow(_gather, f"id {kind}, len int, term string, places array<int>")
    return postings.withColumn("cell", F.pmod(F.xxhash64("term"), F.lit(CELLS)).cast("int"))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, len, term, places`` of ``id`` and the words of title and body: (document, term) pairs sorted as numbers."""
    names = ["id", "len", "term", "places"]
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            ids, *texts = batch.slice(start, SLICE).columns
            sizes = [np.asarray(c.value_lengths()) for c in texts]
            row = np.concatenate([np.repeat(np.arange(len(ids)), n) for n in sizes])
            if not len(row):
                continue
            place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base for n, base in zip(sizes, (0, Q.BODY))])
            coded = pa.concat_arrays([c.flatten() for c in texts]).dictionary_encode()
            key = row * len(coded.dictionary) + np.asarray(coded.indices)
            order = np.argsort(key, kind="stable")  # a title's places come before the body's
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            at = order[first]
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[at])), pa.array(sum(sizes)[row[at]], pa.int32()), coded.dictionary.take(coded.indices.take(pa.array(at))), places], names)


def lengths(docs: DataFrame) -> DataFrame:
    """``id, len`` of every document, also of those without a word."""
    count = lambda c: F.size(tokens(F.coalesce(c, F.lit(""))))
    return docs.select("id", (count("title") + count("body")).alias("len"))


def build_index(docs: DataFrame) -> Index:
    """Postings over title and body; one pass over the texts, whatever is asked later."""
    return Index(postings_of(docs), lengths(docs).agg(F.count("*").alias("n"), F.avg("len").alias("avg")))


def save_postings(postings: DataFrame, path: str) -> None:
    """Postings lie by term, so that a query reads the files and row groups of its terms."""
    rows = postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(4)))  # a common term is no task of its own
    rows.repartition("cell", "salt").drop("salt").sortWithinPartitions("cell", "term").write.mode("overwrite").partitionBy("cell").parquet(path)


def save_index(index: Index, path: str) -> None:
    save_postings(index.postings, f"{path}/postings")
    index.size.write.mode("overwrite").parquet(f"{path}/size")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/size"))


# An index that follows its documents: segments of postings, each with the documents it holds. A document's rows count in the
# last segment that names it; ``docs`` of a segment has a null length for one that is gone. The running totals lie in the manifest.


def segments(spark: SparkSession, path: str) -> list[int]:
    return manifest(spark, path).get("segments", [])


def create_segments(docs: DataFrame, path: str) -> None:
    """The first segment, of all documents."""
    spark = docs.sparkSession
    n, total = _write_segment(docs, None, path, 0)
    commit(spark, path, 0, {"segments": [0], "next": 1, "n": n, "total": total})


def _write_segment(docs: DataFrame, gone: DataFrame | None, path: str, number: int) -> tuple[int, int]:
    folder = f"{path}/{number}"
    save_postings(postings_of(docs), f"{folder}/postings")
    have = lengths(docs)
    (have if gone is None else have.unionByName(gone.select("id", F.lit(None).cast("int").alias("len")))).write.mode("overwrite").parquet(f"{folder}/docs")
    r = docs.sparkSession.read.parquet(f"{folder}/docs").agg(F.count("len").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
    return r.n, r.t


def _docs_of(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    out = None
    for k in numbers:
        part = spark.read.parquet(f"{path}/{k}/docs").select("id", "len", F.lit(k).alias("segment"))
        out = part if out is None else out.unionByName(part)
    return out


def update_segments(spark: SparkSession, path: str, changed: DataFrame | None, deleted: DataFrame | None) -> None:
    """A further segment with documents ``changed(id, title, body)``, new or changed, and the ids ``deleted``: only these are
    read and written. Totals move by what the documents had and have. A concurrent update raises ``Conflict``."""
    was = manifest(spark, path)
    number = was["next"]
    like = changed if changed is not None else deleted.select("id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("body")).limit(0)
    gone = None if deleted is None else deleted.select("id").distinct().join(like.select("id"), "id", "left_anti")
    n, total = _write_segment(like, gone, path, number)
    touched = spark.read.parquet(f"{path}/{number}/docs").select("id")
    old = _docs_of(spark, path, was["segments"]).join(touched, "id", "left_semi").groupBy("id").agg(F.max_by("len", "segment").alias("len"))
    r = old.agg(F.count("len").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
    commit(spark, path, versions(spark, path)[-1] + 1, {"segments": [*was["segments"], number], "next": number + 1, "n": was["n"] + n - r.n, "total": was["total"] + total - r.t})


def load_segments(spark: SparkSession, path: str) -> Index:
    """The index as of the last commit. Postings of a document that a later segment names are left out by an anti join of the
    rows a query asked for; a filter on terms reaches every segment's scan."""
    m = manifest(spark, path)
    numbers, out = m["segments"], None
    for k in numbers:
        part = spark.read.parquet(f"{path}/{k}/postings")
        later = [x for x in numbers if x > k]
        if later:
            part = part.join(_docs_of(spark, path, later).select("id").distinct(), "id", "left_anti")
        out = part if out is None else out.unionByName(part)
    size = spark.range(1).select(F.lit(m["n"]).cast("long").alias("n"), F.lit(m["total"] / m["n"] if m["n"] else None).cast("double").alias("avg"))
    return Index(out, size)


def compact(spark: SparkSession, path: str) -> None:
    """All segments as one; readers of earlier commits keep theirs."""
    was = manifest(spark, path)
    number = was["next"]
    save_postings(load_segments(spark, path).postings, f"{path}/{number}/postings")
    live = _docs_of(spark, path, was["segments"]).groupBy("id").agg(F.max_by("len", "segment").alias("len")).filter("len is not null")
    live.write.mode("overwrite").parquet(f"{path}/{number}/docs")
    commit(spark, path, versions(spark, path)[-1] + 1, {**was, "segments": [number], "next": number + 1})


def match(index: Index, query: str) -> DataFrame:
    """``id, score`` by BM25 of what the query language (``textquery``) asks for. A query that can't be read, or has no word,
    gives no rows. Only the postings of its terms are read; a document's lists meet in one row."""
    try:
        tree = Q.parse(query)
    except Q.Unreadable:
        tree = None
    if tree is None:
        return index.postings.select("id", F.lit(0.0).alias("score")).limit(0)
    groups = Q.atoms(tree)
    every = list(dict.fromkeys((p, a if isinstance(a, Q.Near) else None) for a in groups for p in (a.phrases if isinstance(a, Q.Near) else [a])))
    terms = list(dict.fromkeys(w for p, _ in every for w in p.words))
    whole = [t for t in terms if not t.endswith("*")]
    wanted = F.lit(False)
    if whole:
        cells = index.postings.sparkSession.range(1).select(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(CELLS)).cast("int") for t in whole)).first()
        wanted = F.col("term").isin(whole) & (F.col("cell").isin(sorted(set(cells))))
    for t in terms:
        if t.endswith("*"):
            wanted |= F.col("term").startswith(t[:-1])
    is_term = lambda t: F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t
    rows = index.postings.filter(wanted).groupBy("id").agg(F.first("len").alias("len"), *(F.flatten(F.collect_list(F.when(is_term(t), F.col("places")))).alias(f"p{i}") for i, t in enumerate(terms)))
    plain = list(dict.fromkeys(p for p, _ in every))
    rows = rows.select("id", "len", *(Q.starts(p, lambda t: F.col(f"p{terms.index(t)}")).alias(f"s{i}") for i, p in enumerate(plain)))
    near = [a for a in groups if isinstance(a, Q.Near)]
    rows = rows.select("*", *(F.array(*Q.clumps(a, [F.col(f"s{plain.index(p)}") for p in a.phrases])).alias(f"n{k}") for k, a in enumerate(near)))
    places = lambda p, a: F.col(f"s{plain.index(p)}") if a is None else F.get(f"n{near.index(a)}", a.phrases.index(p))
    counted = rows.select("id", "len", *(F.size(places(p, a)).alias(f"tf{i}") for i, (p, a) in enumerate(every)), *((F.size(f"s{i}") > 0).alias(f"h{i}") for i in range(len(plain))))
    df = counted.agg(*(F.count_if(f"h{i}").alias(f"df{i}") for i in range(len(plain))))  # of the phrase alone, wherever it is near
    at = lambda a: [every.index((p, a)) for p in a.phrases] if isinstance(a, Q.Near) else [every.index((a, None))]
    here = lambda a: F.col(f"tf{at(a)[0]}") > 0

    def worth(a) -> Column:
        out = F.lit(0.0)
        for i in at(a):
            t, d, n = F.col(f"tf{i}"), F.col(f"df{plain.index(every[i][0])}"), F.col("n")
            out += F.greatest(F.log((n - d + 0.5) / (d + 0.5)), F.lit(1e-6)) * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("avg")))
        return out

    ok, score = Q.truth(tree, here), Q.score(tree, here, worth)
    return counted.filter(ok).crossJoin(F.broadcast(index.size.crossJoin(df))).select("id", score.alias("score"))  # one row each


def distance(query: list[float], col: str = "vector") -> Column:
    return F.sqrt(F.aggregate(F.zip_with(F.col(col), F.array(*(F.lit(float(x)) for x in query)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def nearest(chunks: DataFrame, query: list[float], k: int = NEAREST) -> DataFrame:
    """``id, node_id, source_type, distance, rank`` of the nearest chunks over all: a filter applies afterwards."""
    top = chunks.withColumn("distance", distance(query)).orderBy("distance", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id"))).select(*(c for c in ("id", "node_id", "source_type", "extraction_ref", "chunk_index") if c in chunks.columns), "distance", "rank")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rank`` from 1 in one order over all rows, without a task that holds all: rows are sorted by range, each range is
    counted, and a row's rank is its place in its range behind the ranges before."""
    rows = cut(rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))  # sorted once: both uses see the same ranges
    # the id's low 33 bits count a partition's rows
    rows = rows.withColumn("_at", F.col("_seq") - F.shiftleft(F.col("_part").cast("long"), 33))
    sizes = rows.groupBy("_part").agg(F.max("_at").alias("last"))  # one row a range
    before = sizes.withColumn("_base", F.sum(F.col("last") + 1).over(Window.orderBy("_part")) - F.col("last") - 1).select("_part", "_base")
    return rows.join(F.broadcast(before), "_part").withColumn("rank", (F.col("_base") + F.col("_at") + 1).cast("int")).drop("_part", "_seq", "_at", "_base")


def fuse(text: DataFrame, vectors: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``node_id, score, sources, matched_chunk_index, matched_embed``: 1 / (60 + rank) over the text list and over *all*
    of a node's chunks; the best chunk, and the first extraction among them. Candidates filter after the nearest are known."""
    if candidates is not None:
        ids = candidates.select("id")
        text = text.join(ids, "id", "left_semi")
        near = vectors.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
        vectors = near.withColumn("rank", F.row_number().over(Window.orderBy("rank")))  # NEAREST rows at most
    none = F.lit(None)
    a = ranked(text, F.desc("score"), F.col("id")).select(F.col("id").alias("node_id"), F.lit("fts").alias("s"), "rank", none.cast("int").alias("chunk_index"), none.cast("string").alias("embed"))
    embed = F.when(F.col("source_type") == "extraction", F.col("extraction_ref")) if "extraction_ref" in vectors.columns else none
    b = vectors.select("node_id", F.lit("semantic").alias("s"), "rank", F.col("chunk_index").cast("int").alias("chunk_index"), embed.cast("string").alias("embed"))
    seen = F.col("s") == "semantic"
    return a.unionByName(b).groupBy("node_id").agg(
        F.sum(1 / (F.lit(RRF) + F.col("rank"))).alias("score"), F.array_join(F.sort_array(F.collect_set("s")), ",").alias("sources"),
        F.min_by("chunk_index", F.when(seen, F.col("rank"))).alias("matched_chunk_index"), F.min_by("embed", F.when(F.col("embed").isNotNull(), F.col("rank"))).alias("matched_embed"))


def hybrid(index: Index, chunks: DataFrame, query: str, vector: list[float], nodes: DataFrame, candidates: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the fused list with title, path and snippet, which are made for the page alone. A text query that can't
    be read leaves the vectors. Equal scores are in order of the id."""
    hits = fuse(match(index, query), nearest(chunks, vector), candidates)
    page = hits.orderBy(F.desc("score"), "node_id").offset(offset).limit(limit)
    terms = query.split()
    rows = page.join(nodes.select(F.col("id").alias("node_id"), "title", "body"), "node_id")
    marks = F.when(F.array_contains(F.split("sources", ","), "fts"), snippet(F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("body", F.lit(""))), terms))
    return rows.withColumn("snippet", marks).drop("body")


def documents(nodes: DataFrame, node_fields: DataFrame) -> DataFrame:
    """``node_id, content``: title, body and each text field by name, with an empty line between; empty ones are left out."""
    texts = node_fields.filter("value_text is not null").groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("field_name", "value_text"))), lambda x: x["value_text"]).alias("texts"))
    full = nodes.select(F.col("id").alias("node_id"), "title", "body").join(texts, "node_id", "left")
    parts = F.concat(F.filter(F.array("title", "body"), lambda x: x.isNotNull() & (x != "")), F.coalesce("texts", F.array().cast("array<string>")))
    return full.select("node_id", F.array_join(parts, "\n\n").alias("content"))


def word_count(text: str) -> int:
    return len(text.split())


def chunks_of(docs: DataFrame, size: int = 200, overlap: int = 20, count: Callable[[str], int] = word_count) -> DataFrame:
    """``node_id, chunk_index, content`` of every document's pieces; ``count`` gives a text's tokens."""

    def run(batches):
        for df in batches:
            rows = [(n, i, c) for n, text in df.itertuples(index=False) for i, c in enumerate(chunk(text or "", size, overlap, count))]
            yield pd.DataFrame(rows, columns=["node_id", "chunk_index", "content"])

    kind = dict(docs.dtypes)["node_id"]
    return docs.select("node_id", "content").mapInPandas(run, f"node_id {kind}, chunk_index int, content string")


def embed(docs: DataFrame, make: Callable[[], Callable], dims: int, purpose: str = "search_document", size: int = 2048, headroom: int = 32, overlap: int = 128, count: Callable[[str], int] = word_count, batch: int = 32) -> DataFrame:
    """``node_id, chunk_index, vector`` of ``docs(node_id, content)`` by a model that the caller brings.

    ``make`` is called once a Python worker and gives a function from an array of texts to an array of vectors, of which the
    first ``dims`` numbers are kept. The model reads ``purpose: text``. A text of more than ``size`` tokens with that is cut
    into chunks that leave ``headroom`` for it.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    def run(batches):
        for df in batches:
            rows = []
            for n, text in df.itertuples(index=False):
                text = text or ""
                parts = [text] if count(f"{purpose}: {text}") <= size else chunk(text, size - headroom, overlap, count)
                rows += [(n, i, f"{purpose}: {c}") for i, c in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["node_id", "chunk_index", "content"])

    model = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch)
    kind = dict(docs.dtypes)["node_id"]
    parts = docs.select("node_id", "content").mapInPandas(run, f"node_id {kind}, chunk_index int, content string")
    return parts.select("node_id", "chunk_index", F.slice(model("content"), 1, dims).alias("vector"))


def hashed_vectors(texts: DataFrame, dims: int = 64, prefix: str = "") -> DataFrame:
    """A ``vector`` for each ``content``: counts of its words by hash, signed and normalised; a stand-in that needs no model."""
    words = tokens(F.concat(F.lit(prefix), F.col("content")))
    at = lambda w: F.pmod(F.xxhash64(w), F.lit(dims))
    sign = lambda w: F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)
    sums = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter("_w", lambda w: at(w) == i), F.lit(0.0), lambda s, w: s + sign(w)))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    return texts.withColumn("_w", words).withColumn("_v", sums).withColumn("vector", F.transform("_v", lambda x: x / F.greatest(length, F.lit(1e-9)))).drop("_w", "_v")


def embedding_queue(wanted: DataFrame, meta: DataFrame, attempts: int = 3) -> DataFrame:
    """``node_id, source_type, extraction_ref`` whose vectors are to be made: each once, unless the content's hash is the
    stored one or all ``attempts`` failed. ``wanted(node_id, source_type, extraction_ref, content_hash, tries)``."""
    keys = ["node_id", "source_type", "extraction_ref"]
    have = meta.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("content_hash").alias("_hash"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    last = wanted.groupBy(*keys).agg(F.max_by("content_hash", "tries").alias("content_hash"), F.max("tries").alias("tries")).filter(F.col("tries") < attempts)
    return last.join(have, same & (F.col("content_hash") == F.col("_hash")), "left_anti").select(*keys)


def replace_group(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """All chunks of a (node, source, reference) give way to the new ones at once."""
    keys = ["node_id", "source_type", "extraction_ref"]
    gone = fresh.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return vectors.join(gone, same, "left_anti").unionByName(fresh)


def prune_extractions(vectors: DataFrame, refs: DataFrame) -> DataFrame:
    """Vectors of extractions that their node doesn't embed any more go; ``refs(node_id, extraction_ref)`` are the present ones."""
    stale = vectors.filter("source_type = 'extraction'").join(refs, ["node_id", "extraction_ref"], "left_anti")
    return vectors.filter("source_type is null or source_type <> 'extraction'").unionByName(vectors.filter("source_type = 'extraction'").join(stale.select("node_id", "extraction_ref").distinct(), ["node_id", "extraction_ref"], "left_anti").select(*vectors.columns))


def index_status(nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """``total, embedded``: nodes, and those that have a vector."""
    return nodes.agg(F.count("*").alias("total")).crossJoin(meta.agg(F.count_distinct("node_id").alias("embedded")))  # one row each


def needs_rebuild(meta: DataFrame, version: str) -> bool:
    """Whether ``meta(key, value)`` lacks the wanted search version; a rebuild writes a new index folder."""
    return meta.filter((F.col("key") == "search_version") & (F.col("value") == version)).isEmpty()


_HEADING = re.compile(r"(?m)^(?=#{1,6}\s)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"(0-9])")


def chunk(text: str, size: int = 200, overlap: int = 20, count: Callable[[str], int] = word_count) -> list[str]:
    """Pieces of at most ``size`` tokens: a text that fits as it is; else by headings, paragraphs, sentences (before a capital,
    digit, quote or bracket) and at last by hard cuts with ``overlap`` tokens in common. Neighbours that fit together are
    joined by an empty line."""
    if not text:
        return []
    if count(text) <= size:
        return [text]
    sections = [x[:-1] if i + 1 < len(s) and x.endswith("\n") else x for s in [_HEADING.split(text)] for i, x in enumerate(s)]
    packed: list[str] = []
    for piece in (p for section in sections if section for p in _fitting(section, size, overlap, count) if p):
        if packed and count(f"{packed[-1]}\n\n{piece}") <= size:
            packed[-1] += "\n\n" + piece
        else:
            packed.append(piece)
    return packed


def _fitting(text: str, size: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    if count(text) <= size:
        return [text]
    for parts in (re.split(r"\n{2,}", text), [p for p in _SENTENCE.split(text) if p]):
        if len(parts) > 1:
            return [x for p in parts for x in _fitting(p, size, overlap, count)]
    width = max(1, -(-len(text) // max(1, count(text))))  # characters a token
    budget, step = size * width, max(1, size * width // 10)
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + budget)
        while end > start and count(text[start:end]) > size:
            end -= step
        end = min(len(text), start + 1) if end <= start else end
        out.append(text[start:end])
        if end >= len(text):
            break
        start = max(start + 1, end - overlap * width)
    return out
