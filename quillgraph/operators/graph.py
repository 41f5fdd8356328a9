"""Edges: resolution of raw targets, backfill, expansion by one hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, nfc
from ..tables import Graph, cut
from .keys import FEW, Keys, keys


def tiers(rows: DataFrame, names: list[str], texts: list) -> DataFrame:
    """``names``, ``tier`` and ``key`` for each of five texts of a row: three as they are, one in lower case, one in lower
    case and normal form C. Only rows with a letter beyond ASCII go through Python for that form."""

    def keyed(part: DataFrame, form) -> DataFrame:
        keys = [*texts[:3], F.lower(texts[3]), F.lower(form(texts[4]))]
        return part.select(*names, F.explode(F.array(*(F.struct(F.lit(i).alias("tier"), k.alias("key")) for i, k in enumerate(keys, 1)))).alias("k"))

    ascii_ = ~F.coalesce(texts[4], F.lit("")).rlike(r"[^\x00-\x7F]")
    both = keyed(rows.filter(ascii_), lambda t: t).unionByName(keyed(rows.filter(~ascii_), nfc))
    return both.select(*names, "k.tier", "k.key").filter("key is not null")


def resolve(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, id`` of every distinct raw target that some node answers to.

    Tiers: path, title, file name, file name in lower case, the same in normal form C; the first tier with a node wins,
    within it the shortest path, then the smaller path and id. Of each key the best node is found first, by partial sums, so
    that a key of many nodes meets a target once.
    """
    base = basename("file_path")
    bare = F.regexp_replace("target", r"\.md$", "")
    asked = cut(tiers(targets.select("target").filter("target is not null").distinct(), ["target"], [F.col("target"), F.col("target"), bare, bare, bare]))  # of a known size: few are broadcast
    few = [r.key for r in asked.select("key").distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:
        nodes = cut(nodes.filter(_may_answer(few)).select("id", "file_path", "title"))
    by_key = tiers(nodes, ["id", "file_path"], [F.col("file_path"), F.col("title"), base, base, base])
    by_key = by_key.join(asked.select("tier", "key").distinct(), ["tier", "key"], "left_semi")  # few keys are asked for: only theirs are shuffled
    best = by_key.groupBy("tier", "key").agg(F.min(F.struct(F.length("file_path").alias("n"), "file_path", "id")).alias("m"))
    return asked.join(best, ["tier", "key"]).groupBy("target").agg(F.min_by("m.id", "tier").alias("id"))


def _may_answer(asked: list[str]) -> Column:
    """Whether one of the ``asked`` keys can be a node's: all that are, and those beyond ASCII or with a line's end, whose names
    are judged by ``tiers`` alone."""
    if not asked:
        return F.lit(False)
    names = {n for k in asked for n in (k.lower(), k.lower() + ".md")}
    path = F.col("file_path")
    odd = (F.octet_length(path) != F.char_length(path)) | path.contains("\n") | path.contains("\r")
    return path.isin(asked) | F.col("title").isin(asked) | F.lower(F.substring_index(path, "/", -1)).isin(list(names)) | odd


def backfill(g: Graph) -> DataFrame:
    """``relationships`` with every missing resolved id looked up once per distinct raw target."""
    todo = g.relationships.filter("resolved_target_id is null")
    found = resolve(g.nodes, todo).select("target", F.col("id").alias("_found"))
    return g.relationships.join(found, "target", "left").withColumn("resolved_target_id", F.coalesce("resolved_target_id", "_found")).select(*g.relationships.columns)


def forget(relationships: DataFrame, deleted: DataFrame | Keys) -> DataFrame:
    """Edges to deleted nodes lose their resolved id; they aren't resolved anew."""
    out = keys(deleted).mark(relationships, "resolved_target_id", "_gone")
    return out.withColumn("resolved_target_id", F.when(~F.col("_gone"), F.col("resolved_target_id"))).select(*relationships.columns)


def expand(g: Graph, roots: DataFrame, types: list[str] | None = None, direction: str = "both", most: int = 10) -> DataFrame:
    """``root, id, rank, considered, truncated``: neighbours one hop away, newest first, at most ``most`` a root."""
    if not 1 <= most <= 25:
        raise ValueError("most is 1 to 25")
    e = g.relationships.filter("resolved_target_id is not null and source_id != resolved_target_id")
    out = e.select(F.col("source_id").alias("root"), F.col("resolved_target_id").alias("id"))
    into = e.select(F.col("resolved_target_id").alias("root"), F.col("source_id").alias("id"))
    hops = {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction].join(roots.select(F.col("id").alias("root")), "root", "left_semi").distinct()
    if types:
        kept = g.node_types.filter(F.col("schema_type").isin(types)).select(F.col("node_id").alias("id"))
        hops = hops.join(kept, "id", "left_semi")
    hops = hops.join(g.nodes.select("id", "file_mtime"), "id")
    # a count by partial sums, and a rank that Spark limits before it shuffles: a hub's neighbours never meet in one task
    count = hops.groupBy("root").agg(F.count("*").alias("considered"))
    order = Window.partitionBy("root").orderBy(F.desc_nulls_last("file_mtime"), "id")
    ranked = hops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.join(count, "root").select("root", "id", "rank", "considered", (F.col("considered") > most).alias("truncated"))
