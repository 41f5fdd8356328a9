"""Connected components of a link table by alternating star rounds; no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def components(links: DataFrame, store: Scratch, name: str) -> DataFrame:
    """``f, root`` of every node in ``links(u, v)``: ``root`` is the smallest node that ``f`` reaches.

    A large-star round ties each neighbour above a node to the smallest neighbour, a small-star round those below; they
    repeat until nothing changes, about log(nodes) times. Each round is a table in the shared folder. Self links and
    nulls are ignored; no links, no rows.
    """

    def put(i: int, df: DataFrame) -> tuple[DataFrame, tuple]:
        df = store.put(f"{name}_round{i}", df.filter("u > v").distinct())
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges, mark = put(0, links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    i = 0
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large, _ = put(i + 1, both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges, now = put(i + 2, small)
        store.drop(f"{name}_round{i}", f"{name}_round{i + 1}")
        i += 2
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("f"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("f"), F.col("v").alias("root")).distinct())
