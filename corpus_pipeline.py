"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and gives the documents that go on, with the columns of ``documents``; the last
gives the shards. Stages are joined by tables: each result is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm._store import Scratch
from quillgraph.llm.decontaminate import drop_contaminated
from quillgraph.llm.mixing import mix
from quillgraph.llm.ngram_join import keep_one
from quillgraph.llm.quality import keep_good
from quillgraph.llm.sharding import assign

MAX_REPEAT = 1.5  # how often the mix may repeat a small source, against a large one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of the n-gram Jaccard join."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources are repeated up to ``MAX_REPEAT`` times as often as the largest."""
    return mix(docs, max_repeat=MAX_REPEAT)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix."""
    return assign(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

ORACLE_SQL = None  # the forest and the packing are beyond SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    store = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out = out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "void"})
        docs = store.put(f"{i}_{name}", out)
    return docs
