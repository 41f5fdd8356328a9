"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op3_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(_table(spark, sf_dir, "documents"))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    drawn = mixture(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return drawn.selectExpr("doc_id", "source", "_qg_tokens as tokens", "_qg_pass as pass", "_qg_order as block_order", "round(_qg_weight, 9) as weight")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rule_verdicts

    return rule_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_mixing import score

    return score(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_count import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated_documents

    return contaminated_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private_data import private_spans

    return private_spans(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_substring_dedup, op3_vector_sharding, op4_temperature_mixing, op5_quality_rules, op6_context_mixing, op7_token_counts, op8_language_id, op9_warc, op10_benchmark_decontamination, op11_private_data, op12_hard_negatives, op13_vector_codes)}
