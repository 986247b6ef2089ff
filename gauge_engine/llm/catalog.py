"""The operators of this package as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gauge_engine.llm import oracles
from gauge_engine.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), special=True)


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.token_files import read_token_files, write_token_files

    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder, special=True)
    return read_token_files(spark, folder)


@query("op2_ngram_join", oracles.OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.ngram_join import ngram_components

    found = ngram_components(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.selectExpr("id AS doc_id", "n_shingles", "component AS component_id")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.suffix_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "id AS doc_id", "n_bytes", "n_bytes - octet_length(kept) AS n_removed",
        "CAST(size(spans) AS bigint) AS n_spans", "sha2(kept, 256) AS kept_sha256",
    )


@query("op9_suffix_tree")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.suffix_tree import suffix_tree_scores

    return suffix_tree_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.url_filter import Rule, judge_urls

    rules = (
        Rule("block", "net", "/"),
        Rule("allow", "example.net", "/en/"),
        Rule("block", "example.com", "/de/"),
        Rule("allow", "org", "/fr/"),
    )
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query("op5_quality", oracles.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.quality import judge_quality

    judged = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed", "kept",
    )


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.decontamination import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr("id AS doc_id", "item AS item_id", "start", "matched", "stretch")


@query("op8_licences", oracles.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.licences import scan_licences

    found = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.selectExpr(
        "doc_id", "array_join(licence_sentences, ',') AS licence_sentences", "array_join(licences, ',') AS licences"
    )


@query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.selectExpr("doc_id", "text", "CAST(n_lines AS bigint) AS n_lines", "CAST(n_removed AS bigint) AS n_removed")


@query("op11_hard_negatives", oracles.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS bigint) + 1) % 10 ELSE label END AS label", "embedding"
    )
    return hard_negatives(rows, "id % 100 = 0")


@query("op12_page_text")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.page_text import extract_text

    found = extract_text(table(spark, sf_dir, "pages"))
    return found.selectExpr("page_id", "url", "text", "CAST(char_length(text) AS bigint) AS n_chars")


@query("op13_ranked_search", oracles.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gauge_engine.llm.ranked_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)
