"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bag_minhash, bpe_tree, chat_repair, decontaminate, html_graph, personal_data, quality_ledger, ranked_search, suffix_dedup, token_alignment, token_counts, url_rules, warc
from .common import Scratch, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle.strip()
        return run

    return deco


@register("op1_decontaminate", decontaminate.ORACLE)
def op1_decontaminate(spark, table):
    """Benchmark n-gram hits and the contamination judgement of every document."""
    return decontaminate.report(table("documents"), table("benchmark"))


@register("op2_token_counts")
def op2_token_counts(spark, table):
    """Tokens of every document by the byte-level vocabulary, spliced from overlapping chunks."""
    return token_counts.count_tokens(table("documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op3_url_rules", url_rules.ORACLE)
def op3_url_rules(spark, table):
    """Host, path, deciding rule and verdict of every page's url."""
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    return url_rules.judge(table("pages"), rules)


@register("op4_chat_repair")
def op4_chat_repair(spark, table):
    """Every conversation with its roles repaired at least cost, a rendered row per turn."""
    return chat_repair.repair(table("conversations"))


@register("op5_bpe_round_trip")
def op5_bpe_round_trip(spark, table):
    """Ids of every document by tree reduction, and the bytes decoded from them."""
    return bpe_tree.round_trip(table("documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op6_quality_ledger", quality_ledger.ORACLE)
def op6_quality_ledger(spark, table):
    """Quality measurements, failure bits and the verdict of the production policy for every document."""
    book = quality_ledger.apply_policy(quality_ledger.ledger(table("documents")))
    return book.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "failed_bits",
                           f"failed_bits & {quality_ledger.mask('base')}L != 0 AS base_failed", "kept")


@register("quality_ablation", quality_ledger.ABLATION)
def quality_ablation(spark, table):
    """What every rule of both policies costs, by sums over the bits of one stored ledger."""
    book = Scratch(spark, "ledger").keep("book", quality_ledger.ledger(table("documents")))
    base, production = (quality_ledger.ablation(book, policy) for policy in ("base", "v1"))
    return base.unionByName(production)


@register("op7_suffix_dedup")
def op7_suffix_dedup(spark, table):
    """Bytes of every document that a 400-byte string repeated elsewhere covers."""
    return suffix_dedup.report(table("documents"))


@register("op8_html_graph")
def op8_html_graph(spark, table):
    """Main text of every page by the marginals of its DOM."""
    return html_graph.extract_pages(table("pages"))


@register("op9_warc_round_trip", warc.ORACLE)
def op9_warc_round_trip(spark, table):
    """Every page written as a WARC record and read back from the archives."""
    return warc.round_trip(table("pages"))


@register("op10_bag_minhash")
def op10_bag_minhash(spark, table):
    """Near-duplicate class and its size of every document."""
    return bag_minhash.classes(table("documents"))


@register("op11_personal_data", personal_data.ORACLE)
def op11_personal_data(spark, table):
    """Personal data of every document, and the terms beside it that disclose it."""
    return personal_data.report(table("documents"))


@register("op12_token_alignment")
def op12_token_alignment(spark, table):
    """Alignment of a byte-level vocabulary's tokens with a piece vocabulary's in every document."""
    return token_alignment.align(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@register("op13_ranked_search", ranked_search.ORACLE)
def op13_ranked_search(spark, table):
    """The 50 highest-scoring documents of every benchmark item."""
    return ranked_search.search(table("documents"), table("benchmark"))
