"""The queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, collocations, decontaminate, hmm, html_text, licenses, near_dup, pii, prefix_trie, pu_quality, quality_rules, sharding, simhash
from quadrille.llm.common import table
from quadrille.llm.oracles import ORACLE


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learnt from the folds that aren't held out."""
    return pu_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learnt from those that aren't held out."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document."""
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where the tokenizer file is; the package of public tokenizers comes with the installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return bpe.tokens(table(spark, sf_dir, "documents"), tokenizer_path(), digest=True)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in every document."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and place of every document, and its shard after growth."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, and the verdict of the certified rules on every document."""
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_pii, op3_licenses, op4_pu_quality, op5_bpe, op6_hmm, op7_sharding, op8_near_dup, op9_decontaminate, op10_quality_rules, op11_simhash, op12_collocations, op13_prefix_trie)}
#: ORACLE has SQL for five; parsers, checksums with context, models, tokenizers, hashed slots and templates can't be put in it.
__all__ = ["ORACLE", "QUERIES", "tokenizer_path"]
