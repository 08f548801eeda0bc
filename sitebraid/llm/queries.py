"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of documents, of edited copies and of next documents."""
    from .syncmers import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of documents, learned by weak supervision."""
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly addressable token files of documents, written and read back."""
    import public_tokenizers

    from .token_files import encode_write_read

    return encode_write_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    from .packing import cut, pack

    return pack(cut(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and attention-model scores of documents."""
    import public_tokenizers

    from .attention_lm import lm_scores
    from .toxicity import crc_remainder

    scored = lm_scores(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), crc_remainder(7) != 2)
    return scored.select("doc_id", F.coalesce(crc_remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of every fiftieth embedding by balanced posting lists."""
    from .posting_lists import search

    return search(_table(spark, sf_dir, "embeddings"))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of documents and their components at two bits."""
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents; native expressions only."""
    from .pii import report

    return report(_table(spark, sf_dir, "documents"))


def op9_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of pages by their hosts' consensus paths."""
    from .html_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded by the merge automaton."""
    import public_tokenizers

    from .bpe_automaton import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of documents from a ledger of bits; native expressions only."""
    from .quality import report

    return report(_table(spark, sf_dir, "documents"))


def op12_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item, term at a time with limited accumulators."""
    from .lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_segment_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of a language diverge, priced on hash-consed segment trees."""
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_syncmer_fingerprints, op2_weak_toxicity, op3_token_files, op4_bin_completion, op5_attention_lm, op6_posting_lists, op7_simhash_golay, op8_boosted_pii, op9_host_paths, op10_bpe_automaton, op11_rule_ledger, op12_accumulators, op13_segment_trees)}


def oracle_sql() -> dict[str, str]:
    from . import divergence, lexical, quality

    return {"op11_rule_ledger": quality.SQL, "op12_accumulators": lexical.SQL, "op13_segment_trees": divergence.SQL}
