"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, license_scan, minhash_dedup, periodic_runs, pii_semicrf, preference_chat, quality_cotraining, quality_rules, suffix_tree_lm, token_files, toxicity_fm, whitening
from .common import environment_path, held_out, read


def tokenizer_path() -> str:
    """The word-BPE vocabulary: ``QUIRELAKE_TOKENIZER``, or that of the installed public_tokenizers."""
    import public_tokenizers

    return environment_path("QUIRELAKE_TOKENIZER", public_tokenizers.path("word_bpe_49k.json"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality scores of every document."""
    scores = quality_cotraining.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scores.withColumn("held_out", held_out(quality_cotraining.HELD_OUT))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return bpe.bpe_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of every document."""
    return quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by shingles of four words."""
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=4)


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return suffix_tree_lm.language_scores(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii_semicrf.personal_data(read(spark, sf_dir, "documents"))


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its twin with a stranger's last answer."""
    return preference_chat.preference_pairs(preference_chat.swapped_answers(read(spark, sf_dir, "conversations")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    scores = toxicity_fm.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(toxicity_fm.HELD_OUT).alias("held_out"), "score", "predicted")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as files of shuffled byte planes and read back."""
    folder = token_files.new_folder(spark)
    token_files.write_ids(read(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_files.id_checksums(spark, folder)


def repeated_tail(doc_id: int, n: int) -> tuple[int, int] | None:
    """First word and period of the planted tail of a document of ``n`` words; nine documents in ten have none."""
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest or not n:
        return None
    first = g % n
    return first, 1 + (n - first) // (3 + g % 8)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, with planted tails."""
    return periodic_runs.run_digests(periodic_runs.periodic_runs(read(spark, sf_dir, "documents"), tail=repeated_tail))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name, in the order of the operators."""
    return {
        "op1_quality": op1_quality,
        "op2_bpe": op2_bpe,
        "op3_license": op3_license,
        "op4_quality_rules": op4_quality_rules,
        "op5_minhash": op5_minhash,
        "op6_suffix_tree": op6_suffix_tree,
        "op7_pii": op7_pii,
        "op8_preference": op8_preference,
        "op9_decontamination": op9_decontamination,
        "op10_toxicity": op10_toxicity,
        "op11_token_files": op11_token_files,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_whitening": op13_whitening,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL expresses."""
    return {
        "op3_license": license_scan.oracle(),
        "op4_quality_rules": quality_rules.oracle(),
        "op8_preference": preference_chat.ORACLE,
        "op9_decontamination": decontamination.oracle(),
    }
