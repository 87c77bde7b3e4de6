"""Queries of this subpackage: callables of (spark, directory of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import canonical, cross_split, encoding, language, mixing, oversized, packing, pairs, related_splits, residue
from textloom.llm.common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.related_pairs(table(spark, d, "corpus_records"), table(spark, d, "runs"), table(spark, d, "split_manifest"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.assign_splits(table(spark, d, "corpus_records"), table(spark, d, "runs"), table(spark, d, "split_manifest"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.split_shares(p1_splits(spark, d), table(spark, d, "split_manifest"))


def _profiles(spark: SparkSession, d: str) -> language.Profiles:
    return language.fit_profiles(table(spark, d, "corpus_records"), table(spark, d, "input_diagnostics"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(table(spark, d, "corpus_records"), table(spark, d, "prompts"), _profiles(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    p = oversized.split_windows(table(spark, d, "corpus_records"), table(spark, d, "token_windows"), with_text=False)
    return p.select("record_id", "window_no", "cut").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return oversized.split_windows(table(spark, d, "corpus_records"), table(spark, d, "token_windows"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "corpus_records")).select("record_id")


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    return residue.batch_report(table(spark, d, "corpus_records"), table(spark, d, "hygiene_summary"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.formatting_pairs(table(spark, d, "corpus_records"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """With nested objects, too: any fields in another order are the same record."""
    return canonical.collapsed(table(spark, d, "corpus_records"), nested=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    p = cross_split.cross_split_pairs(table(spark, d, "corpus_records"))
    return p.select(F.least("eval_id", "train_id").alias("record_id_a"), F.greatest("eval_id", "train_id").alias("record_id_b"))


def p6_overlap(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlap_report(table(spark, d, "corpus_records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_segments(spark, d).select("record_id", "segment_no", "language")


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments with confidence; texts with residue (problem 4) are left out."""
    records = table(spark, d, "corpus_records")
    idf, unknown = residue.term_weights(records)

    def keep():
        detector = residue.Detector(idf, unknown)
        return lambda text: detector.kind(text) is None

    return language.relabelled(records, table(spark, d, "input_diagnostics"), _profiles(spark, d), keep=keep)


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    """Each capacity alone, and all of them together as the pack ``joint``."""
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_packs(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored_hashes(table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(table(spark, d, "documents"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "p" and k[1:2].isdigit() and callable(v)}
