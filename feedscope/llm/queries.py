"""The operators' queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, common as C, fingerprints, infill, lines, near, packing, quality, rules, substring, vectors, wavelet, webtext


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring.remove_repeats(C.documents(spark, folder))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(C.documents(spark, folder))


def op3_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(C.documents(spark, folder))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(C.documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(C.documents(spark, folder)).select("doc_id", "class_id", "kept")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.drop_lines(C.documents(spark, folder), phrases=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.digests(C.documents(spark, folder))


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.prepare(spark).read.parquet(f"{folder}/embeddings.parquet")
    return vectors.near_vectors(rows)


def op9_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return webtext.main_text(C.prepare(spark).read.parquet(f"{folder}/pages.parquet"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(C.documents(spark, folder))


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(C.documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")).drop("measures")


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.transformed(C.documents(spark, folder)).drop("output", "pieces")


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.scored(C.documents(spark, folder))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_best_fit_packing, op3_document_fingerprints, op4_quality_classifier, op5_near_dedup,
    op6_line_dedup, op7_token_shards, op8_embedding_dedup, op9_page_text, op10_bpe, op11_quality_rules,
    op12_fill_in_middle, op13_token_alignment)}

ORACLES: dict[str, str] = {"op1_substring_dedup": substring.ORACLE, "op8_embedding_dedup": vectors.ORACLE,
                           "op12_fill_in_middle": infill.ORACLE}
