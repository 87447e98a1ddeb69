"""Queries opN_* over whole tables: thin digests of the operators in this package."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, langid, licenses, mixing, mixpack, neardup, neighbours, packing, phrases, toxicity, warc
from ledgerloom.llm.components import remove_folder
from ledgerloom.llm.quality import score_quality
from ledgerloom.llm.tokens import count_tokens
from ledgerloom.plans.registry import Registry

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> Registry:
    found = Registry()

    @found.add("op1_token_counts")
    def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
        counted = count_tokens(docs, public_tokenizers.path(VOCABULARY))
        return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))

    @found.add("op2_quality_rules")
    def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
        return score_quality(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")

    @found.add("op3_warc_round_trip")
    def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages, folder = _table(spark, sf_dir, "pages").select("page_id", "url", "html"), warc.archive_folder(spark)
        manifest = warc.write_archives(pages, folder, warc.train_dictionary(pages))
        read = warc.read_archives(manifest, folder, keep_payload=False, strict=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").checkpoint()
        remove_folder(spark, folder)  # what is asked for is held; the archives are not
        return read

    @found.add("op4_language_id")
    def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
        profiles = langid.fit_profiles(docs.filter(~langid.held_out(F.col("doc_id"))))
        predicted = langid.predict_language(docs.select("doc_id", "text"), profiles, keep_text=False)
        return predicted.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

    @found.add("op5_minhash_near_dedup", neardup.SQL)
    def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
        return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=4)

    @found.add("op6_pack_sequences")
    def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
        return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

    @found.add("op7_mix_sources", mixing.SQL)
    def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
        return mixing.mix_sources(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")

    @found.add("op8_nearest_neighbours", neighbours.SQL)
    def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        return neighbours.nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 50 == 0))

    @found.add("op9_toxicity")
    def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
        labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~langid.held_out(F.col("doc_id")))
        model = toxicity.fit_toxicity(docs, labels)
        scored = toxicity.score_toxicity(docs, model, keep_text=False).withColumnRenamed("toxicity", "score")
        return scored.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

    @found.add("op10_license_scan", licenses.sql())
    def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
        return licenses.scan_licenses(docs).select("doc_id", "license", "dice", "n_hits")

    @found.add("op10_license_windows", licenses.windows_sql())
    def op10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
        return licenses.scan_license_windows(docs).select("doc_id", "license", "dice", "n_hits")

    @found.add("op11_mixture_packing")
    def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
        packed = mixpack.mix_pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
        return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")

    @found.add("op12_source_divergence", divergence.SQL)
    def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
        return divergence.source_divergence(_table(spark, sf_dir, "documents").select("text", "lang", "source"))

    @found.add("op13_phrase_collocations", phrases.SQL)
    def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
        return phrases.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))

    @found.add("pipeline", corpus_pipeline.ORACLE_SQL)
    def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus_pipeline.run(spark, sf_dir)

    return found
