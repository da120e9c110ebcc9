"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake.llm import license as licenses
from partlake.llm import ann, jpeg, langid, mix, simhash, spm, substr, tokens, toxicity
from partlake.llm.common import fold
from partlake.session import read_table

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
#: Target weights of the mix, in blocks of a period; the large web source counts less than its size.
SOURCE_WEIGHTS = {"src0": 20} | {f"src{k}": 4 for k in range(1, 20)}
OTHER_SOURCES = 4


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix.mix(docs, SOURCE_WEIGHTS, other=OTHER_SOURCES).select("row.doc_id", "row.source", "block", "slot", "place")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substr.drop_repeated_spans(docs, counts=True).select("doc_id", "n_sentences", "n_removed", "text")


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.read_media(jpeg.store_texts(read_table(spark, sf_dir, "documents")), tensors=True)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) % 4 == 2
    model = langid.train(langid.sample(docs.where(~held_out), id_column="doc_id", text_column="text", lang_column="lang"))
    return langid.identify(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out})


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """A model learnt from the labelled documents that are not held out."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id")) % 3 != 1)
    return toxicity.train(toxicity.sample(docs.select("doc_id", "text"), labels))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    keep = {"doc_id": F.col("doc_id"), "held_out": fold(F.col("doc_id")) % 3 == 1}
    return toxicity.score_texts(docs, toxicity_model(spark, docs, sf_dir), keep=keep)


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mix": source_mix,
        "op2_token_counts": token_counts,
        "op3_license_scan": license_scan,
        "op4_sentencepiece": sentencepiece,
        "op5_simhash": near_duplicates,
        "op6_substring_dedup": substring_dedup,
        "op7_media_columns": media_columns,
        "op8_language_id": language_id,
        "op9_toxicity": toxicity_scores,
        "op10_nearest_neighbours": nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": mix.oracle(SOURCE_WEIGHTS, OTHER_SOURCES)}
