"""A corpus pipeline: toxicity, near-duplicates, repeated passages, source mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake.llm import mix, queries, shingles, spm, substr, toxicity
from partlake.session import read_table, remove_folder, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, learnt from the labelled documents of the input."""
    model = queries.toxicity_model(spark, docs, sf_dir)
    others = [c for c in docs.columns if c != "text"]  # the text passes through Python once
    scored = toxicity.score_texts(docs, model, keep={"row": F.struct(*[F.col(f"`{c}`") for c in others])}, with_text=True)
    return scored.where("predicted = 0").select(*[F.col("__text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates: five-word shingles of Jaccard similarity 0.8 and up."""
    return shingles.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences of passages that stand earlier in the corpus; n_chars follows the text."""
    cut = substr.drop_repeated_spans(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return cut if length is None else cut.withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files by name, then rows."""
    return mix.in_mixed_order(docs, queries.SOURCE_WEIGHTS, other=queries.OTHER_SOURCES)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids."""
    return spm.encode(docs, queries.tokenizer_path(queries.PIECE_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: SQL can express neither the classifier nor the tokenizer: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what each keeps is written to the shared folder, until the next has read it."""
    docs, folder, before = read_table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
