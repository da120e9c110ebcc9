"""Null, empty, very long, tied and repeated rows, empty tables and clashing columns, for every operator."""

import zlib

import pytest
from pyspark.sql import functions as F

from partlake.llm import ann, jpeg, langid, mix, queries, simhash, spm, substr, tokens, toxicity
from partlake.llm import license as licenses

ROWS = [
    (1, "One plain sentence here. Another plain sentence follows it. And a third one ends it.", "en", "src0"),
    (1, "One plain sentence here. Another plain sentence follows it. And a third one ends it.", "en", "src0"),
    (2, "", "en", "src1"),
    (3, None, None, None),
    (None, "word " * 30_000, "en", "src0"),
    (5, "  \n\t ", "de", "other"),
    (6, "日本語 ▁ é́ <|endoftext|> 's \x1c x", "fr", "src0"),
    (7, "x" * 70_000, "fr", "src2"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["fp", "row", "key", "id", "t", "place", "places", "score", "n_tokens", "stream", "slot", "whole", "bucket", "rank", "component"]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("mine").alias(x) for x in extra])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = 99")


def words():
    return queries.tokenizer_path(queries.WORD_TOKENIZER)


def pieces():
    return queries.tokenizer_path(queries.PIECE_MODEL)


def model():
    return langid.train([("en", "the cat and the dog"), ("fr", "le chat et le chien")])


def toxic():
    rows = [(f"some nice words {k} and more", 0) for k in range(60)] + [(f"you idiot {k} and more", 1) for k in range(40)]
    return toxicity.train(rows)


RUNS = {
    "tokens": lambda d: tokens.count_tokens(d, words()),
    "license": licenses.scan_licenses,
    "spm": lambda d: spm.encode(d, pieces()),
    "simhash": simhash.near_duplicates,
    "jpeg": lambda d: jpeg.read_media(jpeg.store_texts(d)),
    "langid": lambda d: langid.identify(d, model(), keep={"doc_id": F.col("doc_id")}),
    "toxicity": lambda d: toxicity.score_texts(d, toxic(), keep={"doc_id": F.col("doc_id")}),
    "substr": lambda d: substr.drop_repeated_spans(d, counts=True),
    "mix": lambda d: mix.mix(d, {"src0": 2, "src1": 1}),
    "mixed_order": lambda d: mix.in_mixed_order(d, {"src0": 2, "src1": 1}),
    "dedup": simhash.drop_near_duplicates,
}


@pytest.mark.parametrize("name", RUNS)
def test_rows_survive(docs, none, name):
    out = RUNS[name](docs).collect()
    assert len(out) == (len(ROWS) if name != "dedup" else 6)
    empty = RUNS[name](none)
    assert empty.collect() == []
    assert empty.columns == RUNS[name](docs).columns


def test_whole_rows_keep_clashing_columns(docs):
    for name in ("substr", "mixed_order", "dedup"):
        out = RUNS[name](docs)
        assert {"fp", "row", "slot", "score"} <= set(out.columns)
        assert {r["row"] for r in out.collect()} == {"mine"}


def test_defined_values(docs):
    counted = {r.doc_id: r for r in RUNS["tokens"](docs).collect()}
    assert (counted[3].n_bytes, counted[3].n_tokens, counted[3].over_limit) == (0, 0, False)
    assert counted[None].n_tokens == 30_000 and counted[None].over_limit
    scanned = {r.doc_id: r for r in RUNS["license"](docs).collect()}
    assert (scanned[2].n_words, scanned[2].first_word, scanned[2].labels, scanned[2].score) == (0, None, "", 0.0)
    marked = {r.doc_id: r for r in RUNS["simhash"](docs).collect()}
    assert marked[2].fp == marked[3].fp == marked[5].fp == 0 and marked[3].component == 2
    assert marked[None].component is None
    stored = {r.doc_id: r for r in RUNS["jpeg"](docs).collect()}
    assert (stored[3].n_bytes, stored[3].payload_bytes) == (0, 64) and stored[3].payload_sha256 == stored[2].payload_sha256
    assert stored[2].tail_crc32 == zlib.crc32(bytes(64))
    said = {r.doc_id: r for r in RUNS["langid"](docs).collect()}
    assert said[2].lang_pred == said[3].lang_pred == said[5].lang_pred == "und" and said[3].score == 0
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in RUNS["toxicity"](docs).collect())
    encoded = {r.doc_id: r for r in RUNS["spm"](docs).collect()}
    assert encoded[3].ids == [] and encoded[3].lossless and not encoded[6].lossless


def test_vectors(spark):
    one = [1.0] + [0.0] * 3
    rows = [(0, one), (20, [0.5] * 4), (1, one), (2, one), (3, None), (4, [0.0] * 4), (5, [float("nan")] * 4), (6, [None, 1.0, 1.0, 1.0]), (None, one), (7, [1.0]), (40, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search(vectors).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert ann.search(vectors.where("vec_id = 3")).collect() == []
