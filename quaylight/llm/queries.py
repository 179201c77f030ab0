"""The registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.llm import caps, chat, collocations, decontaminate, jaccard, language, manifest, packing, phrases, pieces, quality, toxicity, urls
from quaylight.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def remainder(modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.train_language(docs.where(remainder(4) != 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.repeat_digest(table(spark, folder, "documents"))


@query
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chats(turns.unionByName(extra)))


@query
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = urls.outcomes(table(spark, folder, "pages").select("page_id", "url"), table(spark, folder, "labels"))
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    learned = remainder(3) != 1
    model = toxicity.train_toxicity(docs.where(learned), table(spark, folder, "labels").where(learned))
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.find_benchmark(docs, table(spark, folder, "benchmark")))


@query
def op7_best_fit_pack(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.packed_documents(docs, tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return caps.cap_links(table(spark, folder, "embeddings"))


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.rate_quality(docs, table(spark, folder, "labels"), F.col("source"), F.col("lang"))


@query
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, folder, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(remainder(5) == 0, manifest.leaf_digest(docs, columns, text=manifest.lowered(docs["text"])))
    return manifest.manifest(docs, altered=tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op13_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_digest(pieces.encode_pieces(table(spark, folder, "documents"), piece_model()))
