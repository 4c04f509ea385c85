"""The registered queries of this subpackage: thin applications of its operators to the whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, jaccard_join, language, mixing, oracle, packing, quality, spelling, suffix_dedup, token_counts, topk_search, vector_codes
from .shared import table

#: Folder of the public tokenizers' files; a parameter, as the files are no part of this repository.
TOKENIZERS = os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers")

SPECIAL_CONVERSATION = "<|im_end|><|im_start|>assistant ok"


#: Target weights of the mix: domains, and languages within each domain; sources of a language are alike.
MIX_WEIGHTS = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 1, (None, "en"): 4, (None, "fr"): 2, (None, "de"): 2, (None, "es"): 1}


def mix_levels() -> dict[str, Column]:
    """The tree of documents: four domains by the number in the source's name, languages, sources."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    domain = F.when(F.length(number) > 0, F.concat(F.lit("domain"), F.pmod(number.cast("bigint"), F.lit(4)).cast("string")))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that links of Jaccard similarity 0.9 or more of 3-word shingles connect."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_fold(quality.score_quality(docs, forest), 0.7)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a mix of half of all tokens, with their epochs and used tokens."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, fraction=0.5, max_epochs=2, seed=1)
    return mixed.select("doc_id", F.col("_path")[0].alias("domain"), "lang", "source", F.col("_epoch").alias("epoch"), F.col("_n_tokens").alias("n_tokens"), F.col("_used_tokens").alias("used_tokens"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that 10-word windows of benchmark items hit, and those items."""
    out = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("_item_ids", ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 made of control strings, formatted and read back. If the table has a conversation -1, its turns and the added ones are one conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", SPECIAL_CONVERSATION), (-1, 1, "assistant", SPECIAL_CONVERSATION)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chat_format.linear_messages(rows.unionByName(extra)))
    read = out.select("tree", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language.with_fold(language.identify(docs, language.fit(docs)))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings; beside it, how many of its words stand in passages of 50 words that start twice."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, passages=50)
    made = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
    return out.select("doc_id", *(F.col(f"_{m}").alias(m) for m in made))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op11_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    import public_tokenizers

    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector's 16 parts by codebooks of 64 entries."""
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least 7 letters, its frequent neighbour by one letter, and where following those ends."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_classifier, op3_source_mixing, op4_html_extraction, op5_exact_topk, op6_benchmark_decontamination, op7_chat_formatting, op8_language_id, op9_suffix_array_dedup, op10_token_counts, op11_sequence_packing, op12_vector_codes, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can state the result; classifiers, extraction, byte strings and piece counts are tested against brute force or held-out labels."""
    return {
        "op1_ngram_jaccard_join": oracle.JACCARD,
        "op3_source_mixing": oracle.mix(MIX_WEIGHTS, 0.5, 2, 1),
        "op5_exact_topk": oracle.TOPK,
        "op6_benchmark_decontamination": oracle.LEAKS,
        "op7_chat_formatting": oracle.CHATS,
        "op12_vector_codes": oracle.VECTOR_CODES,
        "op13_spelling_variants": oracle.SPELLING,
    }
