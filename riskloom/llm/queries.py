"""The queries of the training-data operators: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Target shares of two sources; the others have the rest, in proportion to their ids.
MIXTURE = {"src0": 0.20, "src1": 0.10}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), mixture=MIXTURE)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (with their doc_id) and pages (with their page_id), each identified on its own evidence; one trigram model."""
    from .langid import document_rows, fit_text_model, identify, labelled_documents, page_rows

    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    model = fit_text_model(labelled_documents(docs))
    return identify(document_rows(docs), model).unionByName(identify(page_rows(pages), model), allowMissingColumns=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .partenum import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import deduplicated

    return deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltree import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op8_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound: each turn of a conversation is a recording, whose bytes are the score."""
    from .chroma import aligned

    return aligned(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import scan

    return scan(read_table(spark, sf_dir, "documents"))


#: Passages of so many words that another document has too are reported beside the removed bytes.
PASSAGE_WORDS = 50


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import deduplicated

    return deduplicated(read_table(spark, sf_dir, "documents"), passage_words=PASSAGE_WORDS).drop("kept")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substringdedup import deduplicated

    return deduplicated(read_table(spark, sf_dir, "documents")).drop("kept")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turnrepair import damaged, report

    return report(damaged(read_table(spark, sf_dir, "conversations")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectorcodes import compressed

    return compressed(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_packing": op1_packing, "op2_language_id": op2_language_id, "op3_decontamination": op3_decontamination, "op4_ngram_jaccard": op4_ngram_jaccard, "op5_line_dedup": op5_line_dedup, "op6_license_scan": op6_license_scan, "op7_html_extraction": op7_html_extraction, "op8_chroma_fingerprints": op8_chroma_fingerprints, "op9_secrets": op9_secrets, "op10_suffix_dedup": op10_suffix_dedup, "op11_substring_dedup": op11_substring_dedup, "op12_turn_repair": op12_turn_repair, "op13_vector_codes": op13_vector_codes}

ORACLES: dict[str, str] = {}
