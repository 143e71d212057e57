"""The corpus pipeline: language ID, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all of docs (doc_id, text, lang, source, n_chars); all but the last
return these columns. Null and empty texts go at the first stage, which finds no language in them; rows that repeat lose
their lines at the second but the first, and all but one of them at the third. A text that line dedup leaves empty goes on, as it is in no group, and packs to
its end mark.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, langid, linededup, packing, partenum
from riskloom.llm.common import read_table, released, scratch_tables, written
from riskloom.llm.queries import tokenizer_path

#: Near duplicates share this percentage, or more, of their shingles of so many words; op4_ngram_jaccard has its own rule.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made: dict[tuple[int, int], list] = {}  # the scratch tables of the stage before, of each session and thread: runs side by side don't meet


def stage(f: Stage) -> Stage:
    """f, which first deletes the scratch tables of the stage before: its result has been written by then. What docs still reads stays."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = (id(spark), threading.get_ident())
        made = _made.get(own, [])
        released(made, docs)
        before = set(scratch_tables(spark))
        out = f(spark, docs, sf_dir)
        _made[own] = [t for t in scratch_tables(spark) if t not in before or t in made]
        return out

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is found."""
    return langid.accepted(docs.select(*COLUMNS))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that match an earlier one; n_chars follows the text."""
    out = linededup.deduplicated(docs.select(*COLUMNS))
    # Written here, so that the shuffle files of whole texts don't stay beside those of the next stage.
    return written(out.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars")), "lines-out")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the least doc_id (of rows with that doc_id, the one whose text has the least hash; rows without doc_id come last)."""
    docs = docs.select(*COLUMNS)
    groups = partenum.grouped(docs, NEAR_PERCENT, NEAR_SHINGLE).where("label is not null").select("label", partenum.place_of(F.col("doc_id"), F.col("hash")).alias("at"))
    groups = written(groups, "near-groups")
    keepers = groups.groupBy("label").agg(F.min("at").alias("keep"), F.max("at").alias("last")).where("keep <> last").select("label", "keep")
    gone = written(groups.join(keepers, "label").where("at <> keep").select("at").distinct(), "near-duplicates")
    gone = F.broadcast(gone) if gone.count() <= partenum.MAX_BROADCAST_IDS else gone
    kept = docs.withColumn("at", partenum.place_of(F.col("doc_id").cast("bigint"), F.xxhash64("text"))).join(gone, "at", "left_anti").select(*COLUMNS)
    if not docs.groupBy("doc_id").count().where("count > 1").limit(1).collect():
        return kept
    # Rows alike in doc_id and text are one document, other texts stay.
    return kept.dropDuplicates(["doc_id", "text"])


@stage
def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no passage of the benchmark."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 ids."""
    return packing.pack(docs.select(*COLUMNS), tokenizer_path())


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: The stages' hashes, components and tokens are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet before the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = written(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
