"""Corpus pipeline: language, exact copies, near copies, mixture of sources, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from varscope.llm.common import new_path, small_batches, whole_row
from varscope.llm.exact_dedup import drop_exact_copies
from varscope.llm.language_id import NO_LANGUAGE, fit_languages, language_column
from varscope.llm.minhash_forest import drop_near_copies
from varscope.llm.mixing import repeat_by_mixture
from varscope.llm.packing import pack_documents
from varscope.llm.queries import public_tokenizer

#: A document whose largest language has a smaller share than this has no clear language.
LEAST_LANGUAGE_SHARE = 0.4
#: Words of a shingle by which near copies are told.
SHINGLE_WORDS = 5
#: SQL cannot express expectation-maximisation, the forest, or the packing; the stages have tests of their own.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language; texts that are null, have no letter or mix too many languages go.

    The model learns from every labelled document of the stage's input; without labels every text would be
    undetermined, so that then only texts without a letter go.
    """
    model = fit_languages(docs)
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    small_batches(spark)
    # The whole row is one value, so that no column of its own can clash with the language found.
    found = docs.select(whole_row(docs).alias("row"), language_column("text", model).alias("language"))
    clear = (F.col("language.lang") != NO_LANGUAGE) & (F.col("language.score") >= LEAST_LANGUAGE_SHARE)
    return found.where(clear).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the longest, then the smallest id.

    Null texts are empty and one text; of rows with equal ids and texts one stays; a null id stays only where no other
    row is as long.
    """
    return drop_exact_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, told by shingles of five words: the smallest id.

    Texts without a word are in no group. Rows with equal ids stay or go together.
    """
    return drop_near_copies(docs, words=SHINGLE_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, from none to three times.

    A null source is a source; a document without words adds none however often it is taken; rows with equal ids are taken each by
    its own count.
    """
    return repeat_by_mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizer(), keep_ids=False)


STAGES = [
    ("language", language), ("exact_copies", exact_copies), ("near_duplicates", near_duplicates),
    ("mixture", mixture), ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
