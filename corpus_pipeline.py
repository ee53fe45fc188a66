"""Corpus pipeline over documents; each stage keeps, drops or rewrites whole documents.

toxicity -> near duplicates -> benchmark decontamination -> personal data -> token ids. Every
stage reads what its predecessor kept; all but the last return the columns of documents,
with ``n_chars`` brought up to date where a text was rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import bpe, chosenpath, suffix, surrogates, toxicity
from trackspark.llm.common import settled, table
from trackspark.llm.queries import SURROGATE_KEY, tokenizer


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" not in columns:
        return docs.select(*columns)
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment scorer, fitted on the labelled ones, does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct("*").alias("doc"), "text")
    return toxicity.scored(whole, model).filter(toxicity.predicted() == 0).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return chosenpath.deduplicated(docs, share=80, width=5)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; mostly covered documents go."""
    clean = suffix.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10, most_covered=0.5)
    return _recounted(clean, docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets."""
    return _recounted(surrogates.replaced(docs, SURROGATE_KEY), docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, with digests of the round trip."""
    encoded = bpe.encode(docs.select("doc_id", "text"), *tokenizer(), fold=bpe.kept_with_digests,
                         returns=bpe.KEPT)
    return encoded.select("doc_id", "encoded.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmarks),
    ("personal_data", replace_personal_data),
    ("token_ids", tokenise),
]

#: The stages learn a model and follow trees, which SQL cannot express; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name, *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
