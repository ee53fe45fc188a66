"""The numbered queries: thin uses of the operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import (
    arc, bpe, chosenpath, crossparse, fim, licenses, recompression, reversed_search, sharding, suffix, surrogates,
    topk, toxicity,
)
from trackspark.llm.common import table


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the byte-level tokenizer that the queries use."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that an earlier document has."""
    return recompression.deduplicated(table(spark, sf_dir, "documents"), window=50, digest=True)


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows by integer inner product for every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op3_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as ids and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, *tokenizer(), fold=bpe.round_trip, returns=bpe.DIGESTS).select(
        "doc_id", "encoded.*")


def op4_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files, converted to WARC, read back."""
    legacy, converted = arc.fresh_folder(spark, "arc"), arc.fresh_folder(spark, "warc")
    arc.write_arc(table(spark, sf_dir, "pages"), legacy)
    arc.convert(spark, legacy, converted)
    arc.drop_folder(spark, legacy)
    return arc.read_warc(spark, converted).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Key of the surrogates in the queries; a deployment takes its own from its secret store.
SURROGATE_KEY = "example-key"


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many mentions were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replaced(docs, SURROGATE_KEY, counts="n_replaced")


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items."""
    marked = suffix.hits(table(spark, sf_dir, "documents").select("doc_id", "text"),
                         table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", suffix.coverage().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), suffix.digest_of_items().alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"), "unknown_sentences")


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"), share=85, width=5).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of the held-out fold are not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", toxicity.predicted().alias("predicted"),
        F.size("passages").alias("n_passages"))


def op10_exact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, uniformly, with sizes at most one row apart."""
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return sharding.shuffle_into_shards(slim, shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut by lines into prefix, middle and suffix, and put back."""
    docs = fim.restored(fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; languages of the held-out fold are not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return crossparse.identified(docs.drop("lang"), crossparse.fit(docs)).select(
        "doc_id", crossparse.held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_recompression, op2_pivot_topk, op3_chunked_bpe, op4_legacy_archives, op5_surrogates, op6_suffix_automaton,
        op7_license_rules, op8_chosen_path, op9_toxic_segments, op10_exact_shards, op11_fill_in_middle,
        op12_reversed_search, op13_cross_parsing)
}
