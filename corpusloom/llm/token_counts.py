"""Exact length histogram of a corpus, and what it answers for every context limit.

Documents meet Spark as (length, 1) and leave the map side as one row per length and task. Suffix sums over the
histogram then give, for every limit at once, how many documents exceed it and how many tokens a cut at it keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe_ids
from .durable import durable, read_table

#: Lengths per block of the two-level sums: no task orders more rows than this or the number of blocks.
BLOCK = 4096


def with_token_count(docs: DataFrame, tokenizer: str, text: str = "text", end_token: bool = True) -> DataFrame:
    """(doc_id, n_tokens): encoded length of every whole text, an end token included. Null or empty: the end token only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(byte_bpe_ids(x, tokenizer)) + end_token for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(count, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs), one row per length that occurs. Null lengths count nowhere."""
    return lengths.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def limit_report(hist: DataFrame) -> DataFrame:
    """For each length L of a histogram, taken as a context limit, by prefix and suffix sums.

    Returns n_tokens (L), n_docs (of just that length), docs_within and docs_over (at most and more than L),
    tokens_total (of all documents), tokens_within (of those that fit), tokens_truncated (kept if longer ones are cut
    at L), tokens_lost, and quantile (share of documents of at most L tokens). A limit between two lengths has the
    counts of the lower one and tokens_within + L * docs_over tokens. An empty histogram gives no rows.
    """
    hist = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("b_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("b_docs").over(whole).alias("all_docs"),
        F.sum("b_tokens").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens")
    within = hist.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        "all_docs",
        "all_tokens",
        (F.sum("n_docs").over(inside) + F.col("docs_before")).alias("docs_within"),
        (F.sum("tokens").over(inside) + F.col("tokens_before")).alias("tokens_within"),
    )
    over = F.col("all_docs") - F.col("docs_within")
    kept = F.col("tokens_within") + F.col("n_tokens") * over
    return within.select(
        "n_tokens",
        "n_docs",
        "docs_within",
        over.alias("docs_over"),
        F.col("all_tokens").alias("tokens_total"),
        "tokens_within",
        kept.alias("tokens_truncated"),
        (F.col("all_tokens") - kept).alias("tokens_lost"),
        (F.col("docs_within") / F.col("all_docs")).alias("quantile"),
    )


def quantile_length(report: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed; null if there are none."""
    return report.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit report of all documents under the byte-level vocabulary, one row per encoded length that occurs."""
    counts = with_token_count(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return limit_report(durable(histogram(counts), "lengths"))
