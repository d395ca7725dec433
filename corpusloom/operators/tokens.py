"""Vocabularies, encoding, padding and batches of token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.score_text import drop_empty_tokens
from ..sources.store import written

#: Keys of several rows that are sent to every task; beyond it rows are shuffled to them.
SENT_KEYS = 1_000_000


def numbered(rows: DataFrame, *order: str, name: str = "nth", buckets: int | None = None) -> DataFrame:
    """Rows with a gapless number from 0 in the order of ``order``, without bringing them into one partition.

    A range partition (there are as many as shuffle partitions, or ``buckets``) is numbered by itself; only the
    partitions' sizes meet in one place. The partitions are written first, so that both see the same ones.
    """
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    dealt = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def build_vocabulary(tokens: DataFrame, column: str = "tokens", first: int = 1) -> DataFrame:
    """(token, token_id): distinct tokens in code point order, numbered from ``first``; 0 is the pad. A null token comes first, if there is one."""
    words = tokens.select(F.explode(column).alias("token")).distinct()
    return numbered(words, "token", name="n").select("token", (F.col("n") + first).alias("token_id"))


def token_histogram(tokens: DataFrame, key: str = "id", column: str = "tokens") -> DataFrame:
    """(key, token, cnt) of each key's tokens. A null token is a token, a null key a key.

    A row is counted where it is; only counts of keys that several rows have are shuffled and added up.
    """
    own, kind = tokens.schema[key].dataType, tokens.schema[column].dataType.elementType
    shape = T.StructType([T.StructField(key, own), T.StructField("token", kind), T.StructField("cnt", T.LongType(), False)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            names = lists.flatten().dictionary_encode(null_encoding="encode")
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            n = max(1, len(names.dictionary))
            found, cnt = np.unique(row * n + names.indices.to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.record_batch([batch.column(0).take(pa.array(found // n)), names.dictionary.take(pa.array(found % n)), pa.array(cnt, pa.int64())], [key, "token", "cnt"])

    counted = lambda rows: rows.select(key, column).mapInArrow(count, shape)
    again = written(tokens.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again"), "repeated")
    n = again.count()
    if not n:
        return counted(tokens)
    same = F.col(key).eqNullSafe(F.col("_again"))
    sent = F.broadcast(again) if n <= SENT_KEYS else again
    once, several = tokens.join(sent, same, "left_anti"), tokens.join(sent, same, "left_semi")
    return counted(once).unionByName(counted(several).groupBy(key, "token").agg(F.sum("cnt").alias("cnt")))


def encode_tokens(tokens: DataFrame, vocabulary: DataFrame, key: str = "id", column: str = "tokens", drop_empty: bool = False) -> DataFrame:
    """(key, ids): token ids in order; ``drop_empty`` leaves empty tokens out. An unknown token is an error when rows are read.

    A null token has the id that the vocabulary gives null. A null list has none: an empty list.
    """
    if drop_empty:
        tokens = tokens.withColumn(column, drop_empty_tokens(F.col(column)))
    named = vocabulary.select(F.col("token").alias("_t"), F.col("token_id").alias("_id"))
    each = tokens.select(F.col(key).alias("_key"), F.posexplode_outer(column).alias("pos", "token"))
    each = each.join(named, F.col("token").eqNullSafe(F.col("_t")), "left").select(F.col("_key").alias(key), "pos", "token", F.col("_id").alias("token_id"))
    known = F.when(F.col("token_id").isNull(), F.raise_error(F.concat(F.lit("unknown token "), F.coalesce("token", F.lit("null")))).cast("bigint")).otherwise(F.col("token_id"))
    rows = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", known.alias("id"))))).alias("all"))
    return rows.select(key, F.transform("all", lambda x: x["id"]).alias("ids"))


def trim_at_blank(ids: Column, blank: int = 0) -> Column:
    """The sequence before its first blank; all of it if there is none."""
    at = F.array_position(ids, blank)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def pad_to(values: Column, size: Column, pad: Column) -> Column:
    return F.concat(values, F.array_repeat(pad, (size - F.size(values)).cast("int")))


def shift_targets(rows: DataFrame, batch: str, column: str = "ids") -> DataFrame:
    """Decoder input (all but the last) and target (all but the first), padded with 0 to the batch's longest sequence."""
    longest = F.max(F.size(column)).over(Window.partitionBy(batch))
    ids, n = F.col(column), F.greatest(F.size(column) - 1, F.lit(0))
    zero = F.lit(0).cast(rows.schema[column].dataType.elementType)
    return rows.withColumn("_w", longest).select("*", pad_to(F.slice(ids, F.lit(1), n), F.col("_w"), zero).alias("decoder_input"), pad_to(F.slice(ids, F.lit(2), n), F.col("_w"), zero).alias("target")).drop("_w")


def fixed_batches(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Consecutive batches of ``n`` in an order, numbered in ``batch``; the last one may be short. Rows with a column ``batch`` are refused."""
    _refuse(rows, "batch")
    nth = _fresh(rows, "_n")
    return numbered(rows, *order, name=nth).withColumn("batch", F.floor(F.col(nth) / n)).drop(nth)


def _refuse(rows: DataFrame, *names: str) -> None:
    if there := set(names) & set(rows.columns):
        raise ValueError(f"rows have columns that would be overwritten: {', '.join(sorted(there))}")


def _fresh(rows: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``rows`` has."""
    while name in rows.columns:
        name += "_"
    return name


def padded_batches(rows: DataFrame, n: int, column: str, *order: str) -> DataFrame:
    """Batches with each sequence padded to the longest of its batch in ``padded``, true length kept in ``true_len``.

    Ids are padded with 0, tokens with ``<pad>``, vectors with zeros. A null sequence has no elements. Rows that have a
    column ``batch``, ``true_len`` or ``padded`` are refused.
    """
    _refuse(rows, "batch", "true_len", "padded")
    kind = rows.schema[column].dataType.elementType
    width, depth = _fresh(rows, "_w"), _fresh(rows, "_d")
    batch = Window.partitionBy("batch")
    values = F.coalesce(F.col(column), F.array().cast(rows.schema[column].dataType))
    batched = fixed_batches(rows, n, *order).withColumn("true_len", F.size(values)).withColumn(width, F.max("true_len").over(batch))
    pad = F.lit("<pad>" if isinstance(kind, T.StringType) else 0).cast(kind) if not isinstance(kind, T.ArrayType) else None
    if pad is None:  # vectors: zeros as wide as the batch's
        batched = batched.withColumn(depth, F.coalesce(F.max(F.size(F.get(F.col(column), F.lit(0)))).over(batch), F.lit(0)))
        pad = F.array_repeat(F.lit(0.0), F.col(depth)).cast(kind)
    return batched.withColumn("padded", pad_to(values, F.col(width), pad)).drop(width, depth)


def vocabulary_gap(train: DataFrame, other: DataFrame, column: str = "tokens") -> DataFrame:
    """Tokens of ``other`` that training never shows."""
    one = lambda x: x.select(F.explode(column).alias("token"))
    return one(other).distinct().join(one(train).distinct(), "token", "left_anti")


def max_sizes(rows: DataFrame, column: str = "tokens") -> DataFrame:
    """Longest sequence and number of distinct tokens."""
    sizes = rows.agg(F.max(F.size(column)).cast("long").alias("max_len"))
    return sizes.crossJoin(rows.select(F.explode(column).alias("t")).agg(F.countDistinct("t").alias("vocabulary_size")))
