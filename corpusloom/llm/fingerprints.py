"""Document fingerprints: one-permutation MinHash with optimal densification, kept as packed low-order bits.

Each distinct shingle is hashed once; the hash names a bin and a value, and a bin keeps its lowest value. An empty bin
copies the bin that a hash of (its number, attempt) names, attempt after attempt, until that one is not empty
(Shrivastava, 2017). Four low-order bits of each bin make the fingerprint; the share of equal bins, corrected for
chance agreement of 1 in 16, estimates the similarity of the shingle sets (Li and König, 2010).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import mix, random_words, shingles_of, text_slices, words_of
from .durable import read_table

WORDS = 5
BINS = 512
BITS = 4

_LEAST = np.iinfo(np.int64).min
_EMPTY = np.uint64((1 << 64) - 1)
_SEED = random_words(2, 8)
#: A value copied into several bins leaves bits of its own in each, else two short texts would agree by one chance in 16.
_OWN = random_words(BINS, 9)


def bins_of(text: np.ndarray, element: np.ndarray, n_texts: int) -> np.ndarray:
    """(n_texts, BINS): lowest hash of each bin, empty ones filled; rows of texts without elements mean nothing."""
    out = np.full((n_texts, BINS), _EMPTY)
    value = mix(element ^ _SEED[0])
    np.minimum.at(out.reshape(-1), text * BINS + (value % np.uint64(BINS)).astype(np.int64), value // np.uint64(BINS))
    filled = out != _EMPTY
    row, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        many = int(np.clip(200_000 // len(row), 1, 256))
        tries = np.arange(attempt, attempt + many, dtype=np.uint64)
        attempt += many
        target = (mix((bin_.astype(np.uint64)[:, None] << np.uint64(32)) ^ tries[None, :] ^ _SEED[1]) % np.uint64(BINS)).astype(np.int64)
        hit = filled[row[:, None], target]
        which = hit.argmax(axis=1)
        done = hit[np.arange(len(row)), which]
        out[row[done], bin_[done]] = out[row[done], target[np.flatnonzero(done), which[done]]]
        row, bin_ = row[~done], bin_[~done]
    return out


def packed(column: pa.Array) -> list[bytes]:
    """A fingerprint per text, two bins a byte; texts without shingles (null, empty, blank) have none: b''."""
    out: list[bytes] = []
    for a, b, data, offsets in text_slices(column):
        owner, element = shingles_of(words_of(data, offsets), WORDS)
        some = np.bincount(owner, minlength=b - a) > 0
        low = (mix(bins_of(owner, element, b - a) ^ _OWN[None, :]) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        both = low[:, 0::2] << BITS | low[:, 1::2]
        out += [row.tobytes() if s else b"" for row, s in zip(both, some, strict=True)]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Estimated similarity of the shingle sets behind two fingerprints; of two empty ones 1, of an empty and another 0."""
    if not a or not b:
        return float(a == b)
    differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    equal = (np.count_nonzero(differ >> BITS == 0) + np.count_nonzero(differ & 15 == 0)) / BINS
    chance = 2.0**-BITS
    return float(max(0.0, (equal - chance) / (1 - chance)))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as hex) of every row; texts without words have an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([x.hex() for x in packed(batch.column(1))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, extra): partitions that follow each other in descending doc_id, ties by text, null ids last.

    Every partition ends with the row that opens the next one (the last: the first), marked extra. Range boundaries and
    the ids that open a range, one a partition, are all that the driver sees.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(_LEAST)))
    shares = [k / n for k in range(1, n)]
    found = rows.agg(F.percentile_approx("place", F.array(*map(F.lit, shares)), F.lit(max(10_000, 100 * n))).alias("cuts")).first()["cuts"] if shares else []
    cuts = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def part(place: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, place.to_numpy(), "left"))

    dealt = rows.withColumn("part", part("place"))
    opens = sorted((r["part"], r["first"]) for r in rows.select("place").withColumn("part", part("place")).groupBy("part").agg(F.max("place").alias("first")).collect())
    before = {first: opens[k - 1][0] for k, (_, first) in enumerate(opens)}
    extra = rows.where(F.col("place").isin(list(before)) if _LEAST not in before else F.lit(True))
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map().cast("map<bigint,int>")
    extra = extra.withColumn("part", to[F.col("place")]).where("part IS NOT NULL")
    both = dealt.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))
    both = both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("extra", F.col("place").desc(), "text")
    return both.select("doc_id", "text", "extra")


_COMPARED = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edited(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document in
    descending doc_id, after the last by the first's. Null is an empty text. One document alone is its own next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            ids, texts, extra = (batch.column(k).to_pylist() for k in range(3))
            prints = packed(batch.column(1))
            rows = [held] if held else []
            for doc, body, fp, more in zip(ids, texts, prints, extra, strict=True):
                rows.append((doc, body or "", fp))
                if more:
                    break
            held = rows[-1]
            edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in zip(rows, rows[1:])]
            of_edited = packed(pa.array(edited, pa.string()))
            columns = [
                pa.array([r[0] for r in rows[:-1]], pa.int64()),
                pa.array([len(r[1]) for r in rows[:-1]], pa.int64()),
                pa.array(edited, pa.string()),
                pa.array([r[2].hex() for r in rows[:-1]], pa.string()),
                pa.array([x.hex() for x in of_edited], pa.string()),
                pa.array([likeness(a[2], x) for a, x in zip(rows, of_edited)], pa.float64()),
                pa.array([likeness(a[2], b[2]) for a, b in zip(rows, rows[1:])], pa.float64()),
            ]
            yield pa.record_batch(columns, ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            if any(extra):
                return

    return in_order(docs, text).mapInArrow(run, _COMPARED)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents compared with their edited texts; the columns that the contract names."""
    done = compare_with_edited(read_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
