"""Sum-of-squares packing of tokenised documents into sequences of one length.

Tokenising is one pass over the texts. Pieces that fill a sequence are sequences; the others are dealt by their row
number into groups of bounded size, repeated rows too, and each group is packed on its own, so neither the driver nor a
task holds more than a group.
Sequences that stay part-filled when a group's pieces run out are emptied and packed once more by best fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe_ids
from .durable import durable, read_table

SEQUENCE = 2048
#: Pieces that a group has on average; a group is one task's work.
GROUP = 60_000
#: Sequences with more tokens left than this are part-filled; the next limit is taken while fewer sequences might do.
LEFT = (48, 8, 0)

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = 0, text: str = "text") -> DataFrame:
    """Cut every document's ids (its text's, then ``end_id``) into pieces of at most ``size``.

    Returns doc_id, piece, start, length, ids_crc32. Documents of at most ``size`` ids stay whole; of a longer one the
    first piece may be shorter, the others have ``size`` ids. Null or empty text: the end id alone. Every row of the
    input is packed, repeated rows and rows with a null doc_id too.
    """
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([byte_bpe_ids(text, tokenizer).astype("<u4", copy=False), end])
                first = len(ids) % size or size
                starts = [0, *range(first, len(ids), size)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(cut, _PIECES)


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, longest first.

    ``open_[g]`` counts the sequences with g tokens left. A piece goes where the sum of the squared counts of open
    sequences becomes smallest, into one that has room for it or into a new one; ties go to the tighter fit.
    """
    open_ = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        gaps = n + np.flatnonzero(open_[n:size])
        best = 2 * open_[size - n] + 1 if n < size else 0  # what a new sequence adds to the sum
        gap = size
        if len(gaps):
            change = 2 * (open_[gaps - n] - open_[gaps]) + 2
            if gaps[0] == n:  # filled up: it is counted no longer
                change[0] = 1 - 2 * open_[n]
            at = int(change.argmin())
            if change[at] <= best:
                gap = int(gaps[at])
        if gap == size:
            number, made = made, made + 1
        else:
            number = stacks[gap].pop()
            open_[gap] -= 1
        sequence[i], offset[i] = number, size - gap
        if gap > n:
            stacks[gap - n].append(number)
            open_[gap - n] += 1
    return sequence, offset


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, longest first, each into the fullest sequence that has room for it."""
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    open_ = np.zeros(size + 1, bool)
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        gap = n + int(open_[n:].argmax())
        if open_[gap]:
            number = stacks[gap].pop()
            open_[gap] = bool(stacks[gap])
        else:
            number, made, gap = made, made + 1, size
        sequence[i], offset[i] = number, size - gap
        if gap > n:
            stacks[gap - n].append(number)
            open_[gap - n] = True
    return sequence, offset


def packed(lengths: np.ndarray, size: int = SEQUENCE, left: tuple[int, ...] = LEFT) -> tuple[np.ndarray, np.ndarray]:
    """``sum_of_squares``, then the pieces of part-filled sequences by ``best_fit`` where that takes fewer sequences."""
    sequence, offset = sum_of_squares(lengths, size)
    least = -(-int(lengths.sum()) // size)
    for limit in left:
        if not len(lengths) or sequence.max() + 1 == least:
            break
        part_filled = np.bincount(sequence, lengths) < size - limit
        again = np.flatnonzero(part_filled[sequence])
        other, place = best_fit(lengths[again], size)
        saved = int(part_filled.sum()) - (int(other.max()) + 1 if len(other) else 0)
        if saved > 0:
            free = np.flatnonzero(part_filled)
            sequence[again], offset[again] = free[other], place
            sequence = np.unique(sequence, return_inverse=True)[1]  # numbers without gaps
    return sequence, offset


def pack(cut: DataFrame, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to the rows of ``pieces``. ``cut`` is read twice: pass a written table."""
    n_groups = max(1, -(-cut.where(F.col("length") < size).count() // group))
    dealt = cut.withColumn("packed_in", F.pmod(F.monotonically_increasing_id(), F.lit(n_groups)))
    full = dealt.where(F.col("length") == size).select(
        *cut.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        number, offset = packed(rows["length"].to_numpy(), size)
        rows["sequence_id"], rows["offset"] = rows["packed_in"] * (1 << 40) + number, offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    part = dealt.where(F.col("length") < size).groupBy("packed_in").applyInPandas(place, _PLACED)
    return full.unionByName(part)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Tokenise, cut and pack all documents; an empty table gives no rows. Columns: see ``_PLACED``."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return pack(durable(pieces(docs, tokenizer, size), "pieces"), size)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens; the columns that the contract names."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
