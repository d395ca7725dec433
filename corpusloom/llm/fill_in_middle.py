"""Fill-in-the-middle transformation: cuts at word boundaries, found by ranks on a wavelet matrix of character classes.

The bytes of a batch's texts get one of eight classes: a blank that opens or continues a run of blanks, a letter, digit
or other character that opens a word, an ASCII byte or a lead byte inside a word, a continuation byte of UTF-8. A wavelet
matrix of the classes (three bit vectors with prefix sums) answers ranks and selects of a class in three steps each,
for all texts of the batch at once. Ranks of the three word-opening classes add up to the units before a place; the
blank that ends the k-th word, where a cut after k units lies, is one select; ranks of continuation bytes turn byte
distances into code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import text_slices
from .durable import read_table

SEED = 42
#: Percent of documents that are transformed, and of these percent with the suffix first.
SHARE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

BLANK_OPENS, BLANK, LETTER_OPENS, DIGIT_OPENS, OTHER_OPENS, INSIDE, LEAD, CONTINUATION = range(8)
_OPENS = (LETTER_OPENS, DIGIT_OPENS, OTHER_OPENS)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_OPENING = np.full(256, OTHER_OPENS, np.uint8)
_OPENING[48:58] = DIGIT_OPENS
_OPENING[[*range(65, 91), *range(97, 123)]] = LETTER_OPENS


class WaveletMatrix:
    """Ranks and selects over symbols below 2^bits; every argument is an array of queries."""

    def __init__(self, symbols: np.ndarray, bits: int = 3):
        self.n, self.bits = len(symbols), bits
        self.ones, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _down(self, symbol: int, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            at = zeros + ones[at] if symbol >> (self.bits - 1 - level) & 1 else at - ones[at]
        return at

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each place."""
        at = np.asarray(at, np.int64)
        return self._down(symbol, at) - self._down(symbol, np.zeros(1, np.int64))

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th occurrence (from 0) of ``symbol``, which must exist: up the levels by bisection on ranks."""
        at = self._down(symbol, np.zeros(1, np.int64)) + np.asarray(k, np.int64)
        for level in range(self.bits - 1, -1, -1):
            ones, zeros = self.ones[level], self.zeros[level]
            if symbol >> (self.bits - 1 - level) & 1:
                at = np.searchsorted(ones, at - zeros + 1, "left") - 1
            else:
                at = np.searchsorted(np.arange(self.n + 1) - ones, at + 1, "left") - 1
        return at


def classes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte of the texts between ``offsets``; a text's first byte opens a run."""
    blank = _SPACE[data]
    opens = np.ones(len(data), bool)
    opens[1:] = blank[1:] != blank[:-1]
    starts = offsets[:-1]
    opens[starts[starts < len(data)]] = True
    inside = np.where(data < 0x80, INSIDE, LEAD)
    out = np.where(blank, np.where(opens, BLANK_OPENS, BLANK), np.where(opens, _OPENING[data], inside)).astype(np.uint8)
    out[data & 0xC0 == 0x80] = CONTINUATION
    return out


class Units:
    """Units of the texts of a slice: blanks before a word and the word, or blanks at a text's end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.start, self.end = data, offsets[:-1], offsets[1:]
        self.matrix = WaveletMatrix(classes_of(data, offsets))
        some = self.end > self.start
        closing = np.zeros(len(self.start), bool)
        closing[some] = _SPACE[data[self.end[some] - 1]]
        self.opening = np.zeros(len(self.start), np.int64)
        self.opening[some] = _SPACE[data[self.start[some]]]
        self.n = self._words_before(self.end) - self._words_before(self.start) + closing

    def _words_before(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, at) for c in _OPENS)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The byte after the first ``k`` units of each text, 0 <= k <= n."""
        out = np.where(k == 0, self.start, self.end)
        some = np.flatnonzero((k > 0) & (k < self.n))
        if len(some):
            nth = self.matrix.rank(BLANK_OPENS, self.start[some]) + self.opening[some] + k[some] - 1
            out[some] = self.matrix.select(BLANK_OPENS, nth)
        return out

    def code_points(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b - a - (self.matrix.rank(CONTINUATION, b) - self.matrix.rank(CONTINUATION, a))


def _draw(seed: int, key: str, nth: int) -> Column:
    """The ``nth`` group of 8 digits (from 1) of the sha256 of ``seed:key``; a null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * nth - 7, 8), 16, 10).cast("long")


_MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = SEED, share: int = SHARE, suffix_first: int = SUFFIX_FIRST, text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row, cut after two numbers of units drawn for its doc_id.

    ``share`` percent are ``spm`` (``suffix_first`` percent of these) or ``psm``, the others ``plain``: empty or null
    texts, and texts that hold one of the three marks, always are. Plain rows keep their text and have no lengths.
    Repeated rows are each transformed; rows without a doc_id draw as an empty id. No row moves to another task.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = body.contains(PREFIX) | body.contains(SUFFIX) | body.contains(MIDDLE)
    plain = (body == "") | marked | (_draw(seed, "doc_id", 3) % 100 >= share)
    form = F.when(plain, "plain").when(_draw(seed, "doc_id", 4) % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), _draw(seed, "doc_id", 1).alias("h1"), _draw(seed, "doc_id", 2).alias("h2"), form.alias("form"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                units = Units(data, offsets)
                first, second = (batch.column(c).slice(a, b - a).to_numpy() % (units.n + 1) for c in (2, 3))
                one, two = units.cut(np.minimum(first, second)), units.cut(np.maximum(first, second))
                forms = batch.column(4).slice(a, b - a)
                kept = np.array(forms.to_pylist(), object) == "plain"
                raw, out = data.tobytes(), []
                for form, x, i, j, y in zip(forms.to_pylist(), units.start, one, two, units.end, strict=True):
                    if form == "plain":
                        out.append(raw[x:y])
                    elif form == "psm":
                        out.append(b"".join((p, raw[x:i], s, raw[j:y], m, raw[i:j])))
                    else:
                        out.append(b"".join((s, raw[j:y], p, raw[x:i], m, raw[i:j])))
                lengths = (pa.array(units.code_points(u, v), pa.int64(), mask=kept) for u, v in ((units.start, one), (one, two)))
                columns = [batch.column(0).slice(a, b - a), pa.array(units.n, pa.int64()), forms, *lengths, pc.cast(pa.array(out, pa.binary()), pa.string())]
                yield pa.record_batch(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, _MADE)


def restored(output: Column, form: Column) -> Column:
    """The text from output and form: texts that hold a mark are plain, so each mark stands once in the others."""
    after = lambda x, mark: F.substring(x, F.locate(mark, x) + len(mark), F.length(x))
    before = lambda x, mark: F.substring_index(x, mark, 1)
    middle = after(output, MIDDLE)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), middle, after(before(output, MIDDLE), SUFFIX))
    spm = F.concat(after(before(output, MIDDLE), PREFIX), middle, after(before(output, PREFIX), SUFFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents transformed; the columns that the contract names."""
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
