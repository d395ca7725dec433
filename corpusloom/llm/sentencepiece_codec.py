"""SentencePiece encoding that keeps the byte span of every piece, and decoding.

Normalisation walks the text with the model's compiled character map (a double-array trie whose longest matching
prefix is replaced) and notes for each byte it writes the source byte it came from. The sentencepiece library merges the
normalised text; each piece's length then projects it through the notes onto the bytes of the original text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import read_table

_MARK = "▁"
_ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


class CharacterMap:
    """A model's compiled normalisation rules: uint32 size of the trie in bytes, the trie's units, the replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.texts = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data`` has at ``at``, and what replaces it."""
        units = self.units
        if not units:
            return None
        unit, pos, found = units[0], 0, None
        pos ^= _offset(unit)
        for n in range(1, len(data) - at + 1):
            byte = data[at + n - 1]
            pos ^= byte
            unit = units[pos]
            if unit & 0x800000FF != byte:  # a unit's label is its low byte; leaves have the top bit
                break
            pos ^= _offset(unit)
            if unit >> 8 & 1:
                found = n, units[pos] & 0x7FFFFFFF
        if found is None:
            return None
        n, start = found
        return n, self.texts[start : self.texts.index(b"\0", start)]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class Codec:
    """One model. ``encode(text)`` gives ids and byte spans; ``decode(ids)`` is the library's."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        rules = model.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        kinds = model_pb2.ModelProto.SentencePiece
        #: Bytes of normalised text that a piece covers; 0: it depends on the text (unknown).
        self.width = np.array(
            [1 if p.type == kinds.BYTE else 0 if p.type in (kinds.UNKNOWN, kinds.CONTROL) else len(p.piece.encode()) for p in model.pieces],
            np.int64,
        )
        # the same vocabulary for text that is normalised already
        rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces = b"", False, False
        self.merge = SentencePieceProcessor(model_proto=model.SerializeToString())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes, and its end, the byte of ``text`` it comes from."""
        raw = text.encode()
        if not self.map.units and not self.squeeze:
            if not raw:
                return "", np.zeros(1, np.int64)
            data = np.frombuffer(raw, np.uint8)
            origin = np.arange(len(data))
            if self.escape:
                origin = np.repeat(origin, np.where(data == 32, 3, 1))
            lead = 3 if self.escape else 1
            origin = np.concatenate([np.zeros(lead if self.dummy and not self.suffix else 0, np.int64), origin, np.full(lead if self.dummy and self.suffix else 0, len(raw)), [len(raw)]])
            out = f" {text}" if self.dummy and not self.suffix else f"{text} " if self.dummy else text
            return (out.replace(" ", _MARK) if self.escape else out), origin
        pieces, origin, at = [], [], 0
        while at < len(raw):
            n, new = self.map.longest(raw, at) or (_char_bytes(raw[at]), None)
            new = raw[at : at + n] if new is None else new
            pieces.append(new)
            origin += [at] * len(new) if new != raw[at : at + n] else range(at, at + n)
            at += n
        return self._spaces(b"".join(pieces), origin, len(raw))

    def _spaces(self, data: bytes, origin: list[int], end: int) -> tuple[str, np.ndarray]:
        keep = range(len(data))
        if self.squeeze:
            full = len(data.rstrip(b" "))
            keep = [i for i in keep if i < full and not (data[i] == 32 and (i == 0 or data[i - 1] == 32))]
            lead = len(data) - len(data.lstrip(b" "))
            keep = [i for i in keep if i >= lead]
        out, notes = bytearray(), []
        space = _MARK.encode() if self.escape else b" "
        if self.dummy and not self.suffix and (keep or not self.squeeze) and data:
            out += space
            notes += [origin[keep[0]] if len(keep) else 0] * len(space)
        for i in keep:
            new = space if data[i] == 32 else data[i : i + 1]
            out += new
            notes += [origin[i]] * len(new)
        if self.dummy and self.suffix and len(keep):
            out += space
            notes += [end] * len(space)
        last = origin[keep[-1] + 1] if len(keep) and keep[-1] + 1 < len(origin) else end
        return out.decode(), np.array([*notes, last], np.int64)

    def ids(self, normal: str) -> np.ndarray:
        """Ids of a normalised text."""
        return np.asarray(self.merge.encode_as_numpy(normal), np.int32) if normal else np.zeros(0, np.int32)

    def encode(self, text: str | None, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and the [start, end) byte span of each in ``text`` (null: empty); the end id spans nothing at the end."""
        text = text or ""
        normal, origin = self.normalise(text)
        ids = self.ids(normal)
        width = self.width[ids]
        if not width.all():  # unknown characters: their width is what the others leave
            width = self._unknown_widths(normal, ids, width)
        edge = np.concatenate([[0], np.cumsum(width)])
        places = origin[np.minimum(edge, len(origin) - 1)]
        starts, ends = places[:-1], places[1:]
        if end:
            last = origin[-1:]
            ids, starts, ends = np.append(ids, self.library.eos_id()), np.append(starts, last), np.append(ends, last)
        return ids.astype(np.int32), starts.astype(np.int32), ends.astype(np.int32)

    def _unknown_widths(self, normal: str, ids: np.ndarray, width: np.ndarray) -> np.ndarray:
        width, at = width.copy(), 0
        text = normal.encode()
        for k, piece in enumerate(self.merge.encode(normal, out_type=str)):
            if width[k] == 0:
                width[k] = len(piece.encode())
            at += width[k]
        assert at == len(text)
        return width

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _char_bytes(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, text: str = "text", end: bool = True) -> DataFrame:
    """(doc_id, ids, starts, ends): the ids of every whole text and each id's [start, end) bytes in it.

    Null and empty texts have the end id alone. Pieces that a replacement made from one source character share its
    span. Repeated rows give repeated rows; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            for part in _parts(batch):
                done = [one.encode(t, end) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(d[0]) for d in done])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, np.concatenate([d[k] for d in done])) for k in range(3)]
                yield pa.record_batch([part.column(0), *lists], ["doc_id", "ids", "starts", "ends"])

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(run, _ENCODED)


def _parts(batch: pa.RecordBatch, most: int = 100) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Add ``decoded``, the library's text of ``ids``; null ids give null."""

    @F.pandas_udf("string")
    def text(ids):
        one = codec(model)
        return ids.map(lambda x: None if x is None else one.decode(x.tolist()))

    return encoded.withColumn("decoded", text("ids"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the public 32k model: digests of the ids and the text, and the end of the last span."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(read_table(spark, sf_dir, "documents"), model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_bytes"),
    )
