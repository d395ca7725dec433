"""Language of a text by a convolutional network over its bytes.

Bytes fold into classes (letters without case, digits, blanks, other signs, every byte above 127 by itself), classes
have vectors, filters of several widths slide over windows of fixed length, the largest response of each filter feeds a
softmax. Training is numpy on the driver over all windows of a bounded sample of labelled rows, until rows held back
from it get no better. As a filter's response is a
sum of one term per byte class and place, prediction looks these terms up and never builds the vectors. A document's
language is that of the mean of its windows' probabilities, weighted by their letters; all its windows count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.uniform import lowest
from .byte_words import text_slices
from .durable import read_table, with_columns

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS, DIMENSIONS = 16, 8
#: Labelled rows that training takes at most; all windows of each may be drawn, however long it is.
SAMPLE_ROWS = 6000
#: Steps at most, windows drawn for each, and how often the rows held back (one in HELD) are looked at.
STEPS, BATCH, RATE, LOOK, HELD = 3000, 64, 0.004, 200, 12
#: Training ends after so many looks in a row whose mean loss is not lower by GAIN.
PATIENCE, GAIN = 2, 0.005
UNDETERMINED = "und"

_CLASS = np.full(256, 4, np.uint8)  # 0 pads a window
_CLASS[list(b"0123456789")] = 1
_CLASS[list(b" \t\n\r\x0b\x0c")] = 2
_CLASS[list(b",.;:!?'\"")] = 3
for _k in range(26):
    _CLASS[[65 + _k, 97 + _k]] = 5 + _k
_CLASS[128:] = np.arange(31, 159)
CLASSES = 159
_IS_LETTER = _CLASS >= 5


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, byte classes [windows, WINDOW]); the last window of a text is padded, an empty text has none."""
    sizes = np.diff(offsets)
    many = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), many)
    first = np.cumsum(many) - many
    out = np.zeros(int(many.sum()) * WINDOW, np.uint8)
    shift = np.repeat(first * WINDOW - offsets[:-1], sizes)
    out[np.arange(len(data)) + shift] = _CLASS[data]
    return text, out.reshape(-1, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"vectors": rng.normal(0, 0.3, (CLASSES, DIMENSIONS)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"filter{w}"] = rng.normal(0, 1 / np.sqrt(w * DIMENSIONS), (w * DIMENSIONS, FILTERS)).astype(np.float32)
            self.p[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.p["out_bias"] = np.zeros(len(languages), np.float32)
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def train(self, windows: np.ndarray, owner: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """``owner``: row of each window, in order; ``labels``: of each row. A step draws rows, then a window of each."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(labels))
        held, learn = (order[: len(order) // HELD], order[len(order) // HELD :])
        first = np.searchsorted(owner, np.arange(len(labels) + 1))
        drawn = lambda rows: first[rows] + (rng.random(len(rows)) * (first[rows + 1] - first[rows])).astype(np.int64)
        held = np.repeat(held, 4)
        shown, answers = windows[drawn(held)], labels[held]
        best, misses, kept = np.inf, 0, None
        for step in range(1, STEPS + 1):
            rows = rng.choice(learn, BATCH)
            self._step(windows[drawn(rows)], labels[rows])
            if step % LOOK == 0 and len(held):
                chance = window_probabilities(self.tables(), shown)[np.arange(len(held)), answers]
                loss = -np.log(np.maximum(chance, 1e-9)).mean()
                misses = 0 if loss < best - GAIN else misses + 1
                best, kept = (loss, {k: v.copy() for k, v in self.p.items()}) if loss < best else (best, kept)
                if misses >= PATIENCE:
                    break
        self.p = kept or self.p

    def _step(self, codes: np.ndarray, labels: np.ndarray) -> None:
        p, n = self.p, len(codes)
        x = p["vectors"][codes]
        best, pooled = {}, []
        for w in WIDTHS:
            patches = np.concatenate([x[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            response = patches @ p[f"filter{w}"]
            at = response.argmax(axis=1)
            top = np.take_along_axis(response, at[:, None, :], 1)[:, 0] + p[f"bias{w}"]
            best[w] = at, patches[np.arange(n)[:, None], at]  # [n, FILTERS, w * DIMENSIONS]
            pooled.append(np.maximum(top, 0))
        h = np.concatenate(pooled, axis=1)
        logits = h @ p["out"] + p["out_bias"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(n), labels] -= 1
        g = prob / n
        grad = {"out": h.T @ g, "out_bias": g.sum(0), "vectors": np.zeros_like(p["vectors"])}
        back = (g @ p["out"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            at, patch = best[w]
            grad[f"filter{w}"] = np.einsum("nf,nfd->df", own, patch)
            grad[f"bias{w}"] = own.sum(0)
            to_patch = (own[:, :, None] * p[f"filter{w}"].T[None]).reshape(n, FILTERS, w, DIMENSIONS)
            for j in range(w):
                np.add.at(grad["vectors"], np.take_along_axis(codes, at + j, 1), to_patch[:, :, j])
        self.steps += 1
        for k, d in grad.items():
            m, v = self.moments[k]
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p[k] -= (RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)

    def tables(self) -> dict:
        """What prediction needs: the term of every class at every place of every filter."""
        p = self.p
        terms = {w: [p["vectors"] @ p[f"filter{w}"][j * DIMENSIONS : (j + 1) * DIMENSIONS] for j in range(w)] for w in WIDTHS}
        for w in WIDTHS:
            terms[w][0] = terms[w][0] + p[f"bias{w}"]
        return {"languages": self.languages, "terms": terms, "out": p["out"], "out_bias": p["out_bias"]}


def window_probabilities(model: dict, codes: np.ndarray) -> np.ndarray:
    out = np.empty((len(codes), len(model["languages"])), np.float32)
    for at in range(0, len(codes), 512):
        some = codes[at : at + 512]
        pooled = []
        for w in WIDTHS:
            total = model["terms"][w][0][some[:, : WINDOW - w + 1]]
            for j in range(1, w):
                total += model["terms"][w][j][some[:, j : WINDOW - w + 1 + j]]
            pooled.append(np.maximum(total.max(axis=1), 0))
        logits = np.concatenate(pooled, axis=1) @ model["out"] + model["out_bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[at : at + 512] = e / e.sum(axis=1, keepdims=True)
    return out


def train(labelled: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """Fit on ``sample_rows`` rows at most, those of the lowest hash of doc_id and text; None if no row has a label and a letter.

    Repeated rows, rows that share a doc_id and rows without one have hashes of their own texts: the bound holds for them too.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"), F.xxhash64(F.lit("language sample"), "doc_id", F.col(text).cast("string")).alias("h"))
    cut = rows.select("h").groupBy().agg(F.count("*").alias("n")).first()["n"]
    if cut > sample_rows:  # rows beyond a threshold with room to spare need not be sorted
        rows = rows.where(F.col("h") <= lowest(cut, sample_rows))
    rows = rows.orderBy("h", "label").limit(sample_rows).select("label", "text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                owner, codes = windows_of(data, offsets)
                lettered = _IS_LETTER_CLASS[codes].any(axis=1)
                owner, codes = owner[lettered], codes[lettered]
                bounds = np.searchsorted(owner, np.arange(b - a + 1))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([codes[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())], ["label", "windows"])

    found = [r for r in rows.mapInArrow(windows, "label string, windows binary").toArrow().to_pylist() if r["windows"]]
    if not found:
        return None
    found.sort(key=lambda r: (r["label"], r["windows"]))
    languages = sorted({r["label"] for r in found})
    network = Network(languages)
    at = {x: i for i, x in enumerate(languages)}
    cut_up = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in found]
    network.train(np.concatenate(cut_up), np.repeat(np.arange(len(found)), [len(x) for x in cut_up]), np.array([at[r["label"]] for r in found]))
    return network.tables()


_IS_LETTER_CLASS = np.arange(CLASSES) >= 5


def predicted(docs: DataFrame, model: dict | None, text: str = "text") -> tuple[DataFrame, str, str]:
    """Every row of ``docs`` with the language of its own text and its score, and the names of the two columns.

    The score is the mean probability of the language, 0 to 1. Null texts and texts without a letter are ``und`` with
    score 0; so is every text if there is no model. Repeated rows and rows with a null doc_id are judged each.
    """

    def of(column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for a, b, data, offsets in text_slices(column):
            has = np.array([bool(t) and any(map(str.isalpha, t)) for t in column.slice(a, b - a).to_pylist()])
            langs, scores = [UNDETERMINED] * (b - a), np.zeros(b - a)
            if model is not None and has.any():
                owner, codes = windows_of(data, offsets)
                weight = _IS_LETTER_CLASS[codes].sum(axis=1) + 1e-6
                total = np.zeros((b - a, len(model["languages"])))
                np.add.at(total, owner, window_probabilities(model, codes) * weight[:, None])
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
                for k in np.flatnonzero(has):
                    top = int(total[k].argmax())
                    langs[k], scores[k] = model["languages"][top], min(1.0, float(total[k, top]))
            yield a, b, [pa.array(langs), pa.array(scores)]

    rows, names = with_columns(docs, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], of)
    return rows, *names


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, as ``predicted`` has it."""
    return predicted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), model)[0].select("doc_id", "lang_pred", "score")


def fold(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % of


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out quarter."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(F.coalesce(fold("doc_id", 4), F.lit(0)) != 2))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
