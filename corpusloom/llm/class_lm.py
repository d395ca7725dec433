"""Brown class-based bigrams: words in classes found by exchange, class transitions, word emissions, smoothed scores.

Texts become blocks of word numbers, each block with a dictionary of its own, so that what depends on a word is worked
out once a block and word and not once an occurrence. Sequential exchange on the driver puts the most frequent words
into classes, over their bigram counts in the whole corpus (a matrix of fixed size). From there the whole vocabulary is
exchanged in sweeps on Spark: blocks count the classes that stand before and behind each of their words, buckets of the
hash space gather these counts, every word of a bucket, the frequent ones too, moves to the class that adds most to the
mutual information of adjacent classes, and classes go back to the blocks, which count the class bigrams anew. Words of
a sweep move at once, against the table of the sweep before.

P(word | previous) = MIX * P(class | previous class) * P(word | class) + (1 - MIX) * (c + 0.1) / (N + 0.1 (V + 1)),
over the V words of training and one event for all others. Classes discount each word by half a count and leave what
is saved to the unknown event, so either part sums to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import random_words, text_slices, words_of
from .durable import durable, read_table, release
from .language_id import fold

CLASSES = 64
#: Words that sequential exchange starts from, and sweeps over these at most.
HEAD, HEAD_SWEEPS = 512, 4
#: A head word is at least this share of the tokens of some block; a word of that share of all tokens always is.
HEAD_SHARE = 1e-4
#: Sweeps of the whole vocabulary.
SWEEPS = 3
BLOCK_TOKENS = 2_000_000
#: Words of all blocks' dictionaries that meet in one bucket (expected number).
BUCKET_WORDS = 1_000_000
MIX, DISCOUNT, ADDED = 0.9, 0.5, 0.1

_END = random_words(1, 20)[0]
_BLOCK = "block long, doc_ids array<long>, train array<boolean>, held array<boolean>, sizes array<long>, n_words long, words binary, counts binary, place binary, ids binary"


def _shut(values: np.ndarray, kind: type) -> bytes:
    """Numbers of one kind, compressed byte plane by byte plane."""
    raw = np.ascontiguousarray(values, kind)
    return zstandard.compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes(), 1)


def _opened(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).reshape(-1).view(kind)


def blocks_of(docs: DataFrame, train: Column, held: Column, text: str = "text") -> DataFrame:
    """Texts as numbers: a row for some BLOCK_TOKENS tokens of whole texts, each text closed by an end token.

    ``words`` are the hashes of the block's words in order, ``counts`` each word's occurrences in training texts,
    ``ids`` the tokens as ranks by frequency (small numbers compress well) and ``place`` each rank's place in ``words``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held_back, tokens = 0, [], 0
        for batch in batches:
            flags = [batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)]
            for a, b, data, offsets in text_slices(batch.column(3)):
                words = words_of(data, offsets)
                sizes = words.per_text() + 1
                stream = np.full(int(sizes.sum()), _END)
                stream[np.arange(len(words.text)) + words.text] = words.hashes()
                held_back.append((batch.column(0).slice(a, b - a), flags[0][a:b], flags[1][a:b], sizes, stream))
                tokens += len(stream)
                if tokens >= BLOCK_TOKENS:
                    yield _block(held_back, made)
                    made, held_back, tokens = made + 1, [], 0
        if held_back:
            yield _block(held_back, made)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), held.alias("held"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _BLOCK)


def _block(parts: list, made: int) -> pa.RecordBatch:
    ids = pa.chunked_array([p[0] for p in parts]).combine_chunks()
    train, held, sizes, stream = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
    words, places, n = np.unique(stream, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    counts = np.bincount(places[np.repeat(train, sizes)], minlength=len(words))
    number = TaskContext.get().partitionId() * (1 << 20) + made
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    columns = [
        pa.array([number]), one(ids), one(pa.array(train, pa.bool_())), one(pa.array(held, pa.bool_())), one(pa.array(sizes.astype(np.int64))), pa.array([len(words)]),
        *(pa.array([x]) for x in (words.tobytes(), _shut(counts, np.int64), _shut(order, np.uint32), _shut(rank[places], np.uint32))),
    ]
    return pa.record_batch(columns, [c.split()[0] for c in _BLOCK.split(", ")])


class _Open:
    """A block read back; ``at`` holds its tokens as places in its sorted words."""

    def __init__(self, row: dict):
        self.number, self.row = row["block"], row
        self.train, self.sizes = row["train"].to_numpy(zero_copy_only=False), row["sizes"].to_numpy()
        self.place = _opened(row["place"], np.uint32)
        self.at = self.place[_opened(row["ids"], np.uint32)]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def words(self) -> np.ndarray:
        return np.frombuffer(self.row["words"], np.uint64)

    def pairs(self, number: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Training tokens' places among the block's words, and ``number`` of the token before each (of an end, at a start)."""
        before = np.empty(len(self.at), number.dtype)
        before[1:] = number[self.at[:-1]]
        before[self.starts] = end
        keep = np.repeat(self.train, self.sizes)
        return self.at[keep], before[keep]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dictionaries; lists stay Arrow arrays, as numbers beside nulls would lose digits otherwise."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: (v.values if hasattr(v, "values") else v.as_py()) for n, v in zip(batch.schema.names, (batch.column(i)[k] for i in range(batch.num_columns)), strict=True)}


def head_words(blocks: DataFrame, most: int = HEAD) -> np.ndarray:
    """Hashes of the most frequent words, the end token first; at most ``most`` (a limit that is the feature here)."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = np.frombuffer(row["words"], np.int64), _opened(row["counts"], np.int64)
            often = counts >= max(2, HEAD_SHARE * counts.sum())
            yield pa.record_batch([pa.array(words[often]), pa.array(counts[often])], ["word", "n"])

    def top(found: DataFrame, n: int) -> list[int]:
        return [r["word"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(n).collect()]

    end = int(_END.view(np.int64))
    dictionaries = blocks.select("words", "counts")
    perhaps = np.sort(np.array(top(dictionaries.mapInArrow(some, "word long, n long"), 4 * most), np.int64))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = np.frombuffer(row["words"], np.int64), _opened(row["counts"], np.int64)
            mine = np.isin(words, perhaps)
            yield pa.record_batch([pa.array(words[mine]), pa.array(counts[mine])], ["word", "n"])

    return np.array([end, *top(dictionaries.mapInArrow(exact, "word long, n long"), most - 1)], np.int64)


def _number(words: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Place of each word in the head, len(head) if it is not in it."""
    order = np.argsort(head)
    at = np.minimum(np.searchsorted(head[order], words), len(head) - 1)
    return np.where(head[order][at] == words, order[at], len(head))


def head_bigrams(blocks: DataFrame, head: np.ndarray) -> np.ndarray:
    """Bigram counts of the head words and of all others as one, over all training texts."""
    size = len(head) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for row in _rows(batches):
            block = _Open(row)
            number = _number(block.words().view(np.int64), head)
            word, before = block.pairs(number, 0)
            total += np.bincount(before * size + number[word], minlength=size * size)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["pair", "n"])

    rows = blocks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each row of a bigram matrix: every word in turn moves where sum n log n of adjacent classes is largest.

    The last row (all other words) stays alone in the last class; the most frequent words open the other classes.
    """
    n = len(bigrams)
    label = np.full(n, classes - 1)
    order = np.argsort(-bigrams.sum(axis=0)[:-1], kind="stable")
    label[order] = np.minimum(np.arange(n - 1), np.arange(n - 1) % (classes - 1))
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    one = np.eye(classes)
    for _ in range(HEAD_SWEEPS):
        moved, table = 0, one[label].T @ bigrams @ one[label]
        for w in order:
            member = one[label]
            out, into, loop = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            old = label[w]
            out[old] -= loop
            into[old] -= loop
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= loop
            row, col = table.sum(axis=1), table.sum(axis=0)
            gain = (xlogx(table + out[None, :]) - xlogx(table)).sum(axis=1) + (xlogx(table + into[:, None]) - xlogx(table)).sum(axis=0)
            both = np.diag(table)
            gain += xlogx(both + np.diag(np.add.outer(into, out)) + loop) - xlogx(both + out) - xlogx(both + into) + xlogx(both)
            gain -= xlogx(row + out.sum() + loop) - xlogx(row) + xlogx(col + into.sum() + loop) - xlogx(col)
            new = int(gain[:-1].argmax())
            table[new] += out
            table[:, new] += into
            table[new, new] += loop
            moved += new != old
            label[w] = new
        if not moved:
            break
    return label


_PACKETS = "bucket int, block long, words binary, n binary, place binary, many binary, codes binary, times binary, pairs array<long>"
_CLASSED = "bucket int, block long, n binary, place binary, classes binary, distinct array<long>"


def _edges(buckets: int) -> np.ndarray:
    """First hash of each bucket but the first; buckets are ranges of the hash space."""
    return np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], np.uint64)


def _packets(block: _Open, known: np.ndarray, buckets: int, classes: int, end: int, sent: list[dict] | None) -> Iterator[dict]:
    """What a block tells each bucket of its words there: how often which classes stand before and behind each.

    First come the words' hashes and counts; later what the bucket said of them, their numbers in it (``sent``).
    """
    word, before = block.pairs(known, end)
    after = known[word][1:]
    keep = block.at[np.repeat(block.train, block.sizes)] != int(block.at[-1]) if len(block.at) else np.zeros(0, bool)
    wide = 2 * classes
    key = np.concatenate([word.astype(np.int64) * wide + before, word[:-1][keep[:-1]].astype(np.int64) * wide + classes + after[keep[:-1]]])
    key, times = np.unique(key, return_counts=True)
    bounds = np.searchsorted(key // wide, np.arange(block.row["n_words"] + 1))
    if sent is None:
        words, counts = block.words(), _opened(block.row["counts"], np.int64)
        cuts = [0, *np.searchsorted(words, _edges(buckets)).tolist(), len(words)]
        parts = [{"bucket": k, "words": words[a:b].tobytes(), "n": _shut(counts[a:b], np.int64), "from": a, "to": b} for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    else:
        upto = np.cumsum([p["size"] for p in sent])
        parts = [{"bucket": p["bucket"], "n": p["n"], "place": p["place"], "from": int(u) - p["size"], "to": int(u)} for p, u in zip(sent, upto)]
    for p in parts:
        a, b = bounds[p["from"]], bounds[p["to"]]
        many = np.diff(bounds[p["from"] : p["to"] + 1])
        yield p | {"block": block.number, "many": _shut(many, np.uint32), "codes": _shut(key[a:b] % wide, np.uint8), "times": _shut(times[a:b], np.uint32)}


def _batch_of(rows: list[dict], shape: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [c.split() for c in shape.split(", ")]
    return pa.record_batch([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], [f[0] for f in fields])


def _assign(score: np.ndarray, classes: int):
    """In a bucket (a partition): the best class of each of its words by all that the blocks tell of it."""
    wide = 2 * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for r in _rows(batches) if r["block"] is not None]
        if not rows:
            return
        if rows[0]["words"] is not None:
            each = [np.frombuffer(r["words"], np.uint64) for r in rows]
            words, own = np.unique(np.concatenate(each), return_inverse=True)
            size, lengths = len(words), [len(x) for x in each]
        else:
            each = [np.cumsum(_opened(r["place"], np.uint32), dtype=np.int64) for r in rows]
            own, lengths = np.concatenate(each), [len(x) for x in each]
            size = int(own.max()) + 1
        del each
        n = np.concatenate([_opened(r["n"], np.int64) for r in rows])
        if rows[0]["words"] is not None:  # counts of one block each: the corpus's
            n = np.bincount(own, weights=n, minlength=size).astype(np.int64)[own]
        entry = np.repeat(own.astype(np.uint32), np.concatenate([_opened(r["many"], np.uint32) for r in rows]))
        code, times = (np.concatenate([_opened(r[c], t) for r in rows]) for c, t in (("codes", np.uint8), ("times", np.uint32)))
        order = np.argsort(entry, kind="stable")
        entry, code, times = entry[order], code[order], times[order]
        label = np.empty(size, np.uint8)
        for a in range(0, size, 16384):
            b = min(a + 16384, size)
            i, j = np.searchsorted(entry, [a, b])
            seen = np.bincount((entry[i:j] - a).astype(np.int64) * wide + code[i:j], weights=times[i:j], minlength=(b - a) * wide)
            label[a:b] = (seen.reshape(-1, wide) @ score).argmax(axis=1)
        trained = np.zeros(size, bool)
        trained[own[n > 0]] = True
        out, at = [{"bucket": rows[0]["bucket"], "distinct": np.bincount(label[trained], minlength=classes).tolist()}], 0
        for r, length in zip(rows, lengths):
            mine = own[at : at + length]
            place = _shut(np.diff(mine, prepend=0), np.uint32) if r["words"] is not None else r["place"]
            out.append({"bucket": r["bucket"], "block": r["block"], "n": _shut(n[at : at + length], np.int64), "place": place, "classes": _shut(label[mine], np.uint8)})
            at += length
            if len(out) >= 100:
                yield _batch_of(out, _CLASSED)
                out = []
        yield _batch_of(out, _CLASSED)

    return run


def _gathered(found: pa.Table) -> tuple[list[dict], np.ndarray]:
    """A block's packets in the order of their buckets, and the classes of its words."""
    sent = sorted(found.to_pylist(), key=lambda r: r["bucket"])
    each = [_opened(r["classes"], np.uint8) for r in sent]
    for r, x in zip(sent, each):
        r["size"] = len(x)
    return sent, np.concatenate(each)


def _first(table: pa.Table) -> dict:
    return next(_rows(table.combine_chunks().to_batches()))


def _again(buckets: int, classes: int):
    """Of a block and its words' new classes: its class bigrams and the next packets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            block = _Open(_first(left))
            sent, label = _gathered(right)
            end = int(label[block.at[-1]])
            word, before = block.pairs(label.astype(np.int64), end)
            out.append({"bucket": -1, "pairs": np.bincount(before * classes + label[word], minlength=classes * classes).tolist()})
            out += _packets(block, label.astype(np.int64), buckets, classes, end, sent)
        return pa.Table.from_batches([_batch_of(out, _PACKETS)])

    return run


_LEARNED = "block long, doc_ids array<long>, train array<boolean>, held array<boolean>, sizes array<long>, ids binary, class binary, n binary"


def _learn(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block with each of its words' class and count in all training texts, in the order of its ranks."""
    if not left.num_rows:
        return pa.Table.from_batches([_batch_of([], _LEARNED)])
    sent, label = _gathered(right)
    place = _opened(left["place"][0].as_py(), np.uint32)
    n = np.concatenate([_opened(r["n"], np.int64) for r in sent])
    out = left.select(["block", "doc_ids", "train", "held", "sizes", "ids"])
    return out.append_column("class", pa.array([_shut(label[place], np.uint8)])).append_column("n", pa.array([_shut(n[place], np.int64)]))


def _informs(table: np.ndarray) -> np.ndarray:
    """What a neighbour's class (left ones, then right ones) adds to the mutual information by own class."""
    table = table + 0.1
    gain = np.log(table * table.sum() / table.sum(axis=1, keepdims=True) / table.sum(axis=0, keepdims=True))
    return np.concatenate([gain, gain.T])


def class_table(blocks: DataFrame, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[DataFrame, np.ndarray]:
    """The blocks with each of their words' class and count in all training texts; how many training words each class has."""
    size = blocks.agg(F.sum("n_words").alias("words"), F.count("*").alias("blocks")).first()
    buckets, tasks = max(1, -(-(size["words"] or 0) // BUCKET_WORDS)), max(1, size["blocks"])
    head = head_words(blocks)
    bigrams = head_bigrams(blocks, head)
    label = exchange(bigrams, classes)
    member = np.eye(classes)[label]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Open(row)
            known = label[_number(block.words().view(np.int64), head)]
            yield _batch_of(list(_packets(block, known, buckets, classes, int(label[0]), None)), _PACKETS)

    packets, table, dealt = blocks.drop("doc_ids", "held").mapInArrow(start, _PACKETS), member.T @ bigrams @ member, None
    for sweep in range(max(1, sweeps)):
        found = durable(packets.where("bucket >= 0").repartitionById(buckets, F.col("bucket")).mapInArrow(_assign(_informs(table), classes), _CLASSED), "classes")
        if dealt is not None:
            release(packets, dealt)
        dealt = found
        distinct = np.array(found.where("block IS NULL").select("distinct").toArrow()["distinct"].to_pylist(), float).reshape(-1, classes).sum(axis=0)
        sides = [blocks.repartition(tasks, "block"), found.where("block IS NOT NULL").drop("distinct").repartition(tasks, "block")]
        if sweep + 1 < sweeps:
            narrow = blocks.select("block", "train", "sizes", "n_words", "place", "ids").repartition(tasks, "block")
            packets = durable(narrow.groupBy("block").cogroup(sides[1].groupBy("block")).applyInArrow(_again(buckets, classes), _PACKETS), "packets")
            pairs = packets.where("bucket < 0").select(F.posexplode("pairs").alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
            table = np.zeros(classes * classes)
            table[pairs["cell"].to_numpy()] = pairs["n"].to_numpy()
            table = table.reshape(classes, classes)
    left = blocks.select("block", "doc_ids", "train", "held", "sizes", "place", "ids").repartition(tasks, "block")
    learned = durable(left.groupBy("block").cogroup(sides[1].groupBy("block")).applyInArrow(_learn, _LEARNED), "learned")
    release(found)
    return learned, distinct


def _transitions(learned: DataFrame, classes: int) -> np.ndarray:
    """Class bigram counts over training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for row in _rows(batches):
            label, ids = _columns(row)[:2]
            end = label[ids[-1]] if len(ids) else 0
            for a, b, keep, starts in _pieces(row):
                own = label[ids[a:b]].astype(np.int64)
                before = np.concatenate([[end], own[:-1]])
                before[starts] = end
                total += np.bincount((before * classes + own)[keep], minlength=classes * classes)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["cell", "n"])

    rows = learned.select("train", "sizes", "ids", "class", "n").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(classes, classes)


def _columns(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _opened(row["class"], np.uint8), _opened(row["ids"], np.uint32), _opened(row["n"], np.int64)


def _pieces(row: dict, most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Token ranges of some whole texts, which of their tokens train, and where texts start in them."""
    sizes, train = row["sizes"].to_numpy(), row["train"].to_numpy(zero_copy_only=False)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + most, "right")) - 1)
        yield int(edge[at]), int(edge[to]), np.repeat(train[at:to], sizes[at:to]), edge[at:to] - edge[at]
        at = to


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fit_and_score(docs: DataFrame, train: Column, held: Column, text: str = "text", classes: int = CLASSES) -> DataFrame:
    """Learn from the rows where ``train`` holds and score every row; ``held`` is carried as held_out.

    base_score and score are log10 probabilities of the whole text and its end. Null, empty and blank texts are an end
    alone. Repeated rows count and are scored each. Without training rows all probabilities are 1 (score 0). An empty
    table gives no rows.
    """
    blocks = durable(blocks_of(docs, F.coalesce(train, F.lit(False)), F.coalesce(held, F.lit(False)), text), "blocks")
    learned, distinct = class_table(blocks, classes)
    release(blocks)
    table = _transitions(learned, classes)
    tokens, vocabulary = int(table.sum()), int(distinct.sum())
    size = table.sum(axis=0)
    move = (table + 0.1 * (size / max(tokens, 1))[None, :] * classes) / np.maximum(table.sum(axis=1, keepdims=True) + 0.1 * classes, 1e-300)
    unknown = move @ (DISCOUNT * distinct / np.maximum(size, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            label, ids, n = _columns(row)
            end = label[ids[-1]]
            done: list[list[np.ndarray]] = [[], [], []]
            for a, b, _, starts in _pieces(row):
                own, c = label[ids[a:b]], n[ids[a:b]].astype(np.float64)
                before = np.concatenate([[end], own[:-1]])
                before[starts] = end
                plain = (c + ADDED) / (tokens + ADDED * (vocabulary + 1))
                by_class = np.where(c > 0, move[before, own] * (c - DISCOUNT) / np.maximum(size[own], 1), unknown[before])
                mixed = MIX * by_class + (1 - MIX) * plain if tokens else plain
                for out, value in zip(done, (np.log10(plain), np.log10(mixed), c > 0), strict=True):
                    out.append(np.add.reduceat(value.astype(np.float64), starts))
            base, score, known = map(np.concatenate, done)
            columns = [row["doc_ids"], row["held"], row["sizes"], pa.array(known.astype(np.int64)), pa.array(np.full(len(known), tokens)), pa.array(base), pa.array(score)]
            yield pa.record_batch(columns, [c.split()[0] for c in _SCORED.split(", ")])

    return learned.mapInArrow(run, _SCORED)


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by class bigrams learned from nine tenths of them."""
    return fit_and_score(read_table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0, fold("doc_id", 10) == 0)
