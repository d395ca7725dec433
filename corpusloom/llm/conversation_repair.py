"""Conversation structure repair: weighted CYK parsing of turns over a repair grammar.

Sound role sequences are ``(s?(ua)+)?``. The grammar in Chomsky normal form has a symbol X(p,q) for every two states of
that language ("nothing yet", "after s", "after u", "after a") and the rules X(p,q) -> X(p,m) X(m,q); a turn is kept,
given another role or deleted, and roles may be inserted at both ends of any span (insertion closure). A cell holds the
least (cost, audit) of its symbol over its span, as one integer: cost, two bits a letter from the left, letters. Of two
audits of one span at one cost neither begins the other (what the longer had more would be insertions, which cost), so
the order of integers is that of (cost, audit) and stays so under concatenation.

Blocks of at most ten turns are parsed span length by span length over all splits, many blocks at once. As X(p,q)
composes at any cut, a longer conversation is parsed upwards from its blocks, spans of like length first. A conversation
may be spread over any number of tasks while it is parsed; its text is put together by one task, in order, which keeps
one turn and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import read_table

BLOCK = 10
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
LETTERS = "DIKR"

_STEP = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
_ENDS = "0a"
_FULL = {"u": "user", "a": "assistant"}


def _symbols() -> list[tuple[str, str]]:
    reach = {(p, p) for p in "0sua"}
    while more := {(p, r) for p, q in reach for (x, _), r in _STEP.items() if q == x} - reach:
        reach |= more
    return sorted(reach)


SYMBOLS = _symbols()
#: For each rule the places of its target, left and right symbol, ordered by target.
RULES = sorted((SYMBOLS.index((p, q)), SYMBOLS.index((p, m)), SYMBOLS.index((m, q))) for p, q in SYMBOLS for m in "0sua" if (p, m) in SYMBOLS and (m, q) in SYMBOLS)
_LEFT, _RIGHT = (np.array([r[k] for r in RULES]) for k in (1, 2))
_FIRST_RULE = np.searchsorted([r[0] for r in RULES], np.arange(len(SYMBOLS)))

# a cell: 10 bits of cost, 48 bits of letters from the left, 5 bits of length
_COST, _LENGTH = 53, 31
_BITS = (1 << 48) - 1
NONE = 1023 << _COST


def cell(cost: int, audit: str) -> int:
    letters = 0
    for k, letter in enumerate(audit):
        letters |= LETTERS.index(letter) << (46 - 2 * k)
    return cost << _COST | letters << 5 | len(audit)


def read_cell(value: int) -> tuple[int, str]:
    n, letters = value & _LENGTH, value >> 5 & _BITS
    return value >> _COST, "".join(LETTERS[letters >> (46 - 2 * k) & 3] for k in range(n))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cells of a span from those of its two parts: the least over all rules of each symbol (last axis)."""
    a, b = left[..., _LEFT], right[..., _RIGHT]
    length = a & _LENGTH
    letters = (a >> 5 & _BITS) | (b >> 5 & _BITS) >> 2 * length
    both = (a >> _COST) + (b >> _COST) << _COST | letters << 5 | length + (b & _LENGTH)
    return np.minimum.reduceat(np.where((a >= NONE) | (b >= NONE), NONE, both), _FIRST_RULE, axis=-1)


def _cells(found: dict[tuple[str, str], tuple[int, str]]) -> np.ndarray:
    return np.array([cell(*found[s]) if s in found else NONE for s in SYMBOLS], np.int64)


def _insertions() -> np.ndarray:
    """Cells of an empty span: what insertions alone lead from one state to another."""
    one = _cells({(p, p): (0, "") for p in "0sua"} | {(p, q): (INSERT, "I") for (p, x), q in _STEP.items() if x in _FULL})
    return combine(one, one)


OTHER, FORCED = 3, 8


def _turns() -> np.ndarray:
    """Cells of one turn, by initial (s, u, a, other) and whether its text is cut off; then of turns that must go, whose cost is counted apart."""
    kinds, closure = [], _insertions()
    for initial in "sua?":
        for cut in (0, CUT_OFF):
            found = {(p, p): (DELETE, "D") for p in "0sua"}
            for (p, x), q in _STEP.items():
                options = ([(KEEP + cut, "K")] if x == initial else []) + ([(REROLE + cut, "R")] if x in _FULL else [])
                if options:
                    found[p, q] = min(options)
            kinds.append(_cells(found))
    kinds.append(_cells({(p, p): (0, "D") for p in "0sua"}))
    return np.stack([combine(combine(closure, k), closure) for k in kinds])


TURNS = _turns()


def parse(kinds: np.ndarray) -> np.ndarray:
    """(blocks, symbols): the top cells of blocks of as many turns, given by kind; all spans are filled, by length."""
    n = kinds.shape[1]
    chart = {1: TURNS[kinds]}
    for size in range(2, n + 1):
        at = n - size + 1
        chart[size] = np.minimum.reduce([combine(chart[m][:, :at], chart[size - m][:, m : m + at]) for m in range(1, size)])
    return chart[n][:, 0]


Span = list  # of (cost, audit) or None, a symbol each


def concatenated(left: Span, right: Span) -> Span:
    """Cells of two long spans that follow each other, as (cost, audit)."""
    out: Span = [None] * len(SYMBOLS)
    for target, a, b in RULES:
        if left[a] is not None and right[b] is not None:
            made = left[a][0] + right[b][0], left[a][1] + right[b][1]
            if out[target] is None or made < out[target]:
                out[target] = made
    return out


class Spans:
    """Spans of one conversation in order; equally long neighbours are combined first, so that a letter is copied few times."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Span]] = []

    def add(self, span: Span, size: int = 1) -> None:
        self.stack.append((size, span))
        while len(self.stack) > 1 and self.stack[-2][0] <= self.stack[-1][0]:
            self._join()

    def _join(self) -> None:
        (n, left), (m, right) = self.stack[-2:]
        self.stack[-2:] = [(n + m, concatenated(left, right))]

    def whole(self) -> Span:
        while len(self.stack) > 1:
            self._join()
        return self.stack[0][1]


_FACTS = ["blank", "duplicate", "truncated", "illegal", "forced", "distinct_turns"]


class Facts:
    """Counts of a stretch of turns, its first and last (initial, turn) and its least known turn, so that stretches can be joined."""

    def __init__(self, counts: list[int], first: tuple, last: tuple, least: int | None):
        self.counts, self.first, self.last, self.least = counts, first, last, least

    def then(self, other: Facts) -> Facts:
        counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        counts[3] += not _sound(self.last[0], other.first[0])
        counts[5] -= self.last[1] is not None and self.last[1] == other.first[1]
        return Facts(counts, self.first, other.last, other.least if self.least is None else self.least)  # turns ascend


def _sound(a: int, b: int) -> bool:
    """su, ua or au, as numbers of s, u, a."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


_BLANK = r"[\x20\x09-\x0D]"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as the crc32 of ``conv_id:turn`` modulo 20 damages them; null role and text are a blank."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_k"))
    k = F.col("_k")
    changed = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(k == 3, 2).otherwise(1).cast("long").alias("copies"))


def _keyed(turns: DataFrame) -> DataFrame:
    return turns.withColumn("digest", F.sha2("text", 256))


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, blank, cut, seen): equal rows of a turn once, with how often; no text moves.

    ``seen``: role and text came in an earlier turn. Rows of a turn go by role, then by the sha256 of their texts.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{_BLANK}*+\z")
    keys = ["conv_id", "turn", "role", "digest"]
    once = _keyed(turns).withColumn("blank", blank).withColumn("cut", cut).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut"))
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))["turn"]  # no turn comes before turn 0
    first = once.groupBy("conv_id", "role", "digest").agg(earliest.alias("turn"))
    marks = first.select(*keys, F.lit(0).cast("long").alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(True).alias("first"))
    both = once.withColumn("first", F.lit(False)).unionByName(marks)
    return both.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut"), (~F.bool_or("first")).alias("seen"))


_CELL = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_SPAN = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("cells", _CELL), *(T.StructField(n, T.LongType()) for n in _FACTS),
    T.StructField("first_initial", T.LongType()), T.StructField("last_initial", T.LongType()), T.StructField("first_turn", T.LongType()), T.StructField("last_turn", T.LongType()), T.StructField("least_turn", T.LongType()),
])
_SPAN_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("cells", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))), *((n, pa.int64()) for n in _FACTS),
    ("first_initial", pa.int64()), ("last_initial", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("least_turn", pa.int64()),
])


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it; nulls are equal."""
    known = np.array(column.is_valid())
    values = column.fill_null(0).to_numpy(zero_copy_only=False)
    out = np.ones(len(column), bool)
    out[1:] = (values[1:] != values[:-1]) | (known[1:] != known[:-1])
    return out


def _block_spans(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[Span], Facts]]:
    """(conversation, its blocks' cells, facts) of each conversation in a batch of sorted rows."""
    conv, turn = batch.column("conv_id"), batch.column("turn")
    initial, copies = (batch.column(c).to_numpy() for c in ("initial", "copies"))
    blank, cut, seen = (np.array(batch.column(c).to_pylist(), bool) for c in ("blank", "cut", "seen"))
    new = _changes(conv)
    forced = blank | seen
    own = np.where(forced, FORCED, initial * 2 + cut)  # kind of the row's first copy
    again = ~forced & (copies > 1)  # its other copies must go
    row = np.repeat(np.arange(len(own)), 1 + again)
    other = np.zeros(len(row), bool)
    other[1:] = row[1:] == row[:-1]
    kind = np.where(other, FORCED, own[row])
    times = np.where(other, copies[row] - 1, np.where(forced[row], copies[row], 1))
    starts = np.flatnonzero(new[row] & ~other)
    ends = np.append(starts[1:], len(row))
    at = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(starts, ends)])
    size = np.minimum(BLOCK, ends[np.searchsorted(starts, at, "right") - 1] - at)
    top = np.empty((len(at), len(SYMBOLS)), np.int64)
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        top[which] = parse(kind[at[which][:, None] + np.arange(n)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    known, value = np.array(turn.is_valid()), turn.fill_null(0).to_numpy()
    fresh = known & (_changes(turn) | new)
    pair = np.zeros(len(own), bool)
    pair[1:] = ~new[1:] & ~np.array([_sound(a, b) for a, b in zip(initial[:-1].tolist(), initial[1:].tolist())], bool)
    sums = [np.where(blank, copies, 0), np.where(blank, 0, np.where(seen, copies, copies - 1)), ~forced & cut, pair + copies - 1, np.where(forced, copies, copies - 1), fresh]
    counts = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in sums], axis=1).tolist()
    block_of = np.searchsorted(starts, at, "right") - 1
    edges = np.searchsorted(block_of, np.arange(len(starts) + 1))
    turns = [v if k else None for v, k in zip(value.tolist(), known.tolist())]
    least = np.minimum.reduceat(np.where(known, np.arange(len(known)), len(known)), first).tolist()  # row of the first known turn
    for k, key in enumerate(conv.take(pa.array(first)).to_pylist()):
        spans = [_with_copies(top[b], times[at[b] : at[b] + size[b]]) for b in range(edges[k], edges[k + 1])]
        yield key, spans, Facts(counts[k], (int(initial[first[k]]), turns[first[k]]), (int(initial[last[k]]), turns[last[k]]), turns[least[k]] if least[k] <= last[k] else None)


def _with_copies(cells: np.ndarray, times: np.ndarray) -> Span:
    """Cells as (cost, audit); a letter D of several copies is repeated."""
    plain = [None if c >= NONE else read_cell(c) for c in cells.tolist()]
    if (times == 1).all():
        return plain
    out: Span = []
    for c in plain:
        turn = iter(times.tolist())
        out.append(c and (c[0], "".join(x if x == "I" else x * next(turn) for x in c[1])))
    return out


def _closed(done: list[tuple]) -> pa.RecordBatch:
    rows = [
        {"conv_id": key, "part": part, "cells": [c and {"cost": c[0], "audit": c[1]} for c in span], **dict(zip(_FACTS, facts.counts)), "first_initial": facts.first[0], "last_initial": facts.last[0], "first_turn": facts.first[1], "last_turn": facts.last[1], "least_turn": facts.least}
        for key, part, span, facts in done
    ]
    return pa.RecordBatch.from_pylist(rows, _SPAN_ARROW)


def parsed(rows: DataFrame) -> DataFrame:
    """One row a conversation and range partition of ``faults``: the cells over its turns there, and its counts."""
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER).cast("long")
    order = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", number.alias("initial"), "copies", "blank", "cut", "seen", F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spans, facts, part = None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            done, part = [], batch.column("part")[0].as_py()
            for conv, blocks, counted in _block_spans(batch):
                if facts is None or conv != key:
                    if facts is not None:
                        done.append((key, part, spans.whole(), facts))
                    key, spans, facts = conv, Spans(), counted
                else:
                    facts = facts.then(counted)
                for block in blocks:
                    spans.add(block)
            yield _closed(done)
        if facts is not None:
            yield _closed([(key, part, spans.whole(), facts)])

    return dealt.mapInArrow(run, _SPAN)


_FOUND = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string")]


def audits(spans: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``ids``; without turns zeros and no letters."""
    both = spans.unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("part")), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def closed(key: int | None, spans_: Spans, facts: Facts | None) -> tuple:
        if facts is None:
            return (key, 0, 0, 0, 0, 0, 0, "")
        cost, audit = min(c for (p, q), c in zip(SYMBOLS, spans_.whole(), strict=True) if p == "0" and q in _ENDS and c)
        blank, duplicate, truncated, illegal, forced, distinct = facts.counts
        gaps = 0 if facts.least is None else facts.last[1] - facts.least + 1 - distinct
        return (key, gaps, blank, duplicate, truncated, illegal, cost + DELETE * forced, audit)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 8
        return pa.record_batch([pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(_FOUND, columns, strict=True)], _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["part"] < 0:  # opens a conversation
                    if now is not None:
                        done.append(closed(*now))
                    now = (r["conv_id"], Spans(), None)
                    continue
                now[1].add([c and (c["cost"], c["audit"]) for c in r["cells"]])
                facts = Facts([r[n] for n in _FACTS], (r["first_initial"], r["first_turn"]), (r["last_initial"], r["last_turn"]), r["least_turn"])
                now = (*now[:2], facts if now[2] is None else now[2].then(facts))
            yield rows(done)
        if now is not None:
            yield rows([closed(*now)])

    return dealt.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'audit' else 'long'}" for n in _FOUND))


_FOUND = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def plan_repairs(turns: DataFrame) -> DataFrame:
    """What is wrong with every conversation and its cheapest repair; ``turns`` has conv_id, turn, role, text, copies."""
    return audits(parsed(faults(turns)), turns.select("conv_id").distinct())


def _in_order(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's row of ``found``, then its turns."""
    heads = found.withColumn("head", F.lit(True))
    rows = _keyed(turns).withColumn("head", F.lit(False))
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "role", "digest")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row of ``found``,) where a conversation begins, then (edit, role, text) of each turn of its repaired form; None after each batch."""
    audit, at, state = "", 0, "0"

    def placed(edit: str, role: str, text: str) -> tuple[str, str, str]:
        nonlocal at, state
        at += 1
        state = role[:1] if edit == "K" else "a" if state == "u" else "u"
        return edit, role if edit == "K" else _FULL[state], text

    for batch in batches:
        for r in batch.to_pylist():
            if r["head"]:
                while at < len(audit):
                    yield placed("I", "", "")
                yield (r,)
                audit, at, state = r["audit"], 0, "0"
                continue
            for _ in range(r["copies"]):
                while audit[at] == "I":
                    yield placed("I", "", "")
                if audit[at] == "D":
                    at += 1
                else:
                    yield placed(audit[at], r["role"], r["text"])
        yield None
    while at < len(audit):
        yield placed("I", "", "")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, nth, edit, role, text): the turns of every repaired conversation, in order within a partition."""
    names = ["conv_id", "nth", "edit", "role", "text"]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 5
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *[pa.string()] * 3], strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nth, done = None, 0, []
        for x in _edits(batches):
            if x is None:
                yield rows(done)
                done = []
            elif len(x) == 1:
                key, nth = x[0]["conv_id"], 0
            else:
                done.append((key, nth, *x))
                nth += 1
        yield rows(done)

    return _in_order(turns, found).mapInArrow(run, "conv_id long, nth long, edit string, role string, text string")


def repair_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256, the sha256 of ``role:text`` of the repaired turns joined by newlines; one turn is held at a time."""

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 9
        names = [*_FOUND, "repaired_sha256"]
        return pa.record_batch([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, some, done = None, None, False, []
        for x in _edits(batches):
            if x is None:
                yield rows(done)
                done = []
            elif len(x) == 1:
                if head is not None:
                    done.append((*head, digest.hexdigest()))
                head, digest, some = [x[0][n] for n in _FOUND], hashlib.sha256(), False
            else:
                digest.update(f"{chr(10) if some else ''}{x[1]}:{x[2]}".encode())
                some = True
        yield rows(done + ([(*head, digest.hexdigest())] if head is not None else []))

    kinds = ", ".join(f"{n} {'string' if n == 'audit' else 'long'}" for n in _FOUND)
    return _in_order(turns, found).mapInArrow(run, f"{kinds}, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged, judged and repaired; the columns that the contract names."""
    original = read_table(spark, sf_dir, "conversations")
    turns = damaged(original)
    ids = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return repair_digests(turns, audits(parsed(faults(turns)), ids))
