"""Conversations as training windows of a token budget, with the mask of what is to be learned.

Prefix sums of the turns' tokens place every turn in its conversation. A window takes the turns from where the last one
ended for as long as the system turn, the history and they themselves fit the budget; the history are the turns just
before, as many as fit a budget of their own, fewer where the first new turn would not fit otherwise. Both are found by
a search on the prefix sums, so where a window ends depends on nothing but where it starts. The system turn opens every
window. Repeated turns are never learned again. Sums are two-level. A long conversation spreads over tasks by stretches
of MANY budgets: each says where windows from each of its few possible first turns would leave it, a scan of these
numbers finds the turn where each stretch is entered, and then the stretches make their windows, which may end in the
next one: they are those of one pass over the whole conversation, whatever the stretches.

A turn reads ``<|turn:ROLE|>`` newline TEXT ``<|end|>`` newline. Inside texts a backslash goes into every control string
behind its first character and any backslashes there, which also holds for control strings that had some: reversible,
and no text contains a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_bpe_ids
from .durable import durable, read_table

BUDGET, HISTORY = 1024, 192
#: Budgets of tokens in a stretch.
MANY = 64
#: Numbers of a stretch's windows.
_NUMBERS = 1 << 20

_CONTROL = r"(\||/?s>|</?SYS>>|/?INST\])"
_ESCAPE, _UNESCAPE = r"(<|\[)(\\*)" + _CONTROL, re.compile(r"(<|\[)(\\*)\\" + _CONTROL)
_TURN = re.compile(r"<\|turn:(=?)([^|]*)\|>\n(.*)<\|end\|>\n", re.DOTALL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def role_mark(role: Column) -> Column:
    """Roles of letters, digits and ``_-`` stand as they are; others in base64 behind ``=``."""
    return F.when(role.rlike(r"^[A-Za-z0-9_-]+$"), role).otherwise(F.concat(F.lit("="), F.translate(F.base64(F.encode(role, "UTF-8")), "\r\n", "")))


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, opening, body, turn_text, learned of every row. Null texts are empty, null roles are ``user``."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("opening", F.concat(F.lit("<|turn:"), role_mark(F.col("role")), F.lit("|>\n"))).withColumn("body", escape(F.col("text")))
    return rows.select("conv_id", "turn", "role", "opening", "body", F.concat("opening", "body", F.lit("<|end|>\n")).alias("turn_text"), (F.col("role") == "assistant").alias("learned"))


def in_order(turns: DataFrame) -> DataFrame:
    """Turns with ``start``, the tokens of their conversation before them, by turn, role and a hash of the text.

    Turns are sorted by ranges and summed in each range; only a range's sum of each conversation meets the others.
    """
    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["conv_id", "turn", "role", "mixed", "uid"]
    turns = turns.withColumn("mixed", F.xxhash64("turn_text")).withColumn("uid", F.monotonically_increasing_id())
    turns = turns.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id()).drop("mixed", "uid")
    ranged = durable(turns.mapInArrow(_summed, T.StructType([*turns.schema.fields, T.StructField("upto", T.LongType())])), "ranged")
    totals = ranged.groupBy("conv_id", "range").agg(F.sum("tokens").alias("total"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = ranged.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return placed.withColumn("start", F.col("base") + F.col("upto") - F.col("tokens")).drop("c", "r", "base", "upto", "range")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``upto``: tokens of the conversation in this range so far, the row's own too. Rows come in order."""
    last, so_far = object(), 0
    for batch in batches:
        if batch.num_rows:
            convs = batch.column("conv_id")
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(pc.fill_null(convs[1:], 0), pc.fill_null(convs[:-1], 0)).to_numpy(zero_copy_only=False) | (convs[1:].is_null().to_numpy(zero_copy_only=False) != convs[:-1].is_null().to_numpy(zero_copy_only=False))
            new[0] = convs[0].as_py() != last
            upto = np.cumsum(batch.column("tokens").to_numpy())
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            base = np.where(first > 0, upto[first - 1], 0 if new[0] else -so_far)
            upto = upto - base
            last, so_far = convs[-1].as_py(), int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto)], names=[*batch.schema.names, "upto"])


_SPAN = "start long, stop long, turn long, role string, repeated boolean, loss_start long, loss_stop long"
_WINDOW = f"conv_id long, window long, text string, spans array<struct<{_SPAN.replace(' ', ':').replace(',:', ',')}>>, n_tokens long"
_SPAN_KIND = pa.struct([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[k]) for n, k in (c.split() for c in _SPAN.split(", "))])


#: What a row is to a stretch, in order: where it is entered, the system turn, turns just before it, its own, those behind it.
_ENTRY, _SYSTEM, _NEAR, _OWN, _BEHIND = range(5)


class _Turn(NamedTuple):
    turn: int
    role: str
    opening: str
    body: str
    whole: str
    tokens: int
    learned: bool


def _row(conv: int | None, number: int, system: _Turn | None, first: bool, again: list[_Turn], own: list[_Turn]) -> tuple:
    spans, texts, at, tokens = [], [], 0, 0
    for turn, repeated in [*([(system, not first)] if system else []), *((t, True) for t in again), *((t, False) for t in own)]:
        learn = turn.learned and not repeated
        loss = at + len(turn.opening)
        spans.append({"start": at, "stop": at + len(turn.whole), "turn": turn.turn, "role": turn.role, "repeated": repeated, "loss_start": loss if learn else None, "loss_stop": loss + len(turn.body) if learn else None})
        texts.append(turn.whole)
        at += len(turn.whole)
        tokens += turn.tokens
    return conv, number, "".join(texts), spans, tokens


def _reach(start: np.ndarray, upto: np.ndarray, room: int, history: int) -> tuple[np.ndarray, np.ndarray]:
    """For each turn, were a window's new turns to begin with it: the first turn repeated as history, the first turn left to the next window."""
    back = np.minimum(history, np.maximum(0, room - (upto - start)))
    first = np.searchsorted(start, start - back)
    stop = np.searchsorted(upto, room + start[first], side="right")
    return first, np.maximum(stop, np.arange(len(start)) + 1)


def _exits(rows: list[tuple[int, int, int]], stretch: int, long: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(first, entry, exit) of a stretch from its (kind, start, tokens): where windows from ``entry`` leave it.

    Entries are the first turn and those that a window from the stretch before can leave: within one budget.
    ``first`` is where the conversation's first window starts.
    """
    system = sum(r[2] for r in rows if r[0] == _SYSTEM)
    turns = np.array([r for r in rows if r[0] != _SYSTEM], np.int64).reshape(-1, 3)
    kind, start, upto = turns[:, 0], turns[:, 1], turns[:, 1] + turns[:, 2]
    own = np.flatnonzero(kind == _OWN)
    if not len(own):
        return
    stop = _reach(start, upto, budget - system, history)[1]
    leave = upto[stop - 1]
    for i in own[::-1]:
        if stop[i] <= own[-1]:
            leave[i] = leave[stop[i]]
    may = own[:1] if stretch == 0 else own[(start[own] < stretch * long + budget) | (own == own[0])]
    for i in may:
        yield system, int(start[i]), int(leave[i])


def _chosen(conv: int | None, stretch: int, rows: list[tuple[int, int, _Turn]], budget: int, history: int) -> Iterator[tuple]:
    """Windows that start in a stretch, from (kind, start, turn) in order."""
    system = next((t for kind, _, t in rows if kind == _SYSTEM), None)
    fixed = system.tokens if system else 0
    turns = [r for r in rows if r[0] >= _NEAR]
    own = [i for i, r in enumerate(turns) if r[0] == _OWN]
    if not own:
        if system:
            yield _row(conv, stretch * _NUMBERS, system, True, [], [])
        return
    start = np.array([r[1] for r in turns], np.int64)
    entry = next((s for kind, s, _ in rows if kind == _ENTRY), fixed if stretch == 0 else None)
    if entry is None:
        return  # a window from the stretch before takes all
    first, stop = _reach(start, start + np.array([r[2].tokens for r in turns], np.int64), budget - fixed, history)
    at, number = int(np.searchsorted(start, entry)), stretch * _NUMBERS
    while at <= own[-1]:
        yield _row(conv, number, system, start[at] == fixed, [r[2] for r in turns[first[at] : at]], [r[2] for r in turns[at : stop[at]]])
        at, number = int(stop[at]), number + 1


def _entries(rows: DataFrame, long: int, budget: int, history: int) -> DataFrame:
    """(conv_id, stretch, start) of the turn where each stretch is entered, from (conv_id, stretch, kind, start, tokens)."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(n, "conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "kind", "start")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        for (conv, stretch), group in groupby(each, key=lambda r: r[:2]):
            out += [(conv, stretch, *e) for e in _exits([r[2:] for r in group], stretch, long, budget, history)]
            if len(out) > 1 << 14:
                yield _longs(out, _EXIT)
                out = []
        yield _longs(out, _EXIT)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = (), 0
        for batch in batches:
            out = []
            for conv, stretch, first, entry, exit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    now, at = (conv,), first
                if entry == at:
                    out.append((conv, stretch, entry))
                    at = exit
            yield _longs(out, _ENTERED)

    exits = rows.select("conv_id", "stretch", "kind", "start", "tokens").mapInArrow(leave, _EXIT)
    return exits.repartition(n, "conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(follow, _ENTERED)


_EXIT, _ENTERED = "conv_id long, stretch long, first long, start long, leave long", "conv_id long, stretch long, start long"


def _longs(rows: list[tuple], shape: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in shape.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


def windows(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, many: int = MANY) -> DataFrame:
    """(conv_id, window, text, spans, n_tokens), windows of a conversation in order.

    ``spans`` lists the turns of a window: turn, role, start and stop (code points of ``text``, marks included), repeated
    (system turn or history that an earlier window has), and loss_start and loss_stop: the text to be learned, of
    assistant turns that are not repeated, else null. A window has at most ``budget`` tokens unless the system turn and
    one other are too long for it together; then it has no others. A conversation that fits the budget is one window.
    Turns that share a number are ordered by role, then a hash of their texts; null turns come first; a null conv_id is
    a conversation. A first turn of role ``system`` is the system turn. An empty table gives no windows. Stretches are
    ``many`` budgets; windows are the same for any. ``history`` is at most ``budget``.
    """

    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        return text.map(lambda x: len(byte_bpe_ids(x, tokenizer))).astype("int64")

    turns = durable(rendered(conversations).withColumn("tokens", tokens("turn_text")), "turns")
    placed = in_order(turns)
    long = budget * many
    placed = placed.withColumn("stretch", F.floor(F.col("start") / long)).withColumn("head", (F.col("start") == 0) & (F.col("role") == "system"))
    placed = durable(placed, "placed")
    named = ["turn", "role", "opening", "body", "turn_text", "tokens", "learned"]
    turn = placed.where("NOT head")
    within = F.col("start") - F.col("stretch") * long
    own = turn.select("conv_id", "stretch", F.lit(_OWN).alias("kind"), "start", *named)
    # the turns just before a stretch, which its first window may repeat, and those behind it, which its last may take
    near = turn.where(within >= long - history).select("conv_id", (F.col("stretch") + 1).alias("stretch"), F.lit(_NEAR).alias("kind"), "start", *named)
    behind = turn.where((F.col("stretch") > 0) & (within < budget)).select("conv_id", (F.col("stretch") - 1).alias("stretch"), F.lit(_BEHIND).alias("kind"), "start", *named)
    heads = placed.where("head").select(F.col("conv_id").alias("c"), F.col("start"), *named)
    there = turn.select("conv_id", "stretch").distinct()
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    system = there.join(heads, same).select("conv_id", "stretch", F.lit(_SYSTEM).alias("kind"), "start", *named)
    alone = heads.join(there, same, "left_anti").select(F.col("c").alias("conv_id"), F.lit(0).cast("long").alias("stretch"), F.lit(_SYSTEM).alias("kind"), "start", *named)
    n = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = own.unionByName(near).unionByName(behind).unionByName(system)
    # stretch 0 is entered at its first turn: only conversations that go beyond it are looked at
    beyond = turn.where("stretch > 0").select(F.col("conv_id").alias("c")).distinct()
    counted = rows.select("conv_id", "stretch", "kind", "start", "tokens").join(beyond, same, "left_semi")
    entered = _entries(counted, long, budget, history).withColumn("kind", F.lit(_ENTRY))
    rows = rows.unionByName(alone).unionByName(entered, allowMissingColumns=True)
    rows = rows.repartition(n, "conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "kind", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out, size = [], 0
        for (conv, stretch), group in groupby(each(), key=lambda r: r[:2]):
            for row in _chosen(conv, stretch, [(r[2], r[3], _Turn(*r[4:])) for r in group], budget, history):
                out.append(row)
                size += len(row[2])
                if size > 1 << 22:
                    yield _windows_of(out)
                    out, size = [], 0
        yield _windows_of(out)

    return rows.mapInArrow(run, _WINDOW)


def _windows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN_KIND), pa.int64())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "window", "text", "spans", "n_tokens"])


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(made: DataFrame) -> DataFrame:
    """What the windows' texts say of each conversation: its turns once each, and all text under the loss mask.

    Conversations stream through sorted partitions; a digest and three sums are kept of the current one.
    """
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = made.select("conv_id", "window", "text", F.to_json("spans").alias("spans")).repartition(n, "conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import json

        now, state, out = (), None, []
        for batch in batches:
            for conv, _, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(_closed(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(text)
                for s in json.loads(spans):
                    coded, role, body = _TURN.fullmatch(text[s["start"] : s["stop"]]).groups()
                    role = base64.b64decode(role).decode() if coded else role
                    if not s["repeated"]:
                        state[0] += 1
                        state[1].update(f"{role}\n{unescape(body)}\n".encode())
                    if "loss_start" in s:
                        learned = unescape(text[s["loss_start"] : s["loss_stop"]])
                        state[2] += len(learned)
                        state[3].update(learned.encode())
            yield _read_rows(out)
            out = []
        if state is not None:
            yield _read_rows([_closed(now, state)])

    return ordered.mapInArrow(run, _READ)


def _closed(conv, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in _READ.split(", ")])


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(durable(windows(rows, public_tokenizers.path("byte_bpe_50k.json")), "windows"))
