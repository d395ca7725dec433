"""Replay of best value and patience over run logs, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Rule:
    """New best if value < best * factor - margin, from ``start`` on; stop after ``patience`` misses (0: never)."""

    factor: float = 1.0
    margin: float = 0.0
    patience: int = 0
    start: int = 1


#: Fixed values of the four rules.
RULES = {"relative": Rule(factor=0.99, patience=20), "strict": Rule(patience=30), "absolute": Rule(margin=0.01, patience=3), "plain": Rule()}


class Replay:
    """The state of one run under a rule, of fixed size."""

    def __init__(self, rule: Rule, best: float | None = None, best_epoch: int | None = None, misses: int = 0, stop: int | None = None):
        self.rule, self.best, self.best_epoch, self.misses, self.stop = rule, best, best_epoch, misses, stop

    def step(self, epoch: int, value: float | None) -> None:
        """A missing or undefined value is a miss."""
        rule = self.rule
        if self.stop is not None or epoch < rule.start:
            return
        if value is not None and value == value and (self.best is None or value + rule.margin < self.best * rule.factor):
            self.best, self.best_epoch, self.misses = float(value), epoch, 0
        else:
            self.misses += 1
            self.stop = epoch if rule.patience and self.misses >= rule.patience else None


#: Epochs that one stretch sums up, or one row of a stream's state holds, at most.
STRETCH = 4096

State = tuple  # best, best_epoch, misses, stop: as in Replay


class Stretch:
    """What consecutive live epochs of a run do to any state before them.

    The state matters through the first epoch that betters its best, which is one of the stretch's records (values below
    all before them); what follows from there is the record's own outcome. ``values`` and ``at`` are the records' values
    with the margin and how many epochs come before them, ``labels`` the first epochs, as many as the patience.
    """

    def __init__(self, rule: Rule, n: int, labels: list[int], values: np.ndarray, at: list[int], out: list[State]):
        self.rule, self.n, self.labels, self.values, self.at, self.out = rule, n, labels, values, at, out

    @classmethod
    def of(cls, rule: Rule, epochs: np.ndarray, metric: np.ndarray) -> Stretch:
        """Of sorted epochs not before the rule's start; an undefined metric is a miss."""
        n, shifted = len(epochs), metric + rule.margin
        known = np.flatnonzero(~np.isnan(metric))
        low = np.minimum.accumulate(shifted[known])
        records = known[np.concatenate([[True], shifted[known][1:] < low[:-1]])] if len(known) else known
        after: dict[int, State] = {}
        for record in records[::-1].tolist():
            chain = [record]
            while chain[-1] not in after:
                t = chain[-1]
                better = shifted[t + 1 :] < metric[t] * rule.factor
                gap = int(better.argmax()) if better.any() else n - 1 - t
                if rule.patience and gap >= rule.patience:
                    after[t] = (float(metric[t]), int(epochs[t]), rule.patience, int(epochs[t + rule.patience]))
                elif not better.any():
                    after[t] = (float(metric[t]), int(epochs[t]), gap, None)
                else:
                    chain.append(t + 1 + gap)
            for t in chain:
                after[t] = after[chain[-1]]
        return cls(rule, n, epochs[: rule.patience].tolist(), shifted[records], records.tolist(), [after[t] for t in records.tolist()])

    def leave(self, state: State) -> State:
        best, best_epoch, misses, stop = state
        if stop is not None:
            return state
        i = 0 if best is None else int(np.searchsorted(-self.values, -best * self.rule.factor, "right"))
        hit = i < len(self.at)
        missed = misses + (self.at[i] if hit else self.n)
        if self.rule.patience and missed >= self.rule.patience:
            return best, best_epoch, self.rule.patience, self.labels[self.rule.patience - misses - 1]
        return self.out[i] if hit else (best, best_epoch, missed, None)

    def then(self, other: Stretch) -> Stretch:
        """This stretch and the next as one; associative."""
        new = other.values < self.values[-1] if len(self.values) else np.ones(len(other.values), bool)
        some = np.flatnonzero(new).tolist()
        return Stretch(
            self.rule, self.n + other.n, (self.labels + other.labels)[: self.rule.patience], np.concatenate([self.values, other.values[new]]),
            self.at + [self.n + other.at[i] for i in some], [other.leave(s) for s in self.out] + [other.out[i] for i in some],
        )


_OUTCOME = ("best", "best_epoch", "misses", "stop")


def checkpoint_selection(log: DataFrame, rule: Rule, run: str = "run_id", epoch: str = "epoch", value: str = "metric") -> DataFrame:
    """(run, best_epoch, best, stop_epoch): the rule replayed over each run's epochs in order; stop_epoch is null if it never stops.

    A run may be spread over any number of tasks: each sums its epochs up as a function of the state before them, and
    the functions are applied in order. Rows without an epoch take no part; missing and undefined values are misses.
    """
    kind = log.schema[run].dataType
    rows = log.select(F.col(run).alias("run"), F.col(epoch).cast("long").alias("e"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v")).where("e IS NOT NULL")
    dealt = rows.repartitionByRange("run", "e", "v").sortWithinPartitions("run", "e", "v").withColumn("part", F.spark_partition_id().cast("long"))
    fields = "part long, n long, labels array<long>, values array<double>, at array<long>, best array<double>, best_epoch array<long>, misses array<long>, stop array<long>"
    shape = T.StructType([T.StructField("run", kind), *T.StructType.fromDDL(fields).fields])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, (e, v), part = batch.column("run"), (batch.column(c).to_numpy() for c in ("e", "v")), batch.column("part")[0].as_py()
            coded = keys.dictionary_encode("encode").indices.to_numpy()
            edges = [0, *(np.flatnonzero(coded[1:] != coded[:-1]) + 1).tolist(), len(coded)]
            done = []
            for a, b in zip(edges, edges[1:]):
                key, live = keys[a].as_py(), a + int(np.searchsorted(e[a:b], rule.start))
                if now is not None and now[0] != key:
                    done.append(now)
                    now = None
                now = now or (key, part, Stretch.of(rule, e[:0], v[:0]))
                for at in range(live, b, STRETCH):
                    to = min(b, at + STRETCH)
                    now = (key, part, now[2].then(Stretch.of(rule, e[at:to], v[at:to])))
            yield closed(done, keys.type)
        if now is not None:
            yield closed([now], keys.type)

    def closed(done: list[tuple], kind_: pa.DataType) -> pa.RecordBatch:
        kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64())
        outcomes = [pa.array([[s[k] for s in x.out] for _, _, x in done], pa.list_(t)) for k, t in enumerate(kinds)]
        lists = [pa.array([list(getattr(x, n)) for _, _, x in done], pa.list_(t)) for n, t in (("labels", pa.int64()), ("values", pa.float64()), ("at", pa.int64()))]
        columns = [pa.array([k for k, _, _ in done], kind_), pa.array([p for _, p, _ in done], pa.int64()), pa.array([x.n for _, _, x in done], pa.int64()), *lists, *outcomes]
        return pa.record_batch(columns, ["run", "part", "n", "labels", "values", "at", *_OUTCOME])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind_ = None, None, None
        for batch in batches:
            kind_, done = batch.schema.field("run").type, []
            for r in batch.to_pylist():
                if state is None or r["run"] != now:
                    if state is not None:
                        done.append((now, state))
                    now, state = r["run"], (None, None, 0, None)
                out = list(zip(*(r[n] for n in _OUTCOME), strict=True))
                state = Stretch(rule, r["n"], r["labels"], np.array(r["values"], float), r["at"], out).leave(state)
            yield ended(done, kind_)
        if state is not None:
            yield ended([(now, state)], kind_)

    def ended(done: list[tuple], kind_: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([k for k, _ in done], kind_), *(pa.array([s[k] for _, s in done], t) for k, t in ((1, pa.int64()), (0, pa.float64()), (3, pa.int64())))]
        return pa.record_batch(columns, [run, "best_epoch", "best", "stop_epoch"])

    functions = dealt.mapInArrow(summed, shape).repartition("run").sortWithinPartitions("run", "part")
    return functions.mapInArrow(applied, T.StructType([T.StructField(run, kind), T.StructField("best_epoch", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("stop_epoch", T.LongType())]))


def epoch_losses(batches: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "loss", n: str = "n") -> DataFrame:
    """(run, epoch, weighted_loss, mean_loss): by samples, and by batches."""
    return batches.groupBy(run, epoch).agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("weighted_loss"), F.avg(loss).alias("mean_loss"))


def extreme_steps(log: DataFrame, run: str = "run_id", epoch: str = "epoch", value: str = "metric") -> DataFrame:
    """(run, best_step, worst_step): epochs of the least and the largest value, the earlier on ties; null values are neither."""
    known = F.col(value).isNotNull()
    best = F.min(F.when(known, F.struct(F.col(value).alias("v"), F.col(epoch).alias("e"))))["e"]
    worst = F.max(F.when(known, F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e"))))["e"]
    return log.groupBy(run).agg(best.alias("best_step"), (-worst).alias("worst_step"))


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Selection(StatefulProcessor):
    """Per run: the replay up to the first epoch that has not come yet, and the values of epochs that came before their turn, by stretches of STRETCH."""

    def __init__(self, rule: Rule, run: str, epoch: str, value: str, first: int):
        self.rule, self.run, self.epoch, self.value, self.first = rule, run, epoch, value, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", "best double, best_epoch long, misses long, stop_epoch long, next long")
        self.ahead = handle.getMapState("ahead", "stretch long", "epochs array<long>, values array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *before, turn = self.settled.get() if self.settled.exists() else (None, None, 0, None, self.first)
        replay = Replay(self.rule, *before)
        kept = [(np.array(e, np.int64), np.array(v, float)) for _, (e, v) in self.ahead.iterator()]
        n_kept, come = sum(len(e) for e, _ in kept), kept
        for frame in rows:
            some = frame[[self.epoch, self.value]][frame[self.epoch].notna() & (frame[self.epoch] >= turn)]  # an epoch that was replayed comes again: no news
            come.append((some[self.epoch].to_numpy(np.int64), some[self.value].to_numpy(float)))
        epochs, values = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0)), *come))
        epochs, at = np.unique(epochs, return_index=True)  # of one epoch the row that comes first
        values, fresh = values[at], at >= n_kept
        ready = int((epochs == turn + np.arange(len(epochs))).sum())
        for e, v in zip(epochs[:ready].tolist(), values[:ready].tolist()):
            replay.step(e, v)
        turn += ready
        other = np.unique(np.concatenate([epochs[:ready][~fresh[:ready]], epochs[ready:][fresh[ready:]]]) // STRETCH)
        epochs, values = epochs[ready:], values[ready:]
        for c in other.tolist():  # the stretches that change, each a row of the state
            low, high = np.searchsorted(epochs, (c * STRETCH, (c + 1) * STRETCH))
            if low < high:
                self.ahead.updateValue((c,), (epochs[low:high].tolist(), values[low:high].tolist()))
            else:
                self.ahead.removeKey((c,))
        self.settled.update((replay.best, replay.best_epoch, replay.misses, replay.stop, turn))
        shown = Replay(self.rule, replay.best, replay.best_epoch, replay.misses, replay.stop)
        for e, v in zip(epochs.tolist(), values.tolist()):
            shown.step(e, v)
        out = pd.DataFrame({self.run: [key[0]], "best_epoch": [shown.best_epoch], "best": [shown.best], "stop_epoch": [shown.stop], "epochs": [turn - self.first + len(epochs)]})
        yield out.astype({"best_epoch": "Int64", "best": "float64", "stop_epoch": "Int64"})


def streaming_selection(stream: DataFrame, rule: Rule, run: str = "run_id", epoch: str = "epoch", value: str = "metric", first: int = 1) -> DataFrame:
    """``checkpoint_selection`` of what has arrived of a log: (run, best_epoch, best, stop_epoch, epochs) of the runs of each batch.

    Epochs may come late, in any order and again: of one epoch the row that comes first counts. They are replayed for
    good in their turn from ``first`` on; those beyond a gap are kept until it is filled, and are replayed in order for
    what is shown. Rows without an epoch, and of epochs before ``first``, take no part. The stream runs on the RocksDB
    state store (``run_to_end`` sees to it).
    """
    kind = dict(stream.dtypes)[run]
    rows = stream.select(run, F.col(epoch).cast("long").alias(epoch), F.col(value).cast("double").alias(value))
    return rows.groupBy(run).transformWithStateInPandas(_Selection(rule, run, epoch, value, first), f"{run} {kind}, best_epoch long, best double, stop_epoch long, epochs long", "update", "none")


def run_to_end(updates: DataFrame, folder: str, run: str = "run_id") -> DataFrame:
    """Run a streaming selection over all that is there, going on from the checkpoint in ``folder``; each run's last row."""
    out, conf = f"{folder}/out", updates.sparkSession.conf

    def keep(rows: DataFrame, batch: int) -> None:  # a batch that is run again writes the same rows again
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        query = updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)
    query.awaitTermination()
    rows = updates.sparkSession.read.schema(updates.schema.add("batch", "long")).parquet(out)
    last = rows.groupBy(run).agg(F.max_by(F.struct("best_epoch", "best", "stop_epoch"), "batch").alias("s"))
    return last.select(run, "s.best_epoch", "s.best", "s.stop_epoch")
