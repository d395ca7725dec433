"""The streaming selection against the batch one, on logs that come late, shuffled, again and in two runs of the query."""

import random

import numpy as np
import pandas as pd
import pytest

from corpusloom.streaming import run_log as X

SHAPE = "run_id string, epoch long, metric double"


def plain(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("rule", ["relative", "absolute"])
def test_redelivered_and_late(spark, rule, tmp_path):
    rng = random.Random(6)
    log = [(f"r{r}", e, rng.choice([None, 4.0 * rng.random(), 1 + e / 10])) for r in range(6) for e in range(1, 30)]
    log += [("given", 1, 2.0), ("given", 2, 1.0), ("given", 3, 1.5)] + [("gap", e, 1.0 / e) for e in (1, 2, 5, 9)]
    want = plain(X.checkpoint_selection(spark.createDataFrame(log, SHAPE), X.RULES[rule]))
    arriving = log + rng.sample(log, 60)
    rng.shuffle(arriving)
    arriving += [("given", e, v) for e, v in ((2, 1.0), (2, 1.0), (2, 1.0), (3, 1.5))] + [("given", None, 0.0), ("given", 0, 0.0)]
    folder = f"{tmp_path}/log"
    for part in range(4):
        spark.createDataFrame(arriving[part * 70 : (part + 1) * 70 if part < 3 else None], SHAPE).coalesce(1).write.mode("append").parquet(folder)
        if part % 2:  # the query is ended and goes on from its checkpoint
            stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(folder)
            got = X.run_to_end(X.streaming_selection(stream, X.RULES[rule]), f"{tmp_path}/state")
    assert plain(got) == want
    so_far = spark.createDataFrame([x for x in log if x[0] == "given"], SHAPE)
    assert [r for r in want if r[0] == "given"] == plain(X.checkpoint_selection(so_far, X.RULES[rule]))


def test_undefined_values(spark):
    log = spark.createDataFrame([("a", 1, float("nan")), ("a", 2, 3.0), ("a", 3, None)], SHAPE)
    assert plain(X.checkpoint_selection(log, X.RULES["plain"])) == [("a", 2, 3.0, None)]


def metrics(rng, n):
    kind = rng.randrange(4)
    one = {0: lambda t: rng.choice([1.0, 2.0, 3.0, 0.5, -1.0, -1.005, 0.0]), 1: lambda t: 10.0 - t * 0.05, 2: lambda t: rng.gauss(5, 1), 3: lambda t: 3 + 5 / (t + 1) + rng.random() * 0.1}[kind]
    return [float("nan") if rng.random() < 0.15 else one(t) for t in range(n)]


@pytest.mark.parametrize("rule", [*X.RULES.values(), X.Rule(factor=0.9, margin=0.1, patience=2, start=4)])
def test_stretches(rule):
    """Any cut into stretches, joined in any order of joining, does what the replay does, from any state."""
    rng = random.Random(8)
    for _ in range(300):
        n = rng.choice([0, 1, 2, 5, 30, 90])
        v, e = metrics(rng, n), np.cumsum([rng.choice([1, 1, 2]) for _ in range(n)]) + rule.start
        cuts = sorted(rng.randrange(n + 1) for _ in range(3))
        parts = [X.Stretch.of(rule, e[a:b].astype(np.int64), np.array(v[a:b])) for a, b in zip([0, *cuts], [*cuts, n])]
        begun = rng.choice([(None, None, 0, None), (2.0, 1, 0, None), (-1.0, 1, min(1, max(0, rule.patience - 1)), None), (None, None, 0, 3)])
        replay = X.Replay(rule, *begun)
        for x, y in zip(e.tolist(), v):
            replay.step(x, y)
        want = (replay.best, replay.best_epoch, replay.stop)
        left = parts[0].then(parts[1]).then(parts[2]).then(parts[3])
        right = parts[0].then(parts[1].then(parts[2].then(parts[3])))
        state = begun
        for p in parts:
            state = p.leave(state)
        for got in (left.leave(begun), right.leave(begun), state):
            assert (got[0], got[1], got[3]) == want and (got[3] is not None or got[2] == replay.misses)


@pytest.mark.parametrize("rule", ["relative", "plain"])
def test_one_long_run(spark, rule, monkeypatch):
    monkeypatch.setattr(X, "STRETCH", 700)
    rng = random.Random(2)
    log = [("long", t, 5 + 200 / t + rng.random()) for t in range(1, 20_001)] + [("short", 1, 1.0), (None, 2, 1.0), (None, 1, 2.0)]
    replay = X.Replay(X.RULES[rule])
    for _, t, v in log[:20_000]:
        replay.step(t, v)
    for parts in ("1", "16"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r[0]: tuple(r[1:]) for r in X.checkpoint_selection(spark.createDataFrame(log, SHAPE), X.RULES[rule]).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == {"long": (replay.best_epoch, replay.best, replay.stop), "short": (1, 1.0, None), None: (2, 1.0, None)}


def test_early_epochs_are_kept_by_stretches():
    """Epochs that wait for their turn are a few rows of state, not one each, and what comes of them is that of one pass."""
    class Kept:
        def __init__(self):
            self.rows, self.calls = {}, 0

        def exists(self):
            return bool(self.rows)

        def get(self):
            return self.rows[()]

        def update(self, row):
            self.rows[()] = row

        def iterator(self):
            return iter(list(self.rows.items()))

        def updateValue(self, key, value):  # noqa: N802
            self.rows[key], self.calls = value, self.calls + 1

        def removeKey(self, key):  # noqa: N802
            del self.rows[key]
            self.calls += 1

    rule = X.Rule(factor=0.99, patience=500)
    values = [float(v) for v in np.random.default_rng(4).random(9000)]
    values[17] = float("nan")
    one = X._Selection(rule, "run_id", "epoch", "metric", 1)
    one.settled, one.ahead = Kept(), Kept()
    epochs = list(range(1, 9001))
    odd, even = epochs[1::2], epochs[0::2]
    for come in ([*odd, *odd[:50], None, -3], [], even[:10], even):
        frame = pd.DataFrame({"epoch": come, "metric": [values[e - 1] if e and e > 0 else 0.5 for e in come]}).astype({"epoch": "float64"})
        (out,) = one.handleInputRows(("a",), iter([frame]), None)
    replay = X.Replay(rule)
    for e, v in zip(epochs, values):
        replay.step(e, v)
    assert tuple(out.iloc[0]) == ("a", replay.best_epoch, replay.best, replay.stop, 9000)
    assert one.ahead.calls <= 12 and not one.ahead.rows
