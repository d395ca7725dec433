"""Operators on nulls, empty tables, ties, repeated rows and clashing names."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import learning as L
from corpusloom.operators import metrics as M
from corpusloom.operators import pairs as P
from corpusloom.operators import tokens as K
from corpusloom.operators import vectors as V
from corpusloom.sources import store
from corpusloom.streaming import run_log as X


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def frame(spark, data, shape):
    return spark.createDataFrame(data, shape)


def test_error_rates(spark):
    df = frame(spark, [(["a", None], ["b", "c"]), (None, ["x"]), (["q"], None), (["a", None], ["a", None])], "p array<string>, t array<string>")
    assert M.corpus_error_rate(df, "p", "t").first()[0] == pytest.approx(100 * (2 + 1 + 1 + 0) / 5)
    assert M.corpus_error_rate(df.where("t IS NULL"), "p", "t").first()[0] is None
    assert M.corpus_error_rate(df.where("false"), "p", "t").first()[0] is None
    texts = frame(spark, [(None, "a b\nc"), ("a b\nc", "a b\nc"), ("x", None)], "p string, t string")
    got = {r.view: r.error_rate for r in M.cer_ser_ler(texts, "p", "t").collect()}
    assert got["ler"] == pytest.approx(100 * (2 + 0 + 1) / 4) and got["ser"] == pytest.approx(100 * (4 + 0 + 1) / 8)
    assert M.cer_ser_ler(texts.where("false"), "p", "t").count() == 0


def test_alignment(spark):
    a = frame(spark, [(1, "x", 5), (1, "x", 5), (2, None, 6)], "id int, label string, prediction int")
    b = frame(spark, [(1, "y", 7), (3, "z", 8)], "id int, label string, target int")
    both = M.align_predictions(a, b)
    assert both.columns == ["id", "label", "prediction", "label_target", "target"] and rows(both) == [(1, "x", 5, "y", 7)] * 2


def test_token_distances(spark):
    df = frame(spark, [(1, ["a", None, "b"]), (2, []), (3, None), (4, ["a", None])], "id long, tokens array<string>")
    want = {(1, 2): 3, (1, 3): 3, (1, 4): 1, (2, 3): 0, (2, 4): 2, (3, 4): 2}
    for got in (P.token_edit_distance(df), P.token_edit_distance(df, most=0), P.histogram_l1(df)):
        assert {(r.i, r.j): r.d for r in got.collect()} == want
    assert {(r.i, r.j): (r.len_i, r.len_j) for r in P.token_edit_distance(df).collect()}[1, 3] == (3, 0)
    assert {(r.i, r.j): r.overlap for r in P.token_overlap(K.token_histogram(df)).collect()} == {(1, 4): 2}
    assert P.token_edit_distance(df.where("false")).count() == 0 and P.histogram_l1(df.where("false")).count() == 0


def test_encoding(spark):
    df = frame(spark, [(1, ["b", None, "a", "b"], "t"), (2, [], "t"), (3, None, "t")], "id long, tokens array<string>, token string")
    v = K.build_vocabulary(df)
    assert {r.id: r.ids for r in K.encode_tokens(df, v).collect()} == {1: [3, 1, 2, 3], 2: [], 3: []}
    with pytest.raises(Exception, match="unknown token null"):
        K.encode_tokens(df, v.where("token IS NOT NULL")).collect()
    with pytest.raises(Exception, match="unknown token a"):
        K.encode_tokens(df, v.where("token <> 'a' OR token IS NULL")).collect()
    assert K.build_vocabulary(df.where("false")).count() == 0


def test_batches(spark):
    df = frame(spark, [(1, ["a"], "x"), (2, None, "x"), (3, ["a", "b", None], "x")], "id long, tokens array<string>, _n string")
    got = {r.id: r for r in K.padded_batches(df, 3, "tokens", "id").collect()}
    assert [got[k].padded for k in (1, 2, 3)] == [["a", "<pad>", "<pad>"], ["<pad>"] * 3, ["a", "b", None]] and [got[k].true_len for k in (1, 2, 3)] == [1, 0, 3] and got[1]._n == "x"
    vectors = frame(spark, [(1, [[1.0, 2.0]]), (2, []), (3, None)], "id long, v array<array<double>>")
    assert {r.id: r.padded for r in K.padded_batches(vectors, 3, "v", "id").collect()} == {1: [[1.0, 2.0]], 2: [[0.0, 0.0]], 3: [[0.0, 0.0]]}
    for name in ("batch", "true_len", "padded"):
        with pytest.raises(ValueError, match=name):
            K.padded_batches(df.withColumn(name, F.lit(1)), 2, "tokens", "id")
    assert K.fixed_batches(df.where("false"), 2, "id").count() == 0


def test_correlations(spark):
    df = frame(spark, [(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, 4.0, 5.0), (4.0, 3.0, 5.0), (None, 9.0, 5.0), (9.0, None, 5.0)], "x double, y double, c double")
    for ranked in (False, True):
        r = P.correlations(df, ["x", "c"], "y", ranked).collect()
        assert (r[0].r, r[0].n) == (pytest.approx(0.6), 8) and (r[1].r, r[1].p) == (None, None)
        assert [(x.r, x.n, x.p) for x in P.correlations(df.where("false"), ["x"], "y", ranked).collect()] == [(None, 0, None)]


def test_labels(spark):
    df = frame(spark, [(1, [0.0], "a"), (2, [0.1], None), (3, [0.2], "b"), (4, [5.0], "b"), (5, None, "a")], "id long, embedding array<float>, label string")
    assert rows(L.knn_classify(df, 1)) == [(1, "a", "b"), (3, "b", "a"), (4, "b", "b")]
    assert L.knn_classify(df.where("false"), 1).count() == 0


def test_vectors(spark):
    df = frame(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0])], "id long, embedding array<float>")
    assert rows(P.euclidean_distance(df)) == [(1, 2, 5.0)]
    with pytest.raises(Exception, match="unlike length"):
        P.euclidean_distance(df.union(frame(spark, [(7, [1.0])], "id long, embedding array<float>"))).collect()


def test_extreme_steps(spark):
    log = frame(spark, [("a", 1, 3.0), ("a", 2, None), ("a", 3, 1.0), ("a", 4, 1.0), ("a", 5, 3.0), ("b", 1, None), (None, 1, 2.0)], "run_id string, epoch int, metric double")
    assert rows(X.extreme_steps(log)) == [("a", 3, 1), ("b", None, None), (None, 1, 1)]


def test_pooling(spark):
    df = frame(spark, [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("a", None), ("a", [None, 1.0]), ("b", None), (None, [5.0]), ("c", [])], "score_id string, embedding array<float>")
    assert rows(V.page_mean_pool(df)) == [("a", [2.0, 4.0]), (None, [5.0])]
    assert V.page_mean_pool(df.where("false")).count() == 0
    plan = V.page_mean_pool(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    with pytest.raises(Exception, match="(?i)dimension"):
        V.page_mean_pool(frame(spark, [("a", [1.0]), ("a", [1.0, 2.0])], "score_id string, embedding array<float>").coalesce(1)).collect()


class Session:
    """What the shared folder is found from."""

    def __init__(self, master, **settings):
        self.sparkContext, self.conf, self.settings = self, self, {k.replace("_", "."): v for k, v in settings.items()}
        self.master = master

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def set(self, name, value):
        self.settings[name] = value


def test_shared_folder():
    assert store.machine_local("spark://host:7077", "file:/tmp/x") and store.machine_local("yarn", "/tmp/x")
    assert not store.machine_local("yarn", "hdfs://host/x") and not store.machine_local("local[4]", "file:/tmp/x")
    assert store.shared_folder(Session("yarn", spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    assert store.shared_folder(Session("local[2]", spark_sql_warehouse_dir="file:/w")) == "file:/w/checkpoints"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_folder(Session("yarn", spark_sql_warehouse_dir="file:/w"))
