"""Work that must not grow faster than the input, and what replaced it against brute force."""

import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.functions import score_text as S
from corpusloom.llm import additive_ann, queries
from corpusloom.operators import pairs, tokens
from corpusloom.operators.generation import drawn_places
from corpusloom.operators.pairs import edit_distance
from corpusloom.operators.tokens import token_histogram
from corpusloom.plans import catalog, fixtures

SF = "/root/testdata/sf0.001"


def test_texts_of_documents_without_copies_stay(spark):
    """One of each: only texts that may have a copy are shuffled, to one join."""
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(60)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:20])] + [(5, "some other text of its own"), (None, texts[30])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        got = sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [g[1] for g in got if g[1] != 5] == [i for i in range(150) if i != 5] and sum(g[1] == 5 for g in got) == 1
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") <= 2 and "BroadcastHashJoin" in plan


def test_digest_op9_ranks_is_exact(spark, tmp_path, monkeypatch):
    """Where the index of op9 may miss one of 20, the digest that SQL is held against does not: here with coarse books and a short reach."""
    monkeypatch.setattr(additive_ann, "SAMPLE", 64)
    monkeypatch.setattr(additive_ann.nearest, "__defaults__", (additive_ann.NEAREST, "embedding", 0.2))
    n = 2000
    x = np.random.default_rng(8).standard_normal((n, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in queries.digest_op9_ranks(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, n, 20):
        score = x @ x[q]
        score[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(n), -score))[:20].tolist()


def test_expressions_inside_lambdas_are_computed_once(spark):
    """What a lambda needs of the whole text or list is bound before it: it must not be computed anew for each line or token."""
    lines = spark.createDataFrame([("=1 *clefG2 <b> a * <b> *M4 b <b> x <b> <b> y",)], "text string")
    tokens = F.split(F.upper("text"), " ")
    words = "a b c d e f g".split()
    for made in (S.filter_continuation(tokens, True), S.dedupe_line_breaks(tokens)):
        assert lines.select(made)._jdf.queryExecution().analyzed().toString().count("upper(") <= 2  # the expression and its name
    sides = spark.createDataFrame([(words, words[::-1])], "p array<string>, t array<string>")
    plan = sides.select(edit_distance(F.col("p"), F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_distinct") <= 2


def test_a_draw_is_computed_once(spark):
    rows = spark.range(3).select("id", F.lit(9).alias("size"), F.lit(4).alias("n"))
    made = rows.select(drawn_places("draw", F.col("id"), F.col("size"), F.col("n")).alias("places"))
    assert made._jdf.queryExecution().analyzed().toString().count("md5(") == 1
    assert all(len(set(r.places)) == 4 and set(r.places) <= set(range(9)) for r in made.collect())


def test_token_histogram_counts_rows_where_they_are(spark, monkeypatch):
    """Only counts of keys that come in several rows are shuffled; those of others, nulls too, stay where the row is."""
    rows = [(1, ["a", "b", "a", None, None]), (2, None), (3, []), (None, ["a"]), (4, ["b", ""])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    alone = token_histogram(df)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    want = {(1, "a", 2), (1, "b", 1), (1, None, 2), (None, "a", 1), (4, "b", 1), (4, "", 1)}
    assert {tuple(r) for r in alone.collect()} == want and alone.count() == len(want)
    again = df.union(spark.createDataFrame([(1, ["a", "c", None]), (None, ["a", "b"])], df.schema))
    want = want - {(1, "a", 2), (1, None, 2), (None, "a", 1)} | {(1, "a", 3), (1, None, 3), (1, "c", 1), (None, "a", 2), (None, "b", 1)}
    for sent in (1_000_000, 0):
        monkeypatch.setattr(tokens, "SENT_KEYS", sent)
        got = token_histogram(again).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert token_histogram(df.where("false")).count() == 0


def test_all_pairs_blocks_and_order(spark):
    """Blocks, and with them the times that a row is sent, don't follow the number of rows; every pair comes once, none without a key, repeated keys as in SQL."""
    assert pairs.pair_blocks(30) == pairs.LEAST_BLOCKS and pairs.pair_blocks(20_000) == 20
    assert {pairs.pair_blocks(n) for n in (30_000, 500_000, 786_432)} == {24} and pairs.pair_blocks(1_000_000) == 31
    rows = [(k, None if k == 7 else k * k) for k in (*range(40, 0, -1), 12, 12)] + [(None, 1), (None, 2)]
    want = sorted((a, b, x or -1, y or -1) for a, x in rows for b, y in rows if a is not None and b is not None and a < b)
    df = spark.createDataFrame(rows, "k long, v long")
    for n in (None, 1, 5, 60):
        got = pairs.all_pairs(df, "k", ["v"], n)
        assert got.columns == ["i", "j", "v_i", "v_j"]
        assert sorted((r.i, r.j, r.v_i or -1, r.v_j or -1) for r in got.collect()) == want
    assert pairs.all_pairs(df.where("false"), "k", ["v"]).count() == 0
    names = spark.createDataFrame([("b", 1), ("a", 2), ("C", 3)], "k string, v long")
    assert sorted(map(tuple, pairs.all_pairs(names, "k", []).collect())) == [("C", "a"), ("C", "b"), ("a", "b")]


def test_all_pairs_pack_well(spark, tmp_path):
    """Pairs come in runs that repeat as bytes: a fraction of a byte a pair on disk, with a column that depends on both rows too."""
    rows = spark.range(4000).select((F.col("id") * 37 + 5).alias("k"), (F.xxhash64("id") % 60 + 60).alias("v"))
    made = pairs.all_pairs(rows, "k", ["v"]).select("i", "j", F.greatest("v_i", "v_j").alias("v"))
    made.write.parquet(f"{tmp_path}/pairs")
    written = spark.read.parquet(f"{tmp_path}/pairs")
    assert written.count() == written.distinct().count() == 4000 * 3999 // 2
    assert sum(x.stat().st_size for x in (tmp_path / "pairs").rglob("*.parquet")) < 0.45 * 4000 * 3999 / 2


def test_ground_truth_profile_asks_for_neighbours_only(spark, monkeypatch):
    """w02 needs the 25 nearest: no two blocks meet for all their pairs, and the sums are those of brute force."""
    monkeypatch.setattr(catalog.P, "l1_extremes", None)
    turns = [Counter(r.tokens) for r in fixtures.turns(spark, SF).orderBy("id").collect()]
    want = [sum(sorted((a - b).total() + (b - a).total() for y, b in enumerate(turns) if y != x)[:25]) for x, a in enumerate(turns)]
    got = catalog.QUERIES["w02_ground_truth_profile"](spark, SF).where(f"k = {min(25, len(turns) - 1)}").orderBy("i").collect()
    assert len(turns) > 2 and [r.sum_value for r in got] == want
