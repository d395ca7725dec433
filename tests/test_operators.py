"""Rules and quirks on hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import score_text as S
from corpusloom.functions.uniform import uniform
from corpusloom.operators import generation as G
from corpusloom.operators import learning as L
from corpusloom.operators import metrics as M
from corpusloom.operators import pairs as P
from corpusloom.operators import tokens as K
from corpusloom.operators import vectors as V
from corpusloom.sources import tables as R
from corpusloom.streaming import run_log as X


def of(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", column(F.col("t"))).orderBy("i").collect()]


def array_of(spark, column, tokens):
    return spark.createDataFrame([(tokens,)], "t array<string>").select(column(F.col("t"))).first()[0]


def test_cleaning(spark):
    got = of(spark, S.clean_score_lines, "*\t*\n4c\t4d\n\n*ped\tx", "*pedal\tx\n*", None, "")
    assert got == ["4c\t4d\n", "*pedal\tx", None, ""]


def test_tokenizing(spark):
    text = "a\tb\nc\td\n=12\t=12\n4@c·/ 8·e\t1·d\n"
    assert of(spark, lambda t: S.tokenize_score(t, "kern"), text)[0][-5:] == ["<s>", "8e", "<t>", "1d", "<b>"]
    bekern = of(spark, lambda t: S.tokenize_score(t, "bekern"), text)[0]
    assert bekern[:6] == ["c", "<t>", "d", "<b>", "=", "<t>"] and bekern[-2:] == ["d", "<b>"]
    assert of(spark, lambda t: S.tokenize_score(t, "bekern"), "short") == [[]]


def test_views(spark):
    views = lambda name, strict=False: of(spark, lambda t: S.error_rate_views(t, strict)[name], "ab\tc\nd")[0]
    assert views("ser") == ["ab", "<t>", "c", "<b>", "d"] and views("ler") == ["ab <t> c", "d"]
    assert views("cer") == ["ab", "<", "t", ">", "c", "<", "b", ">", "d"]
    assert views("cer", True) == ["a", "b", "<t>", "c", "<b>", "d"]


def test_columns(spark):
    got = of(spark, S.split_columns_text, "x\ty\na\tb  \nc\nd\te\tf")[0]
    assert (got.second, got.first, got.joined) == (["b", "e"], ["a", "d"], "b e")
    got = of(spark, S.split_columns_levels, "a\tbc<d\nno\nx\tyz")[0]
    assert got.lines == [["a", "<t>", "b", "c", "<b>"], [], ["x", "<t>", "y", "z"]] and got.flat == ["a", "<t>", "b", "c", "x", "<t>", "y", "z"]


def test_continuation(spark):
    tokens = "*clefG2 <b> *M4/4 <b> = <b> *M3/4 <b> 4c  <b> *- <t> *- <b> x".split(" ")
    assert array_of(spark, lambda t: S.filter_continuation(t, False), tokens) == "= <b> *M3/4 <b> 4c <b> *- <t> *- <b> x".split(" ")
    assert array_of(spark, lambda t: S.filter_continuation(t, True), tokens) == "= <b> *M3/4 <b> 4c <b>".split(" ")
    assert array_of(spark, lambda t: S.filter_continuation(t, False), ["*k", "<b>", "a"]) == ["a"]
    assert array_of(spark, S.dedupe_line_breaks, ["<b>", "a", "<b>", "<b>", "b"]) == ["a", "<b>", "b"]
    assert array_of(spark, S.detokenize, ["a", "<t>", "b", "<b>", "c", "<s>", "d"]) == "a\tb\nc d"


def test_uniform_is_stable(spark):
    df = spark.range(100).repartition(7)
    a = {r.id: r.u for r in df.select("id", uniform("7", F.col("id")).alias("u")).collect()}
    b = {r.id: r.u for r in df.coalesce(1).select("id", uniform("7", F.col("id")).alias("u")).collect()}
    assert a == b and 0.4 < sum(a.values()) / 100 < 0.6


def test_vocabulary_and_encoding(spark):
    rows = spark.createDataFrame([(1, ["b", "a", ""]), (2, []), (3, ["é"])], "id long, tokens array<string>")
    voc = K.build_vocabulary(rows)
    assert [(r.token, r.token_id) for r in voc.orderBy("token_id").collect()] == [("", 1), ("a", 2), ("b", 3), ("é", 4)]
    assert {r.id: r.ids for r in K.encode_tokens(rows, voc).collect()} == {1: [3, 2, 1], 2: [], 3: [4]}
    with pytest.raises(Exception, match="unknown token"):
        K.encode_tokens(rows, voc.where("token <> 'a'")).collect()


def test_batches(spark):
    rows = spark.createDataFrame([(i, list(range(i % 3 + 1))) for i in range(10)], "id long, ids array<int>")
    got = {r.id: r.batch for r in K.fixed_batches(rows, 4, "id").collect()}
    assert got == {i: i // 4 for i in range(10)}
    padded = K.padded_batches(rows, 4, "ids", "id").orderBy("id").collect()
    assert [(r.true_len, len(r.padded)) for r in padded[8:]] == [(3, 3), (1, 3)]
    shifted = K.shift_targets(K.fixed_batches(rows, 10, "id"), "batch").orderBy("id").collect()
    assert (shifted[2].decoder_input, shifted[2].target, shifted[0].target) == ([0, 1, 0], [1, 2, 0], [0, 0, 0])


def test_distances(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c", "b"]), (3, []), (4, [])], "id long, tokens array<string>")
    edit = {(r.i, r.j): r.d for r in P.token_edit_distance(rows).collect()}
    assert edit == {(1, 2): 1, (1, 3): 2, (1, 4): 2, (2, 3): 3, (2, 4): 3, (3, 4): 0}
    l1 = {(r.i, r.j): r.d for r in P.histogram_l1(rows).collect()}
    assert l1 == {(1, 2): 1, (1, 3): 2, (1, 4): 2, (2, 3): 3, (2, 4): 3, (3, 4): 0}
    assert spark.range(1).select(P.normalize_edit(F.lit(0), F.lit(0), F.lit(0))).first()[0] == 1.0


def test_neighbours_and_ties(spark):
    v = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 1, -1, 5])], "id long, embedding array<double>")
    near = [(r.i, r.j, r.d) for r in P.knn(v, 9).where("i = 0").orderBy("rank").collect()]
    assert near == [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 5.0)]
    assert [r.j for r in P.knn(v, 1, farthest=True).orderBy("i").collect()] == [3, 3, 3, 2]
    wide = P.near_far_profile(P.knn(v, 4), P.knn(v, 4, farthest=True), P.euclidean_distance(v), 4).where("i = 0").first()
    assert (wide.near_1, wide.near_2, wide.near_4, wide.far_1) == (1.0, 1.0, None, 5.0)


def test_correlations(spark):
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in [(1, 2), (2, 2), (3, 5), (3, 4), (9, 8)]], "x double, y double")
    ranks = sorted((r.x, r.avg_rank) for r in P.average_rank(rows, "x").collect())
    assert ranks == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5), (9.0, 5.0)]
    assert P.p_value(spark, 0.6, 10) == pytest.approx(0.0667, abs=1e-4) and P.p_value(spark, None, 10) is None
    got = P.correlation_with_p(rows, "x", "y", ranked=True).first()
    assert got.n == 10 and 0 < got.p < 1


def test_scores_of_predictions(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (3, 2)], "prediction int, target int")
    m = M.ordinal_metrics(rows).first()
    assert (m.acc_0, m.acc_1, m.mse, m.mean_dist) == (50.0, 100.0, 0.5, 0.5)
    c = {(r.target, r.prediction): (r.n, r.share) for r in M.confusion_matrix(rows).collect()}
    assert len(c) == 16 and c[0, 1] == (1, 50.0) and math.isnan(c[3, 3][1])
    assert M.f_scores(rows).first().accuracy == 0.5
    none = M.corpus_error_rate(spark.createDataFrame([(1, ["a"], [])], "id long, p array<string>, t array<string>"), "p", "t")
    assert none.first()[0] is None


def test_sources(spark, tmp_path):
    for name, text in (("a", " x y "), ("b_1", "z")):
        (tmp_path / f"{name}_region.png").write_bytes(b"png")
        (tmp_path / f"{name}_gt.txt").write_text(text)
    (tmp_path / "c_region.png").write_bytes(b"png")
    pairs, missing = R.read_paired_files(spark, str(tmp_path))
    assert {r.id: r.symbols for r in pairs.collect()} == {"a": " x y ", "b_1": "z"} and [r.id for r in missing.collect()] == ["c"]
    (tmp_path / "coco.json").write_text('{"images": [{"id": 1, "file_name": "a.png"}, {"id": 2, "filename": "b.png"}],\n "annotations": [{"image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 0]}, {"image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4]}], "categories": {"7": {"name": "note"}, "9": "rest"}}')
    t = R.read_detection_json(spark, str(tmp_path / "coco.json"))
    assert sorted(map(tuple, t["categories"].collect())) == [(7, "note"), (9, "rest")] and sorted(r.file_name for r in t["images"].collect()) == ["a.png", "b.png"]
    boxes = V.boxes_xyxy(t["annotations"]).select("image_id", "box", F.col("category_id").alias("label"))
    assert {r.id: (r.boxes, r.labels) for r in V.image_targets(t["images"], boxes).collect()} == {1: ([[1.0, 2.0, 4.0, 6.0]], [7]), 2: ([], [])}
    key = of(spark, R.parse_page_key, "a_b.c_12_3", "none")
    assert tuple(key[0]) == ("a_b.c", 12, 3) and key[1] is None


def test_store(spark, tmp_path):
    done = []
    compute = lambda rows: done.append(rows.count()) or rows.withColumn("x", F.col("id") * 2)
    path = f"file://{tmp_path}/store"
    R.materialize_missing(spark.range(3), path, "id", compute)
    assert R.materialize_missing(spark.range(5), path, "id", compute).count() == 5 and done == [3, 2]
    voc = spark.createDataFrame([("a", 1)], "token string, token_id long")
    R.save_vocabulary(voc, f"file://{tmp_path}/voc")
    with pytest.raises(Exception, match="exist"):
        R.save_vocabulary(voc, f"file://{tmp_path}/voc")


def test_store_is_transactional(spark, tmp_path):
    """A call that fails half-way adds nothing; two at once add each key once; null keys and layout by columns hold."""
    from threading import Barrier, Thread

    path = f"file://{tmp_path}/store"
    ids = lambda *x: spark.createDataFrame([(i, f"0{(i or 0) % 2}") for i in x], "id long, model string")
    broken = lambda rows: rows.withColumn("x", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    whole = lambda rows: rows.withColumn("x", F.col("id") * 2)
    with pytest.raises(Exception, match="lost"):
        R.materialize_missing(ids(1, 2, 3), path, "id", broken, ["model"])
    with pytest.raises(ValueError, match="one row for each id"):
        R.materialize_missing(ids(1, 2, 2), path, "id", whole, ["model"])
    R.materialize_missing(ids(1, None), path, "id", whole, ["model"])
    at_once, done = Barrier(2), []

    def write(*keys):
        def compute(rows):
            at_once.wait(60)  # both have seen the store without the other's keys
            return whole(rows)

        done.append(R.materialize_missing(ids(*keys), path, "id", compute, ["model"]).count())

    calls = [Thread(target=write, args=k) for k in ((1, 2, 3, 4), (3, 4, 5, None))]
    for c in calls:
        c.start()
    for c in calls:
        c.join()
    got = R.materialize_missing(ids(1, 5), path, "id", broken, ["model"])
    assert len(done) == 2 and got.columns == ["id", "model", "x"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, f"0{i % 2}", i * 2) for i in range(1, 6)] + [(None, "00", None)], key=str)
    assert R.materialize_missing(ids(1).where("false"), f"file://{tmp_path}/none", "id", whole).count() == 0


def test_drawn_places_are_uniform(spark):
    """Every ordered pair of 7 places is drawn about as often as any other; none twice; all of them where all are asked."""
    from collections import Counter

    from corpusloom.operators.generation import drawn_places

    rows = spark.range(21_000).select(drawn_places("t", F.col("id"), F.lit(7), F.lit(2)).alias("p"), drawn_places("t", F.col("id"), F.lit(4), F.lit(4)).alias("q")).collect()
    pairs = Counter(tuple(r.p) for r in rows)
    assert len(pairs) == 42 and all(a != b for a, b in pairs)
    assert sum((n - 500) ** 2 / 500 for n in pairs.values()) < 80  # 41 degrees of freedom: 0.9997
    orders = Counter(tuple(r.q) for r in rows)
    assert len(orders) == 24 and all(sorted(o) == [0, 1, 2, 3] for o in orders)
    assert sum((n - 875) ** 2 / 875 for n in orders.values()) < 55


def test_checks(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [float("nan"), 0.0]), (4, [0.0, 0.0])], "id long, embedding array<double>")
    p, t = spark.createDataFrame([(1, 81)], "id long, n_pages long"), spark.createDataFrame([(5, 4097), (6, 1)], "id long, n_tokens long")
    assert sorted(map(tuple, V.quality_checks(v, p, t).collect())) == [("not finite", 3), ("ragged vector", 2), ("token count", 6), ("too many pages", 1)]
    assert ("empty input", None) in set(map(tuple, V.quality_checks(v.where("false"), p, t).collect()))


def test_selection_rules(spark):
    logs = {1: [1.0, 0.99, 0.98, 2.0], 2: [5.0] * 40, 3: [3.0, 2.995, 2.5, 2.6, 2.6, 2.6, 1.0]}
    rows = spark.createDataFrame([(k, i + 1, v) for k, vs in logs.items() for i, v in enumerate(vs)], "run_id long, epoch long, metric double")
    got = lambda rule: {r.run_id: (r.best_epoch, r.best, r.stop_epoch) for r in X.checkpoint_selection(rows, X.RULES[rule]).collect()}
    assert got("relative") == {1: (3, 0.98, None), 2: (1, 5.0, 21), 3: (7, 1.0, None)}  # exactly 1 % better is no new best
    assert got("absolute")[2] == (1, 5.0, 4) and got("absolute")[3] == (3, 2.5, 6)
    assert got("plain")[2] == (1, 5.0, None) and got("strict")[2] == (1, 5.0, 31)


def test_seeded_split(spark):
    got = {r.id: r.split for r in G.seeded_split(spark.range(103), "id").collect()}
    assert [list(got.values()).count(s) for s in ("train", "test", "val")] == [82, 10, 11]
    again = {r.id: r.split for r in G.seeded_split(spark.range(103).repartition(9), "id").collect()}
    assert got == again


def test_entry_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpusloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=__file__.rpartition("/tests/")[0]).returncode == 0


def test_edit_distance_of_any_vocabulary(spark):
    """Numbered pair by pair, tokens give the same distances as numbered once for the table."""
    rows = spark.createDataFrame([(i, [f"t{(i * k) % 7}" for k in range(i % 9)]) for i in range(30)], "id long, tokens array<string>")
    assert sorted(map(tuple, P.token_edit_distance(rows).collect())) == sorted(map(tuple, P.token_edit_distance(rows, most=2).collect()))


def test_hot_tokens(spark, monkeypatch):
    """A token that many rows share is dealt over several tasks with the same result."""
    hist = spark.createDataFrame([(i, t, 1 + i % 3) for i in range(60) for t in ("all", f"t{i % 5}")], "id long, token string, cnt long")
    want = sorted(map(tuple, P.token_overlap(hist).collect()))
    monkeypatch.setattr(P, "TOKEN_BLOCK", 7)
    assert sorted(map(tuple, P.token_overlap(hist).collect())) == want and len(want) == 60 * 59 // 2


def test_sweep(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", None, 1), ("c", 3, 3)], "model string, target int, prediction int")
    got = {r.model: (r.status, r.n, r.acc_0) for r in M.sweep_summary(rows, ["a", "b", "absent"]).collect()}
    assert got == {"a": ("ok", 2, 50.0), "b": ("failed", 1, None), "absent": ("failed", 0, None)}
    with pytest.raises(Exception, match="absent: no rows"):
        M.sweep_summary(rows, ["a", "absent"], stop_on_error=True).collect()
    assert M.sweep_models(list("wxyz"), "light") == ["w"] and M.sweep_models(list("wxyz"), "default") == list("wxy") and M.sweep_models(list("wxyz"), "full") == list("wxyz")
    with pytest.raises(ValueError, match="unknown preset"):
        M.sweep_models([], "huge")


def test_vector_padding(spark):
    rows = spark.createDataFrame([(1, [[1.0, 2.0, 3.0]]), (2, [[1.0, 1.0, 1.0], [2.0, 2.0, 2.0]])], "id long, pages array<array<double>>")
    got = {r.id: r.padded for r in K.padded_batches(rows, 2, "pages", "id").collect()}
    assert got == {1: [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0]], 2: [[1.0, 1.0, 1.0], [2.0, 2.0, 2.0]]}


def test_end_marks_and_empty_tokens(spark):
    assert array_of(spark, S.truth_tokens, ["a", "<eos>"]) == ["a"]
    assert array_of(spark, lambda t: S.truth_tokens(t, keep_eos=True), ["a", "<eos>"]) == ["a", "<eos>"]
    rows = spark.createDataFrame([(1, ["a", "", "b"])], "id long, tokens array<string>")
    vocabulary = spark.createDataFrame([("", 1), ("a", 2), ("b", 3)], "token string, token_id long")
    assert K.encode_tokens(rows, vocabulary).first().ids == [2, 1, 3] and K.encode_tokens(rows, vocabulary, drop_empty=True).first().ids == [2, 3]


def test_kernel_features(spark):
    """Inner products come close to the kernel, and a ring around a disc is told from it by margins."""
    import numpy as np

    rng = np.random.default_rng(5)
    turn, far = rng.uniform(0, 2 * np.pi, 300), np.where(np.arange(300) % 2, 3.0, 1.0)
    x = np.c_[far * np.cos(turn), far * np.sin(turn)]
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, embedding array<double>, label long")
    train, test = L.rbf_features(rows.where("id < 200"), rows.where("id >= 200"), size=2048)
    z = np.array([r.embedding for r in test.orderBy("id").collect()])
    gamma = 1 / (2 * x[:200].var())
    want = np.exp(-gamma * ((x[200:, None] - x[None, 200:]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.15
    train, test = L.rbf_features(rows.where("id < 200"), rows.where("id >= 200"), size=64)
    done = L.fit_predict(train, test, L.margin()).collect()
    assert len(done) == 100 and sum(r.target == r.prediction for r in done) >= 95
    none = rows.where("false")
    assert [t.count() for t in L.rbf_features(none, none)] == [0, 0]


def test_choice_by_validation(spark):
    rows = [("0", 5, "val", 1, 1.0), ("0", 15, "val", 1, 2.0), ("0", 5, "test", 3, 4.0), ("0", 15, "test", 3, 3.0), ("1", 5, "test", 1, 1.0), ("1", 15, "test", 1, 2.0)]
    seen = spark.createDataFrame(rows, "fold string, max_iter int, split string, target int, prediction double")
    got = {r.fold: (r.max_iter, r.acc_0, r.mse) for r in L.chosen_by_validation(seen).collect()}
    assert got == {"0": (5, 0.0, 1.0), "1": (5, 100.0, 0.0)}


def test_sampled_systems_of_odd_pages(spark):
    """A page that no meter serves draws nothing; meters that only just serve one do."""
    from corpusloom.operators import generation

    index = spark.createDataFrame([("a", 1, 0, 1), ("b", 2, 0, 2), ("b", 3, 1, 2)], "meter string, id int, nth long, size long")
    pages = spark.createDataFrame([(1, None), (2, 0), (3, 3), (4, 2), (5, 1)], "page_id int, n int")
    got = generation.sample_systems(pages, index)
    assert sorted((r.page_id, r.meter, r.id) for r in got.where("page_id <> 5").collect()) == [(4, "b", 2), (4, "b", 3)]
    assert got.where("page_id = 5").count() == 1
    assert generation.sample_systems(pages.limit(0), index).count() == generation.sample_systems(pages, index.limit(0)).count() == 0
