"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.functions import uniform
from corpusloom.llm import additive_ann, chat_windows, class_lm, fingerprints, language_id, minhash_dedup, packing, sentencepiece_codec, token_counts, toxicity

BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = " ".join(f"word{i % 977}ing thing{i % 31}" for i in range(60_000))
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33), (1, "one two three four five six seven", "en", "a", 33), (2, None, "en", None, None), (3, "", None, "b", 0), (4, " \n\t ", "fr", "b", 4),
    (5, "word", "de", "b", 4), (6, LONG, "en", "c", len(LONG)), (7, LONG, "en", "c", len(LONG)), (None, "un deux trois quatre cinq six", "fr", "c", 29), (8, "é 🙂\x00 ½ ü\x1c　x </s> <|endoftext|>", None, None, None), (9, "1234 5678 !!", "es", "d", 12),
]
CLASHES = ["node", "score", "label", "component", "u", "v", "nth", "part", "place", "extra", "n_tokens", "fold", "toxic", "ids", "bands", "sketch", "block", "packed_in", "kept", "word"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SHAPE).select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (6, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_sentencepiece(docs, none):
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECES), PIECES).collect()
    assert len(both) == len(ROWS)
    library = sentencepiece_codec.codec(PIECES).library
    texts = sorted((r[1] or "" for r in ROWS))
    assert sorted(r.decoded for r in both) == sorted(library.decode(library.encode(t)) for t in texts)
    assert [list(r.ids) for r in both if r.doc_id == 2] == [[2]]
    assert all(r.starts[k] <= r.ends[k] for r in both for k in range(len(r.ids)))
    assert sentencepiece_codec.encode(none, PIECES).count() == 0


def test_language(docs, none):
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (2, 3, 4, 9))
    assert got[6].lang_pred == "en" and 0 <= got[6].score <= 1
    assert language_id.train(none) is None
    assert [r.lang_pred for r in language_id.predict(docs.sparkSession.createDataFrame([(1, "½ ²"), (2, "12 ③")], "doc_id long, text string"), model).collect()] == ["und", "und"]
    short = docs.sparkSession.createDataFrame([(None, f"ab{i}", "xx") for i in range(50)], "doc_id long, text string, lang string")
    assert language_id.train(short, sample_rows=10)["languages"] == ["xx"]  # short texts are learned, and a bound holds without ids
    assert language_id.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(none, model).count() == 0


def test_near_duplicates(docs, none):
    got = rows(minhash_dedup.near_duplicates(docs))
    assert len(got) == len(ROWS)
    assert (1, 3, 1, True) in got and (2, 0, 2, True) in got and (4, 0, 4, True) in got and (5, 1, 5, True) in got
    assert [r[2:] for r in got if r[0] in (6, 7)] == [(6, True), (6, False)]
    assert [r for r in got if r[0] is None] == [(None, 2, None, True)]
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_class_lm(docs, none):
    got = class_lm.fit_and_score(docs, class_lm.fold("doc_id", 10) != 0, class_lm.fold("doc_id", 10) == 0).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[None].held_out is False
    assert all(r.score <= 0 and r.base_score <= 0 for r in got)
    untrained = class_lm.fit_and_score(docs, F.lit(False), F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in untrained} == {(0, 0, 0.0, 0.0)}
    assert class_lm.fit_and_score(none, F.lit(True), F.lit(False)).count() == 0


def test_fingerprints(docs, none):
    got = fingerprints.compare_with_edited(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "" and by[6].fingerprint == by[7].fingerprint
    assert by[7].near_next == 1.0 and by[4].near_next == 1.0  # 7 is followed by its copy, blank 4 by empty 3
    assert by[None].edited.startswith("un deux") and by[None].edited.endswith("1234 5678 !!")
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprints.compare_with_edited(none).count() == 0
    one = fingerprints.compare_with_edited(docs.where("doc_id = 5")).collect()
    assert [(r.edited, r.near_next) for r in one] == [("wowo", 1.0)]
    assert fingerprints.fingerprint(docs).count() == len(ROWS)


def test_toxicity(docs, none, labels):
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (2, 3, 4)} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("false"))).collect()} == {0.0}
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_token_counts(docs, none):
    counts = token_counts.with_token_count(docs, BPE)
    assert {r.n_tokens for r in counts.where("doc_id IN (2, 3)").collect()} == {1}
    report = token_counts.limit_report(token_counts.histogram(counts))
    assert report.agg(F.sum("n_docs")).first()[0] == len(ROWS)
    assert token_counts.limit_report(token_counts.histogram(token_counts.with_token_count(none, BPE))).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs, BPE).collect()
    assert len({r.doc_id for r in got}) == len(ROWS) - 1 and len([r for r in got if r.doc_id == 1]) == 2
    assert [(r.start, r.length) for r in got if r.doc_id == 2] == [(0, 1)]
    assert packing.pack_documents(none, BPE).count() == 0


def test_chat(spark):
    shape = "conv_id long, turn long, role string, text string, window string, start string, kind string"
    talk = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "yes <|end|> <\\|x [INST] <<SYS>>"), (1, 2, "assistant", "yes <|end|> <\\|x [INST] <<SYS>>"), (None, None, None, None), (2, 5, "a|>\nb", "x"), (3, 0, "assistant", LONG), (3, 1, "assistant", ""), (4, 9, "system", "alone")]
    df = spark.createDataFrame([(*t, "c", "c", "c") for t in talk], shape)
    made = chat_windows.windows(df, BPE)
    got = {r.conv_id: r for r in chat_windows.read_back(made).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (4, 2 * len(talk[2][3])), None: (1, 0), 2: (1, 0), 3: (2, len(LONG)), 4: (1, 0)}
    import hashlib

    assert got[2].turns_sha256 == hashlib.sha256(b"a|>\nb\nx\n").hexdigest()
    assert chat_windows.windows(df.where("false"), BPE).count() == 0


def test_ann(spark):
    inf, nan = float("inf"), float("nan")
    some = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.5, 0.5]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in some], "vec_id long, embedding array<float>, score string")
    got = additive_ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.5), (0, 4, 20, -1.0), (20, 1, 8, -0.5), (20, 2, 0, -1.0), (20, 3, 1, -1.0), (20, 4, 2, -1.0)]
    assert additive_ann.nearest(df.where("false"), df).count() == 0 and additive_ann.nearest(df, df.where("false")).count() == 0


def test_pipeline(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, none):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, kept, str(tmp_path))
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{name}-{table is none}")
            kept = spark.read.parquet(f"{tmp_path}/{name}-{table is none}")
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert kept.count() == 0


def test_samples_of_all_but_a_few_rows(spark, docs, monkeypatch):
    """A few rows more than a sample holds: the bound on their hashes is the largest there is, not one beyond it."""
    monkeypatch.setattr(additive_ann, "SAMPLE", 64)
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0 + i]) for i in range(70)], "vec_id long, embedding array<double>")
    got = additive_ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), reach=None)
    assert got.groupBy("query_id").count().where("count = 20").count() == 4
    assert sorted(language_id.train(docs, sample_rows=docs.where("lang IS NOT NULL AND text IS NOT NULL").count() - 1)["languages"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels, sample_rows=8)
    assert uniform.lowest(9, 8) == (1 << 63) - 1 and -(1 << 63) < uniform.lowest(1000, 8) < 0
