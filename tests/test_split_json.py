"""JSON files cut anywhere give the elements that a whole parse gives."""

import json
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import catalog
from corpusloom.sources import split_json
from corpusloom.sources import tables as R
from corpusloom.sources.split_json import json_sections

SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def blocks(spark):
    before = [spark.conf.get(s) for s in SIZES]

    def of(size):
        for s in SIZES:
            spark.conf.set(s, str(size))

    yield of
    for s, b in zip(SIZES, before):
        spark.conf.set(s, b)


def elements(doc):
    """Of a parsed text, what json_sections states."""
    if isinstance(doc, list):
        return [(None, e) for e in doc if isinstance(e, dict)]
    listed = [(k, e) for k, v in doc.items() if isinstance(v, list) for e in v if isinstance(e, dict)]
    return listed + [(k, v) for k, v in doc.items() if isinstance(v, dict)]


def same(rows, docs):
    key = lambda e: (e[0] or "", json.dumps(e[1], sort_keys=True))
    want = sorted((e for d in docs for e in elements(d)), key=key)
    got = sorted(((r.section, json.loads(r.element)) for r in rows), key=key)
    assert got == want


def value(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind == 4:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {text(rng): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [rng.randrange(1000), None, text(rng), text(rng)][kind]


def text(rng):
    return "".join(rng.choice(['{', '}', '[', ']', '"', "\\", ":", ",", "é", "😀", "\n", "a", "images", '":{"']) for _ in range(rng.randrange(7)))


@pytest.mark.parametrize("size", [25, 60, 1 << 20])
def test_random_files(spark, tmp_path, blocks, size):
    rng, docs = random.Random(size), []
    for k in range(6):
        doc = {text(rng): value(rng, 4) for _ in range(5)} | {"images": [value(rng, 3) for _ in range(5)], "notes": {"a}": value(rng, 2)}}
        docs.append([value(rng, 4) for _ in range(6)] if k == 0 else doc)
        (tmp_path / f"{k}.json").write_text(json.dumps(docs[-1], ensure_ascii=k % 2 == 0, indent=k % 3 or None) + "\n" * (k % 3))
    (tmp_path / "empty.json").write_text("")
    blocks(size)
    rows = json_sections(spark, str(tmp_path)).collect()
    same(rows, docs)
    if size == 60:
        same(json_sections(spark, str(tmp_path), sent_states=0).collect(), docs)


def test_one_file_many_tasks(spark, tmp_path, blocks):
    """One detection file is read by at least eight tasks; one of its elements is longer than several blocks."""
    notes = [{"image_id": k % 50, "category_id": k % 7, "bbox": [k, 0.5, 1, 2], "segmentation": {"counts": "}{" * (4000 if k == 500 else 1)}} for k in range(1000)]
    doc = {"info": {"year": 1}, "images": [{"id": k, "filename": f"{k}.png"} for k in range(50)], "annotations": notes, "categories": [{"id": k, "name": f"c{k}"} for k in range(7)], "licenses": None}
    (tmp_path / "coco.json").write_text(json.dumps(doc))
    blocks(4000)
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() >= 8
    t = R.read_detection_json(spark, str(tmp_path))
    got = sorted((r.image_id, r.category_id, r.bbox, r.iscrowd) for r in t["annotations"].collect())
    assert got == sorted((n["image_id"], n["category_id"], list(map(float, n["bbox"])), 0) for n in notes)
    assert sorted(r.id for r in t["images"].collect()) == list(range(50)) and sorted(map(tuple, t["categories"].collect())) == [(k, f"c{k}") for k in range(7)]


def test_same_tables_as_whole_files(spark, tmp_path, blocks):
    (tmp_path / "a.json").write_text('{"categories": {"3": "x", "4": {"name": "y"}}, "annotations": [null, {"image_id": 1, "iscrowd": 1}], "images": []}')
    (tmp_path / "b.json").write_text('{"images": [{"id": 5, "file_name": "p"}]}')
    whole = R.detection_tables(spark.read.text(str(tmp_path), wholetext=True))
    blocks(20)
    split = R.read_detection_json(spark, str(tmp_path))
    for name in ("images", "categories"):
        assert sorted(map(tuple, whole[name].collect())) == sorted(map(tuple, split[name].collect()))
    kept = whole["annotations"].where(F.col("image_id").isNotNull())
    assert list(map(tuple, kept.collect())) == list(map(tuple, split["annotations"].collect())) == [(1, None, None, 1)]


def test_query_on_many_blocks(spark, blocks):
    """The registered query's result does not depend on where its files are cut."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL["s05_read_detection_json"])
    blocks(50_000)
    got = catalog.QUERIES["s05_read_detection_json"](spark, sf).select(*want.columns).collect()
    assert sorted((*map(str, r[:5]), float(r[5])) for r in got) == sorted((*map(str, r[:5]), float(r[5])) for r in want.fetchall())


def test_plain_elements_are_cut_together():
    """Texts in a row that are a plain element each are one piece, whatever comes between such stretches."""
    plain = [f' ,{{"id":{i},"x":[1,"}}"],"n":"a\\"{i}"}}' for i in range(100)]
    odd = ',{"id":-1,"deep":{"y":[{"z":2}]}}'
    texts = ['{"a":[' + plain[0][2:], *plain[1:50], *[t + "}" for t in odd.split("}")[:-1]], *plain[50:], '],"c":{"1":{"name":"u"}', *[f',"{i}":{{"name":"[{i}"}}' for i in range(2, 60)], "}", "}"]
    whole = json.loads("".join(texts))
    cutter, got, pieces = split_json._Cutter(False, 0, None, " " * 3, None), [], 0
    for e in cutter.all(pa.array(texts)):
        pieces += 1
        got += [(e[0], x) for x in e[1].to_pylist()] if len(e) == 2 else [e[1:]]
    assert [(k, json.loads(x)) for k, x in got] == [*(("a", x) for x in whole["a"]), ("c", whole["c"])]
    assert pieces == 5 and not list(cutter.rest())
