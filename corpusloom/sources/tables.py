"""Readers and writers of corpora, annotation files, fold splits, vectors and reports."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .split_json import json_sections
from .store import written

PAGE = "struct<ekern:string>"


def read_transcriptions(spark: SparkSession, path: str, split: str | None = None, id_col: str = "doc_id", split_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, split, text) of a corpus; a split, if named, is a pushed-down filter."""
    rows = spark.read.parquet(path)
    rows = rows if split is None else rows.where(F.col(split_col) == split)
    return rows.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), F.col(text_col).alias("text"))


def normalize_source(rows: DataFrame) -> DataFrame:
    """(ref, texture, text) of two layouts: the ``ekern`` of a ``page`` literal where there is one, else the transcription."""
    page = F.from_json("page", PAGE, {"allowSingleQuotes": "true"})
    return rows.select("ref", F.coalesce("page_texture", F.lit("texture")).alias("texture"), F.coalesce(page["ekern"], F.col("transcription")).alias("text"))


def paired(images: DataFrame, truths: DataFrame, key: str) -> DataFrame:
    """Images with their truth."""
    return images.join(truths, key)


def unpaired(images: DataFrame, truths: DataFrame, key: str) -> DataFrame:
    """Images without truth."""
    return images.join(truths, key, "left_anti")


def read_paired_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, missing) of ``<id>_region.png`` and ``<id>_gt.txt`` below a folder; no pixel is read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*_region.png").load(folder).select("path")
    images = listing.select(F.regexp_extract("path", r"([^/]*)_region\.png$", 1).alias("id"), F.col("path").alias("img_path"))
    texts = spark.read.option("pathGlobFilter", "*_gt.txt").text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)_gt\.txt$", 1).alias("id"), F.col("value").alias("symbols"))
    return paired(images, texts, "id"), unpaired(images, texts, "id")


_IMAGE = "id:bigint,file_name:string,filename:string"
_ANNOTATION = "image_id:bigint,category_id:bigint,bbox:array<double>,iscrowd:int"
_CATEGORY = "id:bigint,name:string"


def _images(i: Column) -> list[Column]:
    return [i["id"].alias("id"), F.coalesce(i["file_name"], i["filename"]).alias("file_name")]


def _annotations(a: Column) -> list[Column]:
    return [*[a[c].alias(c) for c in ("image_id", "category_id", "bbox")], F.coalesce(a["iscrowd"], F.lit(0)).alias("iscrowd")]


def _category_map(text: Column) -> Column:
    """Categories by id, each an object with a name or the name itself."""
    return F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].cast("bigint").alias("id"), F.coalesce(F.get_json_object(e["value"], "$.name"), e["value"]).alias("name")))


def detection_tables(raw: DataFrame, value: str = "value") -> dict[str, DataFrame]:
    """images, annotations and categories of detection files held as JSON strings; categories as a list or a map by id."""
    shape = f"struct<images:array<struct<{_IMAGE}>>,annotations:array<struct<{_ANNOTATION}>>,categories:string>"
    doc = written(raw.select(F.from_json(value, shape).alias("d")).select("d.*"))  # parsed once for the three tables
    as_list = F.from_json("categories", f"array<struct<{_CATEGORY}>>")
    listed = F.when(F.ltrim("categories").startswith("["), as_list).otherwise(_category_map(F.col("categories")))
    images = doc.select(F.explode("images").alias("i")).select(*_images(F.col("i")))
    notes = doc.select(F.explode("annotations").alias("a")).select(*_annotations(F.col("a")))
    return {"images": images, "annotations": notes, "categories": doc.select(F.explode(listed).alias("c")).select("c.*").distinct()}


def read_detection_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations and categories of detection files, each read by as many tasks as it has blocks (``spark.sql.files.maxPartitionBytes``).

    A category without an id is an entry of a map by id. Elements that are null or no objects are left out.
    """
    found = json_sections(spark, path)
    of = lambda name, shape: found.where(F.col("section") == name).select("element", F.from_json("element", f"struct<{shape}>").alias("e"))
    categories = of("categories", _CATEGORY)
    listed = F.when(F.col("e.id").isNotNull(), F.array("e")).otherwise(_category_map(F.col("element")))
    return {
        "images": of("images", _IMAGE).select(*_images(F.col("e"))),
        "annotations": of("annotations", _ANNOTATION).select(*_annotations(F.col("e"))),
        "categories": categories.select(F.explode(listed).alias("c")).select("c.*").distinct(),
    }


def fold_splits(raw: DataFrame, value: str = "value") -> DataFrame:
    """(fold, split, sample_id, label) of nested JSON: fold -> split -> sample -> label."""
    nested = F.from_json(value, "map<string,map<string,map<string,int>>>")
    folds = raw.select(F.explode(nested).alias("fold", "splits"))
    return folds.select("fold", F.explode("splits").alias("split", "samples")).select("fold", "split", F.explode("samples").alias("sample_id", "label"))


def score_manifest(samples: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Samples with whether a file is listed for each."""
    marked = listing.select(key).distinct().withColumn("there", F.lit(True))
    return samples.join(marked, key, "left").withColumn("status", F.when(F.col("there"), "found").otherwise("does not exist")).drop("there")


def parse_page_key(stem: Column) -> Column:
    """struct(score_id, page, label) of ``score_page_label``, split from the right; null if it is none."""
    pattern = r"^(.*)_(\d+)_(\d+)$"
    part = F.struct(F.regexp_extract(stem, pattern, 1).alias("score_id"), F.regexp_extract(stem, pattern, 2).cast("int").alias("page"), F.regexp_extract(stem, pattern, 3).cast("int").alias("label"))
    return F.when(stem.rlike(pattern), part)


def materialize_missing(inputs: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The store at ``path`` after computing and adding the keys it lacks; ``compute`` must give one row for each.

    What a call computes goes to a folder of its own, laid out ``by`` columns, and counts once a manifest that lists it
    is there: a call that fails half-way adds nothing and can be made again. Of calls at the same time one writes the
    next manifest; the others keep what it did not add and try again, so no key comes twice. That takes a file system
    whose rename is atomic and does not replace, or a local disk. A null key is a key.
    Raises ValueError, and adds nothing, where a key has no row or several.
    """
    spark, made = inputs.sparkSession, None
    while True:
        version, manifest = _manifest(spark, path)
        store = _stored(spark, path, manifest)
        lacking = _without(inputs, store, key)
        wanted = lacking.select(key).distinct().count()
        if not wanted and store is not None:
            return store
        rows = compute(lacking) if made is None else _without(made, store, key)
        attempt = uuid.uuid4().hex
        folder = f"{path}/data/store_attempt={attempt}"
        rows.write.partitionBy(*by).parquet(folder)
        shape = manifest["schema"] if manifest else rows.schema.jsonValue()
        made = _stored(spark, path, {"schema": shape, "attempts": [attempt]})
        found = made.agg(F.count("*"), F.count_distinct(F.struct(key))).first()
        if tuple(found) != (wanted, wanted) or not _without(made, lacking, key).isEmpty():
            raise ValueError(f"{path} would not hold one row for each {key}")
        _commit(spark, path, version + 1, {"schema": shape, "attempts": [*(manifest["attempts"] if manifest else []), attempt]})


def _without(rows: DataFrame, store: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key the store lacks."""
    if store is None:
        return rows
    there = store.select(F.col(key).alias("_there"))
    return rows.join(there, F.col(key).eqNullSafe(F.col("_there")), "left_anti")


def _stored(spark: SparkSession, path: str, manifest: dict | None) -> DataFrame | None:
    """What a manifest lists."""
    if manifest is None:
        return None
    shape = T.StructType.fromJson(manifest["schema"])
    folders = [f"{path}/data/store_attempt={a}" for a in manifest["attempts"]]
    return spark.read.schema(shape).option("basePath", f"{path}/data").parquet(*folders).select(*shape.names)


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The latest manifest of a store and its number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()] if files.exists(folder) else []
    if not numbers:
        return 0, None
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(folder, str(max(numbers))))
    try:
        return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> bool:
    """Whether this call's manifest became the one of that number. It appears whole or not at all, and never replaces another."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    draft, final = (jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f"draft-{uuid.uuid4().hex}", str(number)))
    stream = files.create(draft, False)
    stream.write(json.dumps(manifest).encode())
    stream.close()
    if files.getUri().getScheme() != "file":
        return not files.exists(final) and files.rename(draft, final)
    try:  # a rename would replace a file of a local disk, a link does not
        os.link(*(files.makeQualified(p).toUri().getPath() for p in (draft, final)))
        return True
    except FileExistsError:
        return False
    finally:
        files.delete(draft, False)


def decimal_comma(value: Column, form: str = "%.4f") -> Column:
    """A number as text with a decimal comma; null as an empty text."""
    return F.coalesce(F.regexp_replace(F.format_string(form, value), r"\.", ","), F.lit(""))


def write_decimal_comma_csv(rows: DataFrame, path: str, forms: dict[str, str] | None = None) -> None:
    """``;``-separated text with a header; doubles as ``%.4f`` or as ``forms`` says."""
    forms = forms or {}
    out = [decimal_comma(F.col(c), forms.get(c, "%.4f")).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*out).write.mode("overwrite").option("sep", ";").option("header", True).option("emptyValue", "").csv(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """(id, prediction, target) as JSON records."""
    rows.select("id", "prediction", "target").write.mode("overwrite").json(path)


def save_vocabulary(vocabulary: DataFrame, path: str) -> DataFrame:
    """Write token, token_id once and read them back; an existing store is an error."""
    vocabulary.select("token", "token_id").write.mode("errorifexists").parquet(path)
    return vocabulary.sparkSession.read.parquet(path)
