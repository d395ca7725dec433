"""Inputs of the registered queries, derived from the given tables; each also as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.score_text import tokenize_aligned
from ..functions.uniform import uniform
from ..sources.store import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u_sql(seed: str, *keys: str) -> str:
    text = "||'-'||".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x'||substr(md5({text}),1,8) AS BIGINT)/4294967296.0)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): the lines of an order as a two-spine text with control lines, chords, barlines and terminators."""
    li = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string").alias("q"), n.alias("n"))
    num = F.col("n").cast("string")
    line = F.concat(
        F.lit("="), num, F.lit("\t="), num, F.lit("\n"), F.when(F.col("l_returnflag") == "R", "*tremolo\t*\n").otherwise(""), F.when(F.col("l_linestatus") == "F", "*\t*\n").otherwise(""),
        F.col("q"), F.lit("@c·/ 8·e\t"), F.col("l_linenumber").cast("string"), F.lit("·d\n"),
    )
    meter = (F.min("l_linenumber") + 1).cast("string")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "")
    rows = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("**kern\t**kern\n*clefF4\t*clefG2\n*M"), meter, F.lit("/4\t*M"), meter, F.lit("/4\n"), body, F.lit("*-\t*-\n")).alias("text"))
    return rows


SCORES = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS n FROM lineitem),
scores AS (SELECT l_orderkey AS id, '**kern'||chr(9)||'**kern'||chr(10)||'*clefF4'||chr(9)||'*clefG2'||chr(10)||'*M'||(min(l_linenumber)+1)||'/4'||chr(9)||'*M'||(min(l_linenumber)+1)||'/4'||chr(10)||
 string_agg('='||n||chr(9)||'='||n||chr(10)||CASE WHEN l_returnflag='R' THEN '*tremolo'||chr(9)||'*'||chr(10) ELSE '' END||CASE WHEN l_linestatus='F' THEN '*'||chr(9)||'*'||chr(10) ELSE '' END||
 CAST(l_quantity AS INT)||'@c·/ 8·e'||chr(9)||l_linenumber||'·d'||chr(10), '' ORDER BY n)||'*-'||chr(9)||'*-'||chr(10) AS text FROM li GROUP BY l_orderkey)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, tokens) of the user turns."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", tokenize_aligned(F.col("text"), " ").alias("tokens"))


TURNS = "turns AS (SELECT conv_id*100+turn AS id, text, string_split(replace(text,chr(10),' '),' ') AS tokens FROM conversations WHERE role='user')"


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, reference, hypothesis): a user turn and the assistant's next one."""
    rows = table(spark, sf_dir, "conversations")
    user = rows.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("reference"))
    answer = rows.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn") - 1).alias("id"), F.col("text").alias("hypothesis"))
    return user.join(answer, "id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, vec_id, embedding) of page vectors; stem is score_page_label."""
    e = table(spark, sf_dir, "embeddings")
    stem = F.concat_ws("_", F.concat(F.lit("s_"), F.floor(F.col("vec_id") / 5).cast("string")), (F.col("vec_id") % 5).cast("string"), F.col("label").cast("string"))
    return e.select(stem.alias("stem"), "vec_id", "embedding")


PAGES = "pg AS (SELECT vec_id, embedding, label, 's_'||(vec_id//5) AS score_id, CAST(vec_id%5 AS INT) AS page FROM embeddings)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), ((F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)) % 10).alias("prediction"), F.col("label").alias("target"))


PREDICTIONS = "pr AS (SELECT vec_id AS id, (label + CASE WHEN vec_id%4=0 THEN 1 ELSE 0 END)%10 AS prediction, label AS target FROM embeddings)"


#: Orders whose detections share a file.
FILE_ORDERS = 5000


def detection_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of detection files, some thousand orders each, written line by line; categories as a list in every other file, else as a map by id."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    files = -(-orders.count() // FILE_ORDERS) or 1
    file = lambda key: F.pmod(F.xxhash64(key), F.lit(files)).cast("int").alias("file")
    images = orders.select(file("id"), F.lit(0).alias("part"), F.col("id").alias("n"), F.to_json(F.struct("id", F.concat(F.col("id").cast("string"), F.lit(".png")).alias("filename"))).alias("value"))
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_suppkey").alias("category_id"),
        F.array("l_quantity", F.col("l_linenumber") * 10.0, F.col("l_discount") * 100 - 1, F.col("l_tax") * 100).alias("bbox"), (F.col("l_returnflag") == "R").cast("int").alias("iscrowd"),
    )
    named = li.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("category_id"), "s_name"), "category_id")
    notes = named.select(file("image_id"), F.lit(1).alias("part"), F.col("image_id").alias("n"), F.to_json(F.struct("image_id", "category_id", "bbox", "iscrowd")).alias("value"))
    own = named.select(file("image_id"), F.lit(2).alias("part"), F.col("category_id").alias("n"), F.col("s_name").alias("name")).distinct()
    as_list = F.col("file") % 2 == 1
    entry = F.concat(F.lit('"'), F.col("n").cast("string"), F.lit('":'), F.to_json(F.struct("name")))
    categories = own.select("file", "part", "n", F.when(as_list, F.to_json(F.struct(F.col("n").alias("id"), "name"))).otherwise(entry).alias("value"))
    openings = F.array(F.lit('{"images":['), F.lit('],"annotations":['), F.when(as_list, '],"categories":[').otherwise('],"categories":{'), F.when(as_list, "]}").otherwise("}}"))
    frame = spark.range(files).select(F.col("id").cast("int").alias("file")).select("file", F.posexplode(openings).alias("part", "value"))
    frame = frame.select("file", "part", F.lit(None).cast("long").alias("n"), "value")
    rows = frame.unionByName(images).unionByName(notes).unionByName(categories)
    order = Window.partitionBy("file").orderBy("part", F.col("n").asc_nulls_first(), "value")
    follows = F.col("n").isNotNull() & F.lag("n").over(order).isNotNull()
    folder = scratch(spark, "detections")
    rows.select("file", F.concat(F.when(follows, ",").otherwise(""), "value").alias("value")).write.partitionBy("file").text(folder)
    return folder


NOTES = """notes AS (SELECT l_orderkey AS image_id, l_suppkey AS category_id, l_quantity AS x, l_linenumber*10.0 AS y, l_discount*100-1 AS w, l_tax*100 AS h, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS iscrowd FROM lineitem JOIN supplier ON l_suppkey=s_suppkey)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("epoch"), F.col("value").alias("metric"), "ts", "event_id")


RUN_LOG = "lg AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS metric, ts, event_id FROM events)"


def fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): the fold splits of one document each, as nested JSON; documents without a label have 0."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("u", uniform("fold", F.col("doc_id"), F.col("fold")))
    split = F.when(F.col("u") < 0.8, "train").when(F.col("u") < 0.9, "test").otherwise("val")
    entry = F.create_map(F.col("fold").cast("string"), F.create_map(split, F.create_map(F.col("doc_id").cast("string"), F.coalesce(F.col("quality").cast("int"), F.lit(0)))))
    return rows.select(F.to_json(entry).alias("value"))


FOLDS = f"""fd AS (SELECT CAST(f AS VARCHAR) AS fold, CASE WHEN u<0.8 THEN 'train' WHEN u<0.9 THEN 'test' ELSE 'val' END AS split, CAST(doc_id AS VARCHAR) AS sample_id, CAST(coalesce(quality,0) AS INT) AS label
FROM (SELECT doc_id, quality, f, {u_sql("fold", "doc_id", "f")} AS u FROM documents LEFT JOIN labels USING (doc_id), range(5) r(f)))"""
