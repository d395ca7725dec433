"""A training corpus from raw documents: toxic ones out, unreadable ones out, near-duplicates to one, the rest packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Models are learned from the
documents of the stage and, for toxicity, the labels beside them. Rows with a null doc_id and repeated rows are judged
by their own texts, and of repeated ones the third stage leaves one; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language_id, minhash_dedup, packing, toxicity

#: Documents whose language is less certain than this, or that have no letter, are rejected. Of 50,953 documents of the
#: larger tables whose language is recognised 20 are below it, mostly one word said over and over (166 would be at 0.55);
#: of texts of random letters in a script never learned about one in eight.
LEAST_CERTAIN = 0.45


#: Ids for rows without one, from a hash of their texts: above all ids in use, so that a document with an id stays before one without.
_OWN_ID = 1 << 62


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own toxicity score stays under the limit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, score = toxicity.scored(docs, toxicity.train(docs, toxicity.learning_labels(labels)))
    return rows.where(F.col(score) < toxicity.REJECT).select(*docs.columns)


def keep_readable(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text has letters and a language that is recognised; without any labelled language, all with letters."""
    model = language_id.train(docs.where(F.coalesce(language_id.fold("doc_id", 4), F.lit(0)) != 2))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows, language, score = language_id.predicted(docs, model)
    return rows.where((F.col(language) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_CERTAIN)).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at a similarity of 0.8: of its smallest id, else (all ids null) of one text.

    Of rows that repeat an id one stays. Texts without words are linked with nothing; of equal ones without an id one stays.
    """
    own_id = F.coalesce(F.col("doc_id").cast("long"), _OWN_ID + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 3))
    found = packing.durable(minhash_dedup.near_duplicates(docs.select(own_id.alias("doc_id"), "text"), percent=80), "groups")
    # ids of which a row goes, all of them (kept is false) or all but one; texts of other ids, most of them, stay where they are
    odd = packing.durable(found.groupBy(F.col("doc_id").alias("_odd")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")).where("NOT _kept OR _n > 1"), "odd")
    near, far, _ = minhash_dedup.perhaps_in(docs.withColumn("_own", own_id), odd.select(F.col("_odd").alias("_own")), "_own")
    judged = near.join(odd, F.col("_own") == F.col("_odd"), "left")
    one = judged.where("_kept").dropDuplicates(["_own"])
    return far.unionByName(judged.where("_odd IS NULL").select(*far.columns)).unionByName(one.select(*far.columns)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every remaining document in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", keep_clean), ("language", keep_readable), ("near_duplicates", keep_one_of_each), ("packing", packed)]
#: Models and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = packing.durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
