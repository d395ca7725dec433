"""Pooling of vectors, roll-up of pages to scores, labels of scores."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_mean_pool(pages: DataFrame, key: str = "score_id", column: str = "embedding") -> DataFrame:
    """(key, embedding): mean vector of a score's pages; every task sends one partial sum a score.

    Pages without a vector, or with a null component, take no part, and scores of such pages only have no row. Vectors of
    unlike length within a score are an error.
    """
    rows = pages.select(key, F.col(column).cast("array<double>").alias("_v")).where("size(_v) > 0 AND forall(_v, x -> x IS NOT NULL)")
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("_v")))).alias("embedding"))


def token_grid_pool(grid: Column, width: int, rows: int | None = None, how: str = "mean") -> Column:
    """Pool a flat row-major grid: ``mean`` over all cells, ``rows`` means per grid row (of the first ``rows``), ``flatten``."""
    part = F.slice(grid, 1, rows * width) if rows else grid
    if how == "flatten":
        return part
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    if how == "mean":
        return F.array(mean(part))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(part) / width).cast("int") - 1), lambda r: mean(F.slice(part, r * width + 1, F.lit(width))))


def score_label(pages: DataFrame, key: str = "score_id", label: str = "label", how: str = "mode") -> DataFrame:
    """(key, label): most frequent page label, smallest on ties; or ``max``, ``mean``."""
    value = {"mode": F.mode(label, True), "max": F.max(label), "mean": F.avg(label)}[how]
    return pages.groupBy(key).agg(value.alias("label"))


def page_sequence(pages: DataFrame, key: str = "score_id", page: str = "page", column: str = "embedding") -> DataFrame:
    """(key, pages, n_pages): a score's pages in numeric order."""
    rows = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col(column).alias("value")))).alias("all"))
    return rows.select(key, F.transform("all", lambda x: x["value"]).alias("pages"), F.size("all").alias("n_pages"))


def class_count(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.agg((F.max(label) - F.min(label) + 1).alias("n_classes"))


def quality_checks(vectors: DataFrame, pages: DataFrame, tokens: DataFrame, expected_tokens: int = 4097, most_pages: int = 80, stored: DataFrame | None = None, splits: DataFrame | None = None, folds: list[str] | None = None) -> DataFrame:
    """(check, id): vectors that are ragged or not finite, scores of too many pages, wrong token counts, unknown folds.

    ``vectors``: id, embedding; ``pages``: id, n_pages; ``tokens``: id, n_tokens; ``splits``: id, fold, held against
    ``folds``. Each id that ``stored`` (id) lacks, or has besides those of ``vectors``, is a ``stored count``. A table
    without rows gives ``empty input``.
    """
    usual = vectors.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).select("w")
    sized = vectors.crossJoin(F.broadcast(usual))
    bad = [
        sized.where(F.size("embedding") != F.col("w")).select(F.lit("ragged vector").alias("check"), "id"),
        vectors.where(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select(F.lit("not finite").alias("check"), "id"),
        pages.where(F.col("n_pages") > most_pages).select(F.lit("too many pages").alias("check"), "id"),
        tokens.where(F.col("n_tokens") != expected_tokens).select(F.lit("token count").alias("check"), "id"),
        vectors.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty input").alias("check"), F.lit(None).cast("long").alias("id")),
    ]
    if stored is not None:
        side = lambda a, b: a.select("id").exceptAll(b.select("id")).select(F.lit("stored count").alias("check"), "id")
        bad += [side(vectors, stored), side(stored, vectors)]
    if splits is not None:
        bad.append(splits.where(~F.col("fold").isin(folds or [])).select(F.lit("unknown fold").alias("check"), "id"))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out


def run_collapse(frames: DataFrame, key: str, order: list[str], label: str, blank: str) -> DataFrame:
    """Frames whose label differs from the one before them, blanks then dropped."""
    before = F.lag(label).over(Window.partitionBy(key).orderBy(*order))
    return frames.withColumn("_b", before).where((F.col("_b").isNull()) | (F.col("_b") != F.col(label))).where(F.col(label) != blank).drop("_b")


def frame_argmax(scores: DataFrame, frame: list[str], label: str, score: str) -> DataFrame:
    """Best class of each frame, the lowest on ties."""
    best = Window.partitionBy(*frame).orderBy(F.desc(score), label)
    return scores.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def contiguous_labels(categories: DataFrame, key: str = "id") -> DataFrame:
    """Categories with label 1..N in id order; 0 is the background."""
    from .tokens import numbered

    return numbered(categories.select(key).distinct(), key, name="n").select(key, (F.col("n") + 1).alias("label")).join(categories, key)


def boxes_xyxy(notes: DataFrame) -> DataFrame:
    """Annotations without crowds and empty boxes, box as two corners."""
    b = F.col("bbox")
    return notes.where((F.col("iscrowd") == 0) & (b[2] > 0) & (b[3] > 0)).withColumn("box", F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]))


def image_targets(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, boxes, labels): every image, with empty lists where it has no box. ``boxes``: image_id, box, label."""
    own = boxes.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("box", "label"))).alias("all"))
    rows = images.select("id").join(own, "id", "left")
    pick = lambda f: F.coalesce(F.transform("all", lambda x: x[f]), F.array())
    return rows.select("id", pick("box").alias("boxes"), pick("label").alias("labels"))
