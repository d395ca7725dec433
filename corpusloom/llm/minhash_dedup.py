"""Near-duplicate groups of documents by fast similarity sketching, banding and exact verification.

Sketch: a set's elements are thrown into the coordinates in rounds, each by a hash of its own; the lowest (round,
hash) that reaches a coordinate stays. As many rounds again throw every element into one coordinate each, so all get
filled; most sets fill theirs in a few rounds, and the share of equal coordinates concentrates around the similarity
as with independent hash functions (Dahlgaard, Knudsen and Thorup, 2017).

Linking: documents with equal sets are one node, and nodes that rows of one doc_id have are linked. Nodes that agree on a whole band share a bucket. A node is first held
against the smallest node of each of its buckets; buckets that then still hold several components are worked through in
blocks, sketch against sketch, and what may be similar is held set against set, until all that is linked is connected.
No bucket is cut short, and no step lists all pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import mix, random_words, shingles_of, text_slices, words_of
from .durable import durable, read_table, release

WORDS = 5
COORDINATES = 256
#: A pair at similarity 0.85 shares no band with a chance of 1e-6, one at 0.8 with 2e-4; a pair at 0.4 shares one with 6 %.
BANDS, ROWS = 36, 7
#: Pairs whose sketches agree on a smaller share than the limit less this are not looked at closer: 4.5 standard
#: deviations of the agreement of a pair at the limit.
SLACK = 0.1
#: Nodes of a bucket, and shingles of their sets, in one block; a set that is larger by itself is a block's only large one.
BLOCK = 1500
BLOCK_SHINGLES = 4_000_000
#: Size of the bitmap that tells which texts need not be read again; 4 MB as rows.
FILTER_BITS = 1 << 24

_ROUND = random_words(COORDINATES, 3)
_TARGET = random_words(COORDINATES, 4)
_EMPTY = np.uint64((1 << 64) - 1)


def sketch(text: np.ndarray, element: np.ndarray, n_texts: int) -> np.ndarray:
    """(n_texts, COORDINATES) of 64-bit values; texts without elements keep the largest value everywhere."""
    t = COORDINATES
    out = np.full((n_texts, t), _EMPTY)
    flat = out.reshape(-1)
    at = 0
    while len(text) and at < 2 * t:
        many = int(np.clip(200_000 // len(text), 1, 64))
        rounds = np.arange(at, min(at + many, 2 * t))
        at = int(rounds[-1]) + 1
        early = rounds[rounds < t]
        if len(early):
            value = mix(element[None, :] ^ _ROUND[early][:, None])
            place = text[None, :] * t + (value & np.uint64(t - 1)).astype(np.int64)
            np.minimum.at(flat, place.reshape(-1), ((value >> np.uint64(16)) | (early.astype(np.uint64) << np.uint64(48))[:, None]).reshape(-1))
        late = rounds[rounds >= t]
        if len(late):
            value = mix(element[None, :] ^ _TARGET[late - t][:, None])
            place = text[None, :] * t + (late - t)[:, None]
            np.minimum.at(flat, place.reshape(-1), ((value >> np.uint64(16)) | (late.astype(np.uint64) << np.uint64(48))[:, None]).reshape(-1))
        open_ = (out == _EMPTY).any(axis=1)
        left = open_[text]
        if not left.all():
            text, element = text[left], element[left]
    return out


def _set_keys(text: np.ndarray, element: np.ndarray, n_texts: int) -> list[np.ndarray]:
    """Two 64-bit sums over each text's set: equal sets have equal keys."""
    keys = []
    for seed in (5, 6):
        total = np.zeros(n_texts, np.uint64)
        np.add.at(total, text, mix(element ^ random_words(1, seed)))
        keys.append(total.view(np.int64))
    return keys


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """Per document: size and key of its shingle set, a key per band, and the sketch as 16-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = random_words(BANDS, 7)
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in text_slices(batch.column(1)):
                owner, element = shingles_of(words_of(data, offsets), words)
                sizes = np.bincount(owner, minlength=b - a)
                full = mix(sketch(owner, element, b - a))
                bands = np.repeat(salt[None, :], b - a, 0)
                for k in range(ROWS):
                    bands = mix(bands ^ full[:, k : BANDS * ROWS : ROWS])
                some = sizes > 0
                counts = np.where(some, BANDS, 0)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), bands[some].view(np.int64).reshape(-1))
                small = full.astype(np.uint16)
                sketches = pa.array([row.tobytes() if s else None for row, s in zip(small, some, strict=True)], pa.binary())
                key_a, key_b = _set_keys(owner, element, b - a)
                columns = [ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(key_a), pa.array(key_b), lists, sketches]
                yield pa.record_batch(columns, ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, _SIGNED)


def shingle_sets(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, set_a, set_b, shingles): the full set of each document, as sorted 64-bit values, and its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                owner, element = shingles_of(words_of(data, offsets), words)
                bounds = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(bounds, element.view(np.int64))
                keys = map(pa.array, _set_keys(owner, element, b - a))
                yield pa.record_batch([batch.column(0).slice(a, b - a), *keys, lists], ["doc_id", "set_a", "set_b", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, set_a long, set_b long, shingles array<long>")


def _similar(a: str, b: str, percent: int):
    """100 * |A and B| >= percent * |A or B|, in whole numbers."""
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= percent * (F.size(a) + F.size(b) - shared)


def _agree_at_least(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) whose sketches agree on that share of coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, COORDINATES) for k in (2, 3))
                yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(axis=1) >= least))

    return pairs.mapInArrow(run, "u long, v long")


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Pairs (u, v) with the values of both nodes."""
    left = table.select(F.col("node").alias("u"), F.col(value).alias("of_u"))
    right = table.select(F.col("node").alias("v"), F.col(value).alias("of_v"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "of_u", "of_v")


def perhaps_in(docs: DataFrame, wanted: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents whose place in a bitmap of FILTER_BITS bits some wanted ``key`` holds too, the others, which need not move; and the bitmap.

    The bitmap is at most FILTER_BITS / 64 rows whatever the input; where it fills up, it merely lets more pass.
    """
    place = F.expr(f"pmod(xxhash64('filter', {key}), {FILTER_BITS}L)")
    bit = F.expr(f"shiftleft(1L, int(pmod(xxhash64('filter', {key}), {FILTER_BITS}L) % 64))")
    bitmap = durable(wanted.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(bit).alias("bits")), "bitmap")
    held = F.expr(f"(shiftright(bits, int(pmod(xxhash64('filter', {key}), {FILTER_BITS}L) % 64)) & 1L) = 1L")
    placed = docs.withColumn("word", F.floor(place / 64))
    near = placed.join(F.broadcast(bitmap), "word").where(held)
    far = placed.join(F.broadcast(bitmap), "word", "left").where(~F.coalesce(held, F.lit(False)))
    return near.select(*docs.columns), far.select(*docs.columns), bitmap


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v); component is its smallest node.

    Alternates two rewrites that keep components and shrink to stars: each node's larger neighbours move to its smallest
    one, then its smaller ones do. A node's neighbours are only ever aggregated to their minimum; each step is written.
    """
    edges = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _summary(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # smaller neighbours: the pairs (u, v) with v < u
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        new = durable(new.distinct(), "edges")
        release(edges)
        edges, now = new, _summary(new)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = now


def _summary(edges: DataFrame) -> tuple:
    """Count and two sums over distinct edges: the same for the same edges."""
    mixed = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(edges.agg(F.count("*"), *mixed).first())


class _Forest:
    def __init__(self, label: np.ndarray):
        self.up = np.arange(len(label))
        first: dict = {}
        for i, x in enumerate(label.tolist()):
            self.up[i] = first.setdefault(x, i)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)


def _block_links(percent: int, across: bool):
    """Verified links between the nodes of a block (``across``: of two blocks) that join different components."""
    least = percent / 100 - SLACK

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        node, side, band = rows["node"].to_numpy(), rows["side"].to_numpy(), int(rows["band"].iloc[0])
        coded = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(-1, COORDINATES)
        forest, links = _Forest(rows["component"].to_numpy()), []
        sets = [np.asarray(s) for s in rows["shingles"]]
        bands = np.stack([np.asarray(b) for b in rows["bands"]])
        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            agree = (coded[rest] == coded[i]).mean(axis=1) >= least
            if across:
                agree &= side[rest] != side[i]
            later = i + 1 + np.flatnonzero(agree)
            if band and len(later):  # pairs that meet in an earlier band are dealt with there
                later = later[~(bands[later, :band] == bands[i, :band]).any(axis=1)]
            for j in later.tolist():
                a, b = forest.root(i), forest.root(j)
                if a != b:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                        forest.up[b] = a
                        links.append((node[i], node[j]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if 100 * |A and B| >= ``percent`` * |A or B| of their full sets of distinct ``words``-word
    shingles; component_id is the smallest doc_id that links reach, kept says whether it is the document's own. A text
    of fewer words is one shingle; null, empty or blank texts have none and are linked with nothing. Equal texts are
    linked at any length. Rows that repeat a doc_id are one document with the links of all of them. A row with a null
    doc_id is linked with nothing: its component is null and it is kept. An empty table gives no rows.
    """
    signed = durable(signatures(docs, text, words), "signatures")
    live = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes, node = _classes(live)
    nodes = live.withColumn("node", node).join(classes.select("node", F.col("least").alias("doc_id")), ["node", "doc_id"])
    repeated = durable(live.withColumn("node", node).groupBy("doc_id").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1"), "repeated")
    unique = repeated.isEmpty()
    # one row a class: copies are met again only through the class
    nodes = nodes.select("node", "n_shingles", "bands", "sketch")
    nodes = nodes if unique else nodes.dropDuplicates(["node"])
    banded = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("node").alias("center"), F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")).where("size > 1")
    blocks = F.least("size", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    buckets = buckets.select("band", "key", "center", "size", blocks.alias("blocks"))
    shared = durable(banded.drop("n_shingles").join(buckets, ["band", "key"]), "buckets")

    sketches = durable(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "sketch", "bands"), "sketches")
    stars = shared.where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    stars = durable(_agree_at_least(_with_both(stars, sketches, "sketch"), percent / 100 - SLACK), "stars")

    rest_keys = shared.where("size > 2").select("node").distinct()
    wanted = stars.select(F.explode(F.array("u", "v")).alias("node")).union(rest_keys).distinct()
    wanted = durable(wanted.join(classes, "node").select("node", F.col("least").alias("doc_id")), "wanted")
    sources, _, bitmap = perhaps_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), wanted)
    sets = shingle_sets(sources.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), "text", words).select(node.alias("node"), "shingles")
    if not unique:  # a doc_id brings all its texts: those asked for stay, once
        sets = sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = durable(sets, "sets")
    links = _with_both(stars, sets, "shingles").where(_similar("of_u", "of_v", percent)).select("u", "v")
    if not unique:
        links = links.unionByName(live.withColumn("u", node).join(repeated, "doc_id").where("u <> v").select("u", "v").distinct())
    links = durable(links, "links")
    found = components(links)

    # buckets in which the others are not all connected yet
    labelled = shared.where("size > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    others = labelled.where("node <> center").groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    labelled = durable(labelled.join(others.where("low <> high").select("band", "key"), ["band", "key"], "left_semi"), "unsettled")
    links2 = durable(_links_in_blocks(labelled, sketches, sets, percent), "links2")
    found = components(links.union(links2)) if not links2.isEmpty() else found
    # a component's id is its least doc_id
    members = found.join(classes.select("node", "least"), "node")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    known = durable(members.join(least, "component").join(classes.select("node", "set_a", "set_b"), "node").select("set_a", "set_b", "component_id"), "components")
    release(repeated, shared, sketches, stars, wanted, bitmap, sets, links, labelled, links2)

    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = signed.select("doc_id", "n_shingles", "set_a", "set_b")
    alone = rows.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    known = classes.join(known, ["set_a", "set_b"], "left").select("set_a", "set_b", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.where(linked).join(known, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _classes(live: DataFrame) -> tuple[DataFrame, Column]:
    """(set_a, set_b, least, node): the distinct sets, the least doc_id that has each, and a number of its own; and the number as an expression.

    Numbers are hashes of the set's key; another seed is taken should two of a table be equal.
    """
    sets = live.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"))
    for seed in range(64):
        node = F.xxhash64(F.lit(seed), "set_a", "set_b")
        classes = durable(sets.withColumn("node", node), "classes")
        if classes.groupBy("node").count().where("count > 1").isEmpty():
            return classes, node
        release(classes)
    raise RuntimeError("no seed keeps the sets apart")


def _links_in_blocks(labelled: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the nodes of each bucket: every block by itself, then, of larger buckets, every two blocks."""
    spread = labelled.select("band", "key", "node", "component", F.col("blocks").alias("n"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"))
    # a pair of blocks (x, y), x <= y, is one task; a node goes to the pairs of its own block
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spread = spread.select("band", "key", "node", "component", "n", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("own").alias("side"))
    rows = spread.join(sketches, "node").join(sets, "node")
    shape = "u long, v long"
    inside = rows.where("x = y").groupBy("band", "key", "x", "y").applyInPandas(_block_links(percent, False), shape)
    across = rows.where("x < y").groupBy("band", "key", "x", "y").applyInPandas(_block_links(percent, True), shape)
    return inside.union(across)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in groups linked at 85 of 100, five-word shingles."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)
