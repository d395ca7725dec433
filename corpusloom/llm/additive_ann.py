"""Approximate nearest neighbours (largest inner products) by additive quantisation.

A vector is its length times a direction; directions are coded as the sum of one word from each of several codebooks,
all of the vectors' full dimension. The first book is coarse and grows with the table, its words are the cells of the
index; the others code what is left over. Books are trained on the driver on a bounded sample, a beam search finds the
words of every vector, and its length and that of what its code leaves over are stored.

A query's product with what a code leaves over, r, is taken to be at most REACH * |q| * |r| / sqrt(dimension): that is
REACH standard deviations if r points anywhere. Each query first searches the cells nearest to it, which gives a floor
for its last answer, then every other cell and code whose score and reach come up to the floor; there is no cap on
either. A table of the query's products with all words scores codes by lookups, and codes within reach are ranked again
on the original vectors. With a REACH of sqrt(dimension) the answer is that of brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.uniform import lowest
from .durable import durable, read_table, release

#: Books after the first, and their words.
BOOKS, WORDS = 11, 256
#: Words of the first book: so many times the square root of the number of vectors, at most MOST_CELLS.
CELLS, MOST_CELLS = 0.25, 4096
BEAM = 4
#: Vectors that the books are trained on at most.
SAMPLE = 12_000
REACH = 3.0
#: Rows of an index block, queries that meet one at once, vectors that a query's first cells hold at least.
CODE_BLOCK, QUERY_BLOCK, FIRST = 8192, 2048, 256
#: Relative slack for rounding of scores in 32 and of products in 64 bits.
LOOSE, FINE = 1e-4, 1e-10
NEAREST = 20


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: no null, no null or non-finite component, not all zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, and lengths as fractions (0.5 to 1) and powers of two: nothing over- or underflows for finite vectors."""
    power = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    scaled = np.ldexp(x, -power[:, None])
    length = np.sqrt((scaled * scaled).sum(axis=1))
    fraction, more = np.frexp(length)
    return scaled / np.maximum(length, 1e-300)[:, None], fraction, power + more


def _nearest_words(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = ((book * book).sum(1)[None, :] - 2 * x[at : at + 4096] @ book.T).argmin(axis=1)
    return out


def _means(x: np.ndarray, own: np.ndarray, book: np.ndarray) -> None:
    """Move each word to the mean of its vectors; words without any stay."""
    n = np.bincount(own, minlength=len(book))
    total = np.zeros((len(book), x.shape[1]))
    np.add.at(total, own, x)
    book[n > 0] = (total[n > 0] / n[n > 0, None]).astype(book.dtype)


def train_books(sample: np.ndarray, cells: int, books: int = BOOKS, words: int = WORDS, rounds: int = 4) -> list[np.ndarray]:
    """Codebooks of unit vectors: k-means on what the books before leave over, then passes that refit each book with the others held."""
    rng = np.random.default_rng(5)
    x = sample.astype(np.float32)
    out, rest = [], x.copy()
    for size in [cells, *[words] * books]:
        size = min(size, len(rest))
        book = rest[rng.choice(len(rest), size, replace=False)].copy()
        for _ in range(rounds):
            _means(rest, _nearest_words(rest, book), book)
        rest -= book[_nearest_words(rest, book)]
        out.append(book)
    codes = encode(x, out)
    for _ in range(2):
        rest = x - sum(book[codes[:, m]] for m, book in enumerate(out))
        for m, book in enumerate(out):
            if m:  # the first book's words stay the cells' centres
                rest += book[codes[:, m]]
                _means(rest, codes[:, m], book)
                rest -= book[codes[:, m]]
    return out


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> np.ndarray:
    """(n, books) of words whose sum comes closest, keeping the ``beam`` best beginnings after each book."""
    out = np.empty((len(x), len(books)), np.uint16)
    for at in range(0, len(x), 512):
        part = x[at : at + 512].astype(np.float32)
        rest = part[:, None, :]
        codes = np.zeros((len(part), 1, 0), np.uint16)
        for book in books:
            error = (rest * rest).sum(2)[:, :, None] + (book * book).sum(1)[None, None, :] - 2 * rest @ book.T
            flat = error.reshape(len(part), -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // len(book), best % len(book)
            rows = np.arange(len(part))[:, None]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint16)], axis=2)
            rest = rest[rows, parent] - book[word]
        out[at : at + 512] = codes[np.arange(len(part)), (rest * rest).sum(2).argmin(axis=1)]
    return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


_CODED = "place long, vec_id long, alone boolean, cell int, codes binary, left double, off double, length double, power int, vector array<double>"


def code_vectors(groups: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Every vector coded: its cell, words, what its direction lacks of the code (left) and of the cell's centre (off), its length."""
    dimension = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(3), dimension)
                unit, length, power = directions(x)
                codes = encode(unit, books)
                off = unit - books[0][codes[:, 0]]
                left = off - sum(book[codes[:, m]].astype(float) for m, book in enumerate(books) if m)
                columns = [pa.array([c.tobytes() for c in codes], pa.binary()), *(pa.array(np.sqrt((r * r).sum(1))) for r in (left, off)), pa.array(length), pa.array(power.astype(np.int32))]
                yield pa.record_batch([*batch.columns[:3], pa.array(codes[:, 0].astype(np.int32)), *columns, batch.column(3)], [c.split()[0] for c in _CODED.split(", ")])

    return groups.select("place", "vec_id", (F.size("members") == 1).alias("alone"), "vector").mapInArrow(run, _CODED)


_KINDS = {"places": np.int64, "ids": np.int64, "alone": bool, "codes": np.uint16, "left": np.float64, "vectors": np.float64}


def cells_of(coded: DataFrame) -> DataFrame:
    """(cell, n, longest, shortest, off, parts): one row a cell that has vectors, at most MOST_CELLS."""
    size = F.struct("power", "length")
    found = coded.groupBy("cell").agg(F.count("*").alias("n"), F.max(size).alias("longest"), F.min(size).alias("shortest"), F.max("off").alias("off"))
    return found.withColumn("parts", F.ceil(F.col("n") / CODE_BLOCK).cast("int")).orderBy("cell")


def index_blocks(coded: DataFrame, cells: DataFrame) -> DataFrame:
    """The index: rows of about CODE_BLOCK vectors of one cell; a cell of many vectors has many rows, by a hash of their places."""
    dealt = coded.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = {"places": table["place"], "ids": table["vec_id"], "alone": table["alone"], "left": table["left"]}
        row = {name: column.to_numpy().astype(_KINDS[name]).tobytes() for name, column in flat.items()}
        row |= {"codes": b"".join(table["codes"].to_pylist()), "vectors": table["vector"].combine_chunks().flatten().to_numpy().tobytes()}
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), **{n: pa.array([row[n]], pa.binary()) for n in _KINDS}})

    return dealt.groupBy("cell", "part").applyInArrow(run, "cell int, part int, " + ", ".join(f"{n} binary" for n in _KINDS))


class Cells:
    """What the driver knows of the cells: centres, rows, lengths over 2**unit, spread."""

    def __init__(self, book: np.ndarray, cells: list[dict], reach: float):
        self.number = np.array([c["cell"] for c in cells], np.int64)
        self.centre = book[self.number].astype(float)
        self.rows, self.parts = (np.array([c[k] for c in cells], np.int64) for k in ("n", "parts"))
        self.unit = max((c["longest"]["power"] for c in cells), default=0)
        of = lambda k: _scaled(np.array([c[k]["length"] for c in cells], float), np.array([c[k]["power"] for c in cells], np.int64), self.unit)
        self.longest, self.shortest, self.off = of("longest"), of("shortest"), np.array([c["off"] for c in cells], float)
        self.reach = reach / np.sqrt(book.shape[1])

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """What a vector of each cell (in units of a query's length) may reach."""
        most = np.minimum(unit @ self.centre.T + self.reach * self.off[None, :], 1.0) + LOOSE
        return most * np.where(most > 0, self.longest[None, :], self.shortest[None, :])

    def first(self, bounds: np.ndarray) -> np.ndarray:
        """Which cells a query searches first: the best ones that hold FIRST vectors together."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, before < FIRST, 1)
        return out


def _scaled(length: np.ndarray, power: np.ndarray, unit: int) -> np.ndarray:
    """Lengths over 2**unit, the power of the longest vector."""
    return np.ldexp(length, np.maximum(power - unit, -1000))


_ASKED = "cell int, part int, q_ids array<long>, floors array<double>, q array<double>"


def ask(queries: DataFrame, cells: Cells, floors: bool) -> DataFrame:
    """For each batch of queries and index block: the queries that search it first, or (``floors``) those that search it next.

    ``queries``: query_id, vector and, with ``floors``, floor: the least product that still counts, null if any does.
    Floors go on over the query's length and 2**unit.
    """
    dimension = cells.centre.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                x, ids = _matrix(part.column(1), dimension), part.column(0).to_numpy()
                way, length, power = directions(x)
                bounds = cells.bounds(way)
                wanted, floor = cells.first(bounds), np.full(len(x), -np.inf)
                if floors:
                    given = part.column(2).to_numpy(zero_copy_only=False)
                    floor = np.where(np.isnan(given), -np.inf, np.ldexp(given / length, -(power + cells.unit)))
                    wanted = ~wanted & (bounds >= floor[:, None])
                out: dict[str, list] = {c.split()[0]: [] for c in _ASKED.split(", ")}
                for k in np.flatnonzero(wanted.any(axis=0)):
                    mine = np.flatnonzero(wanted[:, k])
                    for block in range(cells.parts[k]):
                        for name, value in zip(out, (int(cells.number[k]), block, ids[mine], floor[mine], x[mine].reshape(-1)), strict=True):
                            out[name].append(value)
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return queries.select("query_id", "vector", *(["floor"] if floors else [])).mapInArrow(run, _ASKED)


def best_of_block(q: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, block: dict, books: list[np.ndarray], keep: int, unit: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, column of the block, product) of the ``keep`` largest products of each query that come up to its floor; ties to the smaller id.

    A query does not meet the vectors that only it has.
    """
    ids, codes, x = block["ids"], block["codes"].reshape(-1, len(books)), block["vectors"].reshape(len(block["ids"]), -1)
    keep = min(keep, len(ids))
    length = _scaled(*directions(x)[1:], unit)
    way, scaled, fine = directions(q)[0], np.ldexp(x, -unit), FINE * length.max()
    tables = [way.astype(np.float32) @ book.T for book in books]
    slack = length * (block["left"] * reach / np.sqrt(x.shape[1]) + LOOSE)
    rows, found, products = [], [], []
    for a in range(0, len(q), 32):
        b = min(a + 32, len(q))
        score = tables[0][a:b][:, codes[:, 0]]
        for m in range(1, len(books)):
            score += tables[m][a:b][:, codes[:, m]]
        score = score * length
        own = (q_ids[a:b, None] == ids) & block["alone"]
        score[own] = -np.inf
        first = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        exact = np.where(np.take_along_axis(own, first, 1), -np.inf, np.einsum("qd,qkd->qk", way[a:b], scaled[first]))
        floor = np.maximum(exact.min(axis=1), floors[a:b])[:, None] - fine  # the block's keep-th best is no less
        row, column = np.nonzero((score + slack >= floor) & ~own)
        some = (way[a:b][row] * scaled[column]).sum(axis=1) >= floor[row, 0]
        row, column = row[some], column[some]
        product = (q[a:b][row] * x[column]).sum(axis=1)
        order = np.lexsort((ids[column], -product, row))
        row, column, product = row[order], column[order], product[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        for out, value in ((rows, row + a), (found, column), (products, product)):
            out.append(value[nth < keep])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(products)


def search(asked: DataFrame, index: DataFrame, books: list[np.ndarray], keep: int, unit: int, reach: float) -> DataFrame:
    """(query_id, place, vec_id, score): of each query the ``keep`` best of every index block that it asks."""
    names = list(_KINDS)
    pairs = asked.join(index, ["cell", "part"]).select("q_ids", "floors", "q", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                q_ids, floors, q = (batch.column(c)[k].values.to_numpy() for c in range(3))
                block = {n: np.frombuffer(batch.column(3 + c)[k].as_buffer(), _KINDS[n]) for c, n in enumerate(names)}
                row, column, product = best_of_block(q.reshape(len(q_ids), -1), q_ids, floors, block, books, keep, unit, reach)
                yield pa.record_batch([pa.array(q_ids[row]), pa.array(block["places"][column]), pa.array(block["ids"][column]), pa.array(product)], ["query_id", "place", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, place long, vec_id long, score double")


def _lowest(rows: DataFrame, n: int, most: int) -> DataFrame:
    """The ``most`` of ``n`` rows with the lowest hash of vec_id and vector."""
    rows = rows.withColumn("h", F.xxhash64(F.lit("books"), "vec_id", "vector"))
    if n > most:  # rows beyond a threshold with room to spare need not be sorted
        rows = rows.where(F.col("h") <= lowest(n, most))
    return rows.orderBy("h", "vec_id").limit(most)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, vector: str = "embedding", reach: float | None = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the ``k`` rows found with the largest inner product, its own left out.

    Ties go to the smaller vec_id. Rows that ``usable`` leaves out are neither queries nor found; vectors of another
    length than most are left out too. Of rows with equal vectors the k + 1 of smallest id are carried, as no answer can
    hold more. Rows that share a vec_id are found each by its vector (equal ones once) and are never found by a query of
    that id; a query on several rows asks with its least vector. No queries or no vectors: no rows. A ``reach`` of None
    is the square root of the dimension: what is found is then exact.
    """
    rows = usable(vectors, vector)
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = size[0]["d"] if size else 1
    reach = dimension**0.5 if reach is None else reach
    rows = rows.where(F.size("vector") == dimension)
    same = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "vector"]).withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    groups = few.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    groups = durable(groups.withColumn("place", F.monotonically_increasing_id()), "vectors")
    asked = usable(queries, vector).where(F.size("vector") == dimension).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    asked = durable(asked, "queries")
    count = groups.count()
    sample = _lowest(groups, count, SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    x = directions(_matrix(sample, dimension))[0] if count else np.eye(1, dimension)
    books = train_books(x, cells=int(min(MOST_CELLS, max(1, CELLS * count**0.5))))
    coded = durable(code_vectors(groups, books), "coded")
    known = durable(cells_of(coded), "cells")
    cells = Cells(books[0], [r.asDict(recursive=True) for r in known.orderBy("cell").collect()], reach)
    index = durable(index_blocks(coded, known), "index")
    release(coded, known)

    keep = k + 1
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "place")
    first = durable(search(ask(asked, cells, False), index, books, keep, cells.unit, reach), "first")
    floors = first.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == keep).select("query_id", F.col("score").alias("floor"))
    more = search(ask(asked.join(floors, "query_id", "left"), cells, True), index, books, keep, cells.unit, reach)
    found = first.unionByName(more).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= keep).select("query_id", "place", "score")
    exact = found.join(groups.select("place", "members"), "place").select("query_id", F.explode("members").alias("vec_id"), "score").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20, against all vectors."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
