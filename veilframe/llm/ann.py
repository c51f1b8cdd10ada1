"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are assigned to cells around centroids fitted on a bounded sample. A vector's residual from its
centroid is rotated at random into ``BITS_A_DIMENSION`` times its dimensions, and the sign of every component is
kept as one packed bit, with three correction scalars: the residual's length, the cosine between code and
residual, and the residual's product with the centroid. From these, a block of packed bits estimates inner
products with every query, with an error bound.

A query starts from the k-th best exact score within the sample, which the true k-th best cannot be below. It
skips the cells that cannot reach it (centroid product plus the cell's radius), and in the others reranks, on
the original vectors in double precision, those whose upper bound reaches it and the block's k-th best lower bound.
So only the error bounds' confidence can lose a neighbour.

Large cells are cut by a hash of the row, and cells with many queries by a hash of the query, so that a
task's block is bounded in both. Equal rows of one id are indexed once, and within a block an id counts once, by
its best row, towards the k-th bound and the k best.

Defined results: vectors that are null, zero, of another than the most frequent length, or hold a null or
non-finite component take no part, nor do null ids; rows with one vec_id are one vector, the best-scoring of them;
ties go to the smaller vec_id. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, small, store

K, SAMPLE, ROUNDS, SEED = 20, 8192, 6, 17
CELL_ROWS, MOST_CELLS, BITS_A_DIMENSION = 4096, 1024, 4
BLOCK_ROWS, BLOCK_QUERIES, CONFIDENCE = 8192, 4096, 3.0


class Codes:
    """Centroids, and the rotation from a seed."""

    def __init__(self, centroids: np.ndarray, seed: int = SEED):
        self.centroids = centroids
        self.bits = -(-centroids.shape[1] * BITS_A_DIMENSION // 64) * 64
        gauss = np.random.default_rng(seed).standard_normal((self.bits, centroids.shape[1]))
        self.rotation = np.linalg.qr(gauss)[0].T

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, seed: int = SEED) -> Codes:
        """About CELL_ROWS rows a cell, by a few rounds of k-means over the sample."""
        rng = np.random.default_rng(seed)
        count = min(MOST_CELLS, max(1, rows // CELL_ROWS), len(sample))
        centroids = sample[rng.choice(len(sample), count, replace=False)]
        for _ in range(ROUNDS):
            nearest = cls.nearest(sample, centroids)
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, sample)
            sizes = np.bincount(nearest, minlength=count)
            centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        return cls(centroids, seed)

    @staticmethod
    def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return ((centroids**2).sum(1) - 2 * vectors @ centroids.T).argmin(1)

    def encode(self, vectors: np.ndarray):
        """cell, packed bits, and the three scalars of each vector."""
        cell = self.nearest(vectors, self.centroids)
        rest = vectors - self.centroids[cell]
        length = np.sqrt((rest**2).sum(1))
        turned = rest @ self.rotation
        cosine = np.abs(turned).sum(1) / (np.where(length > 0, length, 1) * math.sqrt(self.bits))
        return cell, np.packbits(turned > 0, axis=1), length, np.where(length > 0, cosine, 1.0), (rest * self.centroids[cell]).sum(1)

    def estimator(self, cell: int, bits: np.ndarray, length: np.ndarray, cosine: np.ndarray, product: np.ndarray):
        """A function of queries that gives their estimated inner products (queries x vectors) and error bounds.

        <o, q> = <c, q> + <r, c> + <r, q - c>; the last term comes from the bits, as signs of the rotated residual.
        """
        centroid = self.centroids[cell]
        signs = np.unpackbits(bits, axis=1).astype(np.float32).T * 2 - 1
        scale = length / (cosine * math.sqrt(self.bits))
        spread = CONFIDENCE * length * np.sqrt(np.maximum(1 - cosine**2, 0)) / (cosine * math.sqrt(self.bits - 1))

        def estimate(queries: np.ndarray):
            rest = queries - centroid
            guess = ((rest @ self.rotation).astype(np.float32) @ signs) * scale + product + (queries @ centroid)[:, None]
            return guess, np.sqrt((rest**2).sum(1, keepdims=True)) * spread + 1e-5 * (1 + np.abs(guess))

        return estimate


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row inner products, added in the order of the dimensions, so that equal vectors tie."""
    total = np.zeros(len(queries))
    for a, b in zip(queries.T, vectors.T):
        total += a * b
    return total


def best_of_block(estimate, k: int, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray):
    """The k best ids of the block for each query, as far as they reach its floor: (query_id, vec_id, score).

    An id may have several rows; its best one counts.
    """
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[by_id], prepend=ids[by_id[0]] - 1)) if len(ids) else by_id
    for a in range(0, len(queries), 64):
        own, own_ids, floor = queries[a : a + 64], query_ids[a : a + 64], floors[a : a + 64]
        guess, bound = estimate(own)
        itself = own_ids[:, None] == ids[None, :]
        if len(starts) > k:
            low = np.where(itself, -np.inf, guess - bound)
            if len(starts) < len(ids):
                low = np.maximum.reduceat(low[:, by_id], starts, axis=1)
            floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
        which, who = np.nonzero((guess + bound >= floor[:, None]) & ~itself)
        scores = exact(own[which], vectors[who])
        if len(starts) < len(ids):
            order = np.lexsort((-scores, ids[who], which))
            which, who, scores = which[order], who[order], scores[order]
            best = (np.diff(which, prepend=-1) != 0) | (np.diff(ids[who], prepend=0) != 0)
            best[:1] = True
            which, who, scores = which[best], who[best], scores[best]
        order = np.lexsort((ids[who], -scores, which))
        which, who, scores = which[order], who[order], scores[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        kept = (place < k) & (scores >= floors[a : a + 64][which])
        yield own_ids[which[kept]], ids[who[kept]], scores[kept]


def valid(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, each once however many rows repeat it, and their length."""
    sized = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    unfit = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sized = sized.where(F.col("v").isNotNull() & ~unfit & F.exists("v", lambda x: x != 0))
    lengths = sized.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = lengths.d if lengths else 1
    return sized.where(F.size("v") == dim).distinct(), dim


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score) for the rows where ``is_query`` holds."""
    spark = vectors.sparkSession
    fit, dim = valid(vectors)
    fit = store(fit, "vectors")
    rows = fit.count()
    picked = fit.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = {r.vec_id: r.v for r in fit.join(F.broadcast(picked), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).collect()}
    sample = dict(sorted(sample.items()))
    points = np.array(list(sample.values()), float).reshape(-1, dim) if sample else np.zeros((1, dim))
    codes = Codes.fit(points, rows)
    shipped = spark.sparkContext.broadcast((codes, points))  # at most MOST_CELLS centroids and SAMPLE vectors

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                cell, bits, *scalars = shipped.value[0].encode(_matrix(batch.column(1), dim))
                packed = pa.array([x.tobytes() for x in bits], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), batch.column(1), packed, *map(pa.array, scalars)], ["cell", "vec_id", "v", "bits", "length", "cosine", "product"])

    kind = fit.schema["v"].dataType.simpleString()
    index = store(fit.mapInArrow(encode, f"cell int, vec_id long, v {kind}, bits binary, length double, cosine double, product double"), "codes")
    discard(fit)
    radii = np.zeros(len(codes.centroids))
    for r in index.groupBy("cell").agg(F.max("length").alias("radius")).collect():  # a row per cell
        radii[r.cell] = r.radius

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                own, points = _matrix(batch.column(1), dim), shipped.value[1]
                floor, far = np.full(len(own), -np.inf), k + 1  # one more than k: the query itself may be in the sample
                if len(points) >= far:
                    for a in range(0, len(own), 256):
                        floor[a : a + 256] = np.partition(own[a : a + 256] @ points.T, -far, axis=1)[:, -far]
                floor -= 1e-9 * (1 + np.abs(floor))  # this product adds in another order
                reach = own @ shipped.value[0].centroids.T + np.sqrt((own**2).sum(1))[:, None] * radii * (1 + 1e-9) + 1e-9
                cells = [np.flatnonzero(x).astype(np.int32) for x in reach >= floor[:, None]]
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.list_(pa.int32())), *batch.columns, pa.array(floor)], ["cells", "query_id", "v", "floor"])

    asked = index.where(is_query(F.col("vec_id"))).select("vec_id", "v").mapInArrow(route, f"cells array<int>, query_id long, v {kind}, floor double")
    asked = store(asked.select(F.explode("cells").alias("cell"), "query_id", "v", "floor"), "routed")
    # Two numbers a cell: into how many parts its vectors and its queries are cut.
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("cuts")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("turns")), "cell")
    parts = small(store(parts, "parts"), 32, len(codes.centroids))
    part = lambda columns, count: F.pmod(F.xxhash64(*columns), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = index.join(parts, "cell").select("*", part(["vec_id", "v"], "cuts").alias("cut"), every("turns").alias("turn")).drop("cuts", "turns")
    right = asked.join(parts, "cell").select("*", part(["query_id", "v"], "turns").alias("turn"), every("cuts").alias("cut")).drop("cuts", "turns")

    def match(data: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not data.num_rows or not queries.num_rows:
            return empty
        bits = np.frombuffer(b"".join(data.column("bits").to_pylist()), np.uint8).reshape(data.num_rows, -1)
        scalars = (data.column(x).to_numpy() for x in ("length", "cosine", "product"))
        estimate = shipped.value[0].estimator(data.column("cell")[0].as_py(), bits, *scalars)
        found = best_of_block(estimate, k, data.column("vec_id").to_numpy(), _matrix(data.column("v"), dim), queries.column("query_id").to_numpy(), _matrix(queries.column("v"), dim), queries.column("floor").to_numpy())
        return pa.concat_tables([pa.table(dict(zip(empty.column_names, x))) for x in found] or [empty])

    keys = ["cell", "cut", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
