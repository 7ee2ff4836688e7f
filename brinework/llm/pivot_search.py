"""Exact top-k search by a pivot-distance index.

Every vector gets one more component that makes all norms equal to the largest one (queries get zero there): then the highest inner
product is the smallest distance. The key of a vector is its nearest pivot and its distance from it; sorted by key, rows are cut
into annuli of bounded size. By the triangle inequality a row of an annulus cannot be nearer to a query than the difference of
their distances from the pivot. A query first sees its own annulus, which bounds what can still be among its best; the
others follow by their bounds, and the search ends where no bound is below the worst of the best.

Pivots are means of a sample of SAMPLE vectors chosen by hash; they decide how much is skipped, never what is found. Every row
is indexed and may be compared; where vectors are spread without structure, most are. Equal vectors meet as at most k + 1 rows,
since ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.llm import common, tiles

PIVOTS, SAMPLE = 64, 4096


def lifted(f: np.ndarray, most: float) -> np.ndarray:
    """The component that brings each row's square norm to `most`."""
    return np.sqrt(np.maximum(0.0, most - (f * f).sum(axis=1)))


def means(x: np.ndarray, n: int, steps: int = 6) -> np.ndarray:
    """Up to n means of the rows of x, begun from rows far from each other."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    picked, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(x)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    c = x[picked]
    for _ in range(steps):
        nearest = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        count = np.bincount(nearest, minlength=len(c))
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def _from_pivots(f: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from pivots, whose last component is the lifted one; the others are cut or filled with zeros."""
    p = np.zeros((len(pivots), f.shape[1]))
    n = min(f.shape[1], pivots.shape[1] - 1)
    p[:, :n] = pivots[:, :n]
    d2 = (f * f).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * f @ p.T + (lift[:, None] - pivots[None, :, -1]) ** 2
    return np.sqrt(np.maximum(d2, 0.0))


def _keyed(scale: tiles.Scale, most: float, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vec = batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
            kind = batch.column("kind").to_numpy()
            pivot, dist, all_ = np.zeros(len(dims), np.int32), np.zeros(len(dims)), [None] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                f = tiles.floats(tiles.ints([vec[i] for i in at], dim), scale.unit)
                d = _from_pivots(f, lifted(f, most), pivots)  # the key of a query's vector is that of the same vector as a row
                pivot[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
                ask = np.flatnonzero(kind[at] == 1)
                for i, line in zip(at[ask].tolist(), _from_pivots(f[ask], np.zeros(len(ask)), pivots), strict=True):
                    all_[i] = line
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(dist), pa.array(all_, pa.list_(pa.float64()))], names=[*batch.schema.names, "pivot", "dist", "dists"])

    return run


def annulus_bounds(most: float, pivots: np.ndarray):
    """Bounds of the scores, in units, between each query of a search and all rows of an annulus."""

    def of(search: tiles.Search, t: pa.Table, _header) -> tuple[np.ndarray, np.ndarray]:
        pivot, dist = t.column("pivot")[0].as_py(), t.column("dist").to_numpy()
        d = _from_pivots(search.f, np.zeros(len(search.f)), pivots[pivot : pivot + 1])[:, 0]
        square = (search.f * search.f).sum(axis=1) + most
        # distances come from rounded squares: what they may lack is the root of a rounding error
        slack = 1e-6
        near, far = np.maximum(0.0, np.maximum(d - dist.max(), dist.min() - d) - slack), d + dist.max() + slack
        wide = tiles.SLACK * max(1, search.dim)
        return (square - far * far) / 2 - wide, (square - near * near) / 2 + wide

    return of


def top_k(vectors: DataFrame, asks: Column, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) that asks, the k other rows with the highest
    integer inner products of floor(256 * x), ties to the smaller vec_id.

    Rows whose vector is null or holds null or non-finite components take no part; zero vectors do. Vectors of different lengths
    do not meet, empty ones score 0 with each other. Repeated rows each ask and each may be found; a row leaves out only itself. A null
    vec_id comes last among ties. Scores beyond 64 bits are compared exactly up to 34 digits, and returned as the nearest long.
    """
    rows = tiles.integer_rows(vectors, asks)
    spark, scale = rows.sparkSession, tiles.Scale(rows)
    points = tiles.sample(rows, sample, scale)
    most = float(scale.dim)  # a component is at most 1, so no square norm is larger; the largest one makes sharper bounds
    norm = rows.select("dim", "vec").mapInArrow(_square_norms(scale), "n double").agg(F.max("n")).first()[0]
    most = min(most, (norm or 0.0) * (1 + 1e-12))
    centres = means(np.column_stack((points, lifted(points, most))), pivots)
    columns = ["id", "label", "dim", "cls", "vec", "kind"]
    asking = rows.where("asks").dropDuplicates(["cls"]).withColumn("kind", F.lit(1))
    x = tiles.first_copies(rows, k + 1).withColumn("kind", F.lit(0)).select(columns).unionByName(asking.select(columns))
    keyed = "id long, label long, dim int, cls binary, vec binary, kind int, pivot int, dist double, dists array<double>"
    x = x.mapInArrow(_keyed(scale, most, centres), keyed)
    x = x.repartitionByRange(common.partitions(spark), "dim", "pivot", "dist", "cls").sortWithinPartitions("dim", "pivot", "dist", "cls", "id")
    x = x.mapInArrow(tiles.cut(["dim", "pivot"], tiles.BLOCK, k + 1), f"{keyed}, part long, number long, asked long, low decimal(38,0)")
    x = common.written(x.withColumn("block", F.col("part") * 2**32 + F.col("number")), "annuli")
    queries = tiles.numbered(x.where("kind = 1"), "asked", "n").withColumn("qb", F.col("dim").cast("long") * 2**32 + F.floor(F.col("n") / tiles.GROUP))
    queries = queries.withColumn("lows", F.array(F.col("low").cast(scale.score))).withColumn("marks", F.lit(None).cast(f"array<{scale.score}>"))
    queries = common.written(queries.select("qb", "label", "dim", "cls", "vec", "marks", "lows", "dists"), "group-queries")
    groups = queries.select("qb", "dim", F.posexplode("dists").alias("pivot", "d")).groupBy("qb", "dim", "pivot").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    squares = queries.select("qb", "dim", "vec").mapInArrow(_square_norms(scale, True), "qb long, n double").groupBy("qb").agg(F.min("n").alias("q0"), F.max("n").alias("q1"))
    blocks = x.where("kind = 0").groupBy("block").agg(F.first("dim").alias("dim"), F.first("pivot").alias("pivot"), F.min("dist").alias("b0"), F.max("dist").alias("b1"))
    near = F.greatest(F.lit(0.0), F.col("d0") - F.col("b1") - 1e-6, F.col("b0") - F.col("d1") - 1e-6)
    far, wide = F.col("d1") + F.col("b1") + 1e-6, tiles.SLACK * max(1, scale.dim)
    pairs = groups.join(blocks, ["dim", "pivot"]).join(squares, "qb")
    pairs = pairs.select("qb", "block", ((F.col("q0") + most - far * far) / 2 - wide).alias("least"), ((F.col("q1") + most - near * near) / 2 + wide).alias("greatest"))
    want = tiles.wanted(queries, scale, "top", 0, 0)
    pairs = pairs.join(want, "qb").where("greatest >= want_lo").select("qb", "block", "least", "greatest")
    body = x.where("kind = 0").select("block", F.lit(2).alias("kind"), "id", "label", "dim", "cls", "vec", "pivot", "dist")
    found = tiles.best(queries.drop("dists"), body, pairs, annulus_bounds(most, centres), scale, k + 1)
    out = tiles.without_own(rows.where("asks"), found, k)
    return out.select(F.col("asker").alias("query_id"), "rank", F.col("id").alias("vec_id"), as_long(F.col("score")).alias("score"))


def as_long(score: Column) -> Column:
    """A score as a long; beyond 64 bits, the nearest one."""
    exact = score.cast("decimal(38,0)")
    return F.when(exact > F.lit(2**63 - 1).cast("decimal(38,0)"), F.lit(2**63 - 1)).when(exact < F.lit(-(2**63)).cast("decimal(38,0)"), F.expr("-9223372036854775808L")).otherwise(exact.cast("long"))


def _square_norms(scale: tiles.Scale, with_group: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vec = batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
            out = np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                f = tiles.floats(tiles.ints([vec[i] for i in at], dim), scale.unit)
                out[at] = (f * f).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*([batch.column("qb")] if with_group else []), pa.array(out)], names=[*(["qb"] if with_group else []), "n"])

    return run
