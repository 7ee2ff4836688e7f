"""Hard-negative mining by dual-tree search.

Rows and anchors form two trees of balls. A sample's principal directions, halved at the median again and again, give each
vector a path; rows sorted by label, path and the next direction are cut into leaves of bounded size, and FAN nodes in a row make
a node of the next level, up to one root. For two balls with centres a and c and radii r and s all inner products lie within
|a|s + |c|r + rs of a.c, so a pair of nodes is dropped for a whole group of anchors at once where that interval, or the nodes'
labels, hold nothing that one of them wants. What is left at the leaves is scored exactly.

First come the positives: of the same label, at least as good as what an anchor's own leaf has. Their scores then give the bands
in which the negatives lie, and the trees are searched again for other labels. The sample of SAMPLE vectors is chosen by hash and
only decides how much is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.llm import common, tiles
from brinework.llm.pivot_search import as_long

SAMPLE, FAN, LEAF, ANCHORS, DEPTH = 4096, 8, 1024, 256, 10


def splits(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and medians of a binary tree over the rows of x: node i has the children 2i + 1 and 2i + 2; one level more of
    directions than of cuts orders the rows of a leaf."""
    directions, cuts = np.zeros((2 ** (depth + 1) - 1, x.shape[1])), np.zeros(2 ** (depth + 1) - 1)
    inside = [np.arange(len(x))]
    for i in range(len(cuts)):
        rows, y = inside[i], x[inside[i]]
        if len(rows) > 1:
            y = y - y.mean(axis=0)
            v = y[np.argmax((y * y).sum(axis=1))]
            for _ in range(8):  # power iteration
                v = y.T @ (y @ v)
                v = v / max(np.linalg.norm(v), 1e-300)
            directions[i] = v
            cuts[i] = np.median(x[rows] @ v)
        right = x[rows] @ directions[i] > cuts[i]
        inside += [rows[~right], rows[right]]
    return directions, cuts


def _pathed(scale: tiles.Scale, directions: np.ndarray, cuts: np.ndarray, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vec = batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
            path, along = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                f = tiles.floats(tiles.ints([vec[i] for i in at], dim), scale.unit)
                n = min(dim, directions.shape[1])
                node = np.zeros(len(at), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (np.einsum("ij,ij->i", f[:, :n], directions[node, :n]) > cuts[node])
                path[at] = node
                along[at] = np.einsum("ij,ij->i", f[:, :n], directions[node, :n])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(path), pa.array(along)], names=[*batch.schema.names, "path", "dist"])

    return run


def _ball(centres: np.ndarray, radii: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """A ball around balls: their mean, and the farthest that any of them reaches."""
    c = (centres * count[:, None]).sum(axis=0) / max(1, count.sum())
    return c, float((np.sqrt(((centres - c) ** 2).sum(axis=1)) + radii).max(initial=0.0)) * (1 + 1e-9) + 1e-12


def _leaf_ball(scale: tiles.Scale):
    def of(t: pa.Table) -> tuple[bytes, float]:
        t = t.filter(pa.compute.equal(t.column("kind"), 0))
        f = tiles.floats(tiles.ints(t.column("vec").to_pylist(), int(t.column("dim")[0].as_py())), scale.unit)
        c, r = _ball(f, np.zeros(len(f)), np.ones(len(f)))
        return c.tobytes(), r

    return of


_NODE = "node long, dim int, l0 long, l1 long, n long, centre array<double>, radius double"


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """One node around its children. Of children of several lengths it has no centre, and all scores are possible."""
    if rows.dim.nunique() > 1 or rows.dim.iloc[0] < 0:
        dim, c, r = -1, np.zeros(0), float("inf")
    else:
        dim = int(rows.dim.iloc[0])
        c, r = _ball(np.array([np.asarray(v, float) for v in rows.centre]).reshape(len(rows), -1), rows.radius.to_numpy(), rows.n.to_numpy())
    return pd.DataFrame({"node": [rows.parent.iloc[0]], "dim": [dim], "l0": [rows.l0.min()], "l1": [rows.l1.max()], "n": [rows.n.sum()], "centre": [c], "radius": [r]})


def _levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The nodes of a tree from its leaves up to one root, numbered in each level; FAN in a row have one parent."""
    out = [leaves]
    n = leaves.count()
    while n > 1:
        n = -(-n // FAN)
        up = out[-1].withColumn("parent", F.expr(f"node div {FAN}")).groupBy("parent").applyInPandas(_joined, _NODE)
        out.append(common.written(up, name))
    return out


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def leaf_pairs(anchors: list[DataFrame], rows: list[DataFrame], wants: list[DataFrame], relation: str, scale: tiles.Scale) -> DataFrame:
    """(qb, block, least, greatest) of the leaves that the two trees, walked down together, cannot rule out. wants: for each level
    of the anchors' tree (node, want_lo, want_hi)."""
    spark = wants[0].sparkSession
    i, j = len(anchors) - 1, len(rows) - 1
    pairs, slack = spark.createDataFrame([(0, 0)], "a long, c long"), tiles.SLACK * max(1, scale.dim)
    while True:
        a = anchors[i].join(wants[i], "node").select(F.col("node").alias("a"), F.col("dim").alias("adim"), F.col("l0").alias("al0"), F.col("l1").alias("al1"), F.col("centre").alias("ac"), F.col("radius").alias("ar"), "want_lo", "want_hi")
        c = rows[j].select(F.col("node").alias("c"), F.col("dim").alias("cdim"), F.col("l0").alias("cl0"), F.col("l1").alias("cl1"), F.col("centre").alias("cc"), F.col("radius").alias("cr"))
        x = pairs.join(a, "a").join(c, "c").where("adim = cdim or adim < 0 or cdim < 0")
        x = x.where("al0 <= cl1 and cl0 <= al1" if relation == "same" else "not (al0 = al1 and cl0 = cl1 and al0 = cl0)")
        known = (F.col("adim") >= 0) & (F.col("cdim") >= 0)
        wide = F.sqrt(_dot("ac", "ac")) * F.col("cr") + F.sqrt(_dot("cc", "cc")) * F.col("ar") + F.col("ar") * F.col("cr") + slack
        x = x.withColumn("mid", F.when(known, _dot("ac", "cc"))).withColumn("wide", F.when(known, wide))
        x = x.select("a", "c", "want_lo", "want_hi", F.coalesce(F.col("mid") - F.col("wide"), F.lit(float("-inf"))).alias("least"), F.coalesce(F.col("mid") + F.col("wide"), F.lit(float("inf"))).alias("greatest"))
        pairs = common.written(x.where("greatest >= want_lo and least <= want_hi").select("a", "c", "least", "greatest"), "node-pairs")
        if i == 0 and j == 0:
            return pairs.select(F.col("a").alias("qb"), F.col("c").alias("block"), "least", "greatest")
        down_a, down_c = i > 0 and i >= j, j > 0 and j >= i
        if down_a:
            i -= 1
            pairs = pairs.join(anchors[i].select(F.col("node").alias("below"), F.expr(f"node div {FAN}").alias("a")), "a").select(F.col("below").alias("a"), "c")
        if down_c:
            j -= 1
            pairs = pairs.join(rows[j].select(F.col("node").alias("below"), F.expr(f"node div {FAN}").alias("c")), "c").select("a", F.col("below").alias("c"))


def ball_bounds(search: tiles.Search, _t: pa.Table, header: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores, in units, between each query of a search and all rows of a leaf."""
    c, r = np.frombuffer(header.column("vec")[0].as_py(), np.float64), header.column("dist")[0].as_py()
    mid = search.f @ c
    wide = np.sqrt((search.f * search.f).sum(axis=1)) * r + tiles.SLACK * max(1, search.dim)
    return mid - wide, mid + wide


def _wants(queries: DataFrame, anchors: list[DataFrame], scale: tiles.Scale, mode: str, low: int, high: int) -> list[DataFrame]:
    want = common.written(tiles.wanted(queries, scale, mode, low, high).withColumnRenamed("qb", "node"), "group-wants")
    out = [want]
    for _ in anchors[1:]:
        out.append(out[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.min("want_lo").alias("want_lo"), F.max("want_hi").alias("want_hi")))
    return out


def hard_negatives(vectors: DataFrame, asks: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors (vec_id, embedding, label: an
    integer) that ask.

    A score is the integer inner product of floor(256 * x); higher ones come first, ties by smaller vec_id. An anchor's positives are
    its first other rows of the same label, and for each the negatives are the first rows of another label with low * positive_score
    <= 100 * score <= high * positive_score (none where the positive score is negative).

    Rows with a null label, a null vector or a null or non-finite component take no part; vectors of different lengths do not meet. Repeated rows
    each ask and each may be found; a row leaves out only itself. A null vec_id comes last among ties. Scores beyond 64 bits
    are compared exactly up to 34 digits, and returned as the nearest long. An anchor without positives or negatives has no rows.
    """
    rows = tiles.integer_rows(vectors, asks, F.col("label"))
    spark, scale = rows.sparkSession, tiles.Scale(rows)
    labels = rows.select("label").distinct().count()
    depth = int(np.clip(np.log2(max(1, scale.count / (LEAF * max(1, labels)))), 0, DEPTH))
    directions, cuts = splits(tiles.sample(rows, sample, scale), depth)
    columns = ["id", "label", "dim", "cls", "vec", "kind"]
    asking = rows.where("asks").dropDuplicates(["cls"]).withColumn("kind", F.lit(1))
    x = tiles.first_copies(rows, max(positives + 1, negatives)).withColumn("kind", F.lit(0)).select(columns).unionByName(asking.select(columns))
    pathed = "id long, label long, dim int, cls binary, vec binary, kind int, path int, dist double"
    x = x.mapInArrow(_pathed(scale, directions, cuts, depth), pathed)
    order = ["dim", "label", "path", "dist", "cls"]
    x = x.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order, "id")
    x = common.written(x.mapInArrow(tiles.cut(["dim", "label", "path"], LEAF, positives + 1, _leaf_ball(scale)), f"{pathed}, part long, number long, asked long, low decimal(38,0)"), "leaves")
    x = common.written(tiles.numbered(x, "number", "block"), "leaves")
    queries = tiles.numbered(x.where("kind = 1"), "asked", "n").withColumn("qb", F.expr(f"n div {ANCHORS}"))
    dims = queries.groupBy("qb").agg(F.min("dim").alias("d0"), F.max("dim").alias("d1")).where("d0 < d1")
    if not dims.isEmpty():  # groups hold vectors of one length; where lengths meet, a group is cut there
        of = queries.select("n", "dim").groupBy("dim").agg(F.min("n").alias("first"), F.count("*").alias("c"))
        starts = [(r.dim, r.first, r.c) for r in of.orderBy("dim").toLocalIterator()]
        base, table = 0, []
        for dim, first, c in starts:
            table.append((dim, first, base))
            base += -(-c // ANCHORS)
        queries = queries.join(spark.createDataFrame(table, "dim int, first long, base long"), "dim").withColumn("qb", F.col("base") + F.expr(f"(n - first) div {ANCHORS}"))
    queries = queries.withColumn("lows", F.array(F.col("low").cast(scale.score))).withColumn("marks", F.lit(None).cast(f"array<{scale.score}>"))
    queries = common.written(queries.select("qb", "label", "dim", "cls", "vec", "marks", "lows"), "anchor-groups")
    heads = x.where("kind = 2").select(F.col("block").alias("node"), "dim", F.col("label").alias("l0"), F.col("label").alias("l1"), F.lit(1).cast("long").alias("n"), "vec", F.col("dist").alias("radius"))
    leaves = common.written(heads.mapInArrow(_centres, _NODE), "leaf-balls")
    # blocks without rows hold only asking copies: they have no header, and no leaf
    leaves = common.written(leaves.join(x.where("kind = 0").groupBy("block").agg(F.count("*").alias("size")), leaves["node"] == F.col("block")).withColumn("n", F.col("size")).select(leaves.columns), "leaf-balls")
    trees = _levels(leaves, "row-nodes")
    groups = queries.groupBy("qb").applyInArrow(_group_ball(scale), _NODE)
    anchors = _levels(common.written(groups, "anchor-balls"), "anchor-nodes")
    body = x.where("kind <> 1").select("block", F.when(F.col("kind") == 2, 1).otherwise(2).alias("kind"), "id", "label", "dim", "cls", "vec", F.col("path").alias("pivot"), "dist")

    pairs = leaf_pairs(anchors, trees, _wants(queries, anchors, scale, "top", 0, 0), "same", scale)
    near = tiles.best(queries, body, pairs, ball_bounds, scale, positives + 1, "same")
    near = common.written(tiles.without_own(rows.where("asks"), near, positives), "positives")
    marks = near.groupBy("cls").agg(F.sort_array(F.collect_set(F.when(F.col("score") >= 0, F.col("score")))).alias("marks")).where(F.size("marks") > 0)
    queries = common.written(queries.drop("marks", "lows").join(marks, "cls").select("qb", "label", "dim", "cls", "vec", "marks", F.lit(None).cast(f"array<{scale.score}>").alias("lows")), "marked-groups")
    pairs = leaf_pairs(anchors, trees, _wants(queries, anchors, scale, "band", low, high), "different", scale)
    far = tiles.best(queries, body, pairs, ball_bounds, scale, negatives, "different", "band", low, high)
    far = far.join(queries.select("cls", F.posexplode("marks").alias("which", "mark")), ["cls", "which"])
    far = far.groupBy("cls", "mark").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("nul"), "id", "score"))).alias("found"))
    far = common.written(far, "negatives")
    out = near.join(far, (near["cls"] == far["cls"]) & (near["score"] == far["mark"])).select("asker", near["id"].alias("positive_id"), near["score"].alias("p"), F.posexplode("found").alias("rank", "t"))
    return out.select(F.col("asker").alias("anchor_id"), "positive_id", (F.col("rank") + 1).alias("rank"), F.col("t.id").alias("negative_id"), as_long(F.col("p")).alias("positive_score"), as_long(F.col("t.score")).alias("negative_score"))


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaf headers with their centre as an array."""
    for batch in batches:
        centre = pa.array([np.frombuffer(v, np.float64) for v in batch.column("vec").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("dim"), batch.column("l0"), batch.column("l1"), batch.column("n"), centre, batch.column("radius")], names=["node", "dim", "l0", "l1", "n", "centre", "radius"])


def _group_ball(scale: tiles.Scale):
    def of(t: pa.Table) -> pa.Table:
        dim, label = int(t.column("dim")[0].as_py()), t.column("label").to_numpy()
        f = tiles.floats(tiles.ints(t.column("vec").to_pylist(), dim), scale.unit)
        c, r = _ball(f, np.zeros(len(f)), np.ones(len(f)))
        return pa.table({"node": pa.array([t.column("qb")[0].as_py()]), "dim": pa.array([dim], pa.int32()), "l0": pa.array([int(label.min())]), "l1": pa.array([int(label.max())]), "n": pa.array([len(f)]), "centre": pa.array([c], pa.list_(pa.float64())), "radius": pa.array([r])})

    return of
