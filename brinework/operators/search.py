"""Vector retrieval: exact cosine search with a floor over an index of pivot distances, and its evaluation against relevance labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinework.sources.store import written

#: Pivots, rows of the sample that they come from, rows of a block, queries of a group.
PIVOTS, SAMPLE, BLOCK, GROUP = 32, 2048, 1024, 256
#: Blocks that a group meets at once; of more, the most promising sixteenth comes first, and bounds the rest.
FEW = 64
#: Similarities are told apart to so many places, as their last bits hang on what is multiplied together.
PLACES = 12


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, kind, dim, unit) of the rows whose vector has a direction: no null, odd or only zero components."""
    for batch in batches:
        ids, kinds, dims, units = [], [], [], []
        for i, v, kind in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            big = np.abs(x).max()
            if np.isfinite(big) and big > 0:
                x = x / big
                ids.append(i)
                kinds.append(kind)
                dims.append(len(x))
                units.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["id", "kind", "dim", "unit"])


def _from_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from the pivots, which are cut, or filled with zeros, to their length."""
    p = np.zeros((len(pivots), x.shape[1]))
    n = min(p.shape[1], pivots.shape[1])
    p[:, :n] = pivots[:, :n]
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T))


def _keyed(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, units = batch.column("dim").to_numpy(), batch.column("unit").to_pylist()
            pivot, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                d = _from_pivots(np.frombuffer(b"".join([units[i] for i in at])).reshape(-1, dim), pivots)
                pivot[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(dist)], names=[*batch.schema.names, "pivot", "dist"])

    return run


_PACK = "name string, kind string, dim int, pivot int, d0 double, d1 double, ids array<long>, units binary, dists array<struct<pivot: int, d0: double, d1: double>>"


def _packed(size: int, keys: list[str], pivots: np.ndarray):
    """Consecutive rows with equal keys as one row, `size` at most, with the least and greatest distance from the nearest pivot of the
    first one and from every pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            dim = held[0]["dim"]
            d = _from_pivots(np.frombuffer(b"".join([r["unit"] for r in held])).reshape(-1, dim), pivots)
            each = [{"pivot": k, "d0": a, "d1": b} for k, (a, b) in enumerate(zip(d.min(axis=0).tolist(), d.max(axis=0).tolist(), strict=True))]
            own = each[held[0]["pivot"]]
            row = {"name": f"{part}/{number}", "kind": held[0]["kind"], "dim": dim, "pivot": own["pivot"], "d0": own["d0"], "d1": own["d1"], "ids": [r["id"] for r in held], "units": b"".join([r["unit"] for r in held]), "dists": each}
            return pa.RecordBatch.from_pylist([row], schema=_PACK_SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == size or any(row[k] != held[0][k] for k in keys)):
                    yield out()
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield out()

    return run


_PACK_SCHEMA = pa.schema([
    ("name", pa.string()), ("kind", pa.string()), ("dim", pa.int32()), ("pivot", pa.int32()), ("d0", pa.float64()), ("d1", pa.float64()), ("ids", pa.list_(pa.int64())), ("units", pa.binary()),
    ("dists", pa.list_(pa.struct([("pivot", pa.int32()), ("d0", pa.float64()), ("d1", pa.float64())]))),
])
_FOUND = "query_id long, vec_id long, similarity double, compared long"


def _compared(k: int, floor: float, pivots: np.ndarray):
    """Of rows with a group of queries (q_...) and a block (b_...): each query's k nearest in the block that reach the floor and what it
    has already, and one row that counts the pairs that were compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one pair of blocks as Python's values at a time
                row = batch.slice(at, 1).to_pylist()[0]
                q, b = (np.frombuffer(row[f"{s}_units"]).reshape(-1, row["dim"]) for s in "qb")
                least = np.array([max(floor, known.get(i, -2.0)) for known in [dict(row["known"] or [])] for i in row["q_ids"]])
                d = _from_pivots(q, pivots[row["pivot"] : row["pivot"] + 1])[:, 0]
                apart = np.maximum(0.0, np.maximum(d - row["d1"], row["d0"] - d) - 1e-6)
                on = np.flatnonzero(1 - apart * apart / 2 >= least - 1e-9)  # the others' triangle leaves nothing near enough
                ids, out = np.array(row["b_ids"], np.int64), []
                near = np.round(q[on] @ b.T, PLACES)
                for i, line in zip(on.tolist(), near, strict=True):
                    hit = np.flatnonzero(line >= round(least[i], PLACES))
                    hit = hit[np.lexsort((ids[hit], -line[hit]))][:k]
                    out += [(row["q_ids"][i], v, s, None) for v, s in zip(ids[hit].tolist(), line[hit].tolist(), strict=True)]
                out.append((None, None, None, len(on) * len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "vec_id", "similarity", "compared"])

    return run


def _means(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of x that are far from each other."""
    if not len(x):
        return np.zeros((1, max(1, x.shape[1])))
    picked, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(x)) and far.max() > 1e-12:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


class Index:
    """Unit vectors in blocks of one kind, one nearest pivot and about one distance from it, stored. Pivots are chosen from a sample by
    hash and far from each other; they decide how much a search compares, never what it finds."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS):
        """vectors: vec_id, embedding and, if documents are of kinds, doc_kind."""
        spark = vectors.sparkSession
        kind = F.col("doc_kind").cast("string") if "doc_kind" in vectors.columns else F.lit(None).cast("string")
        rows = written(vectors.select(F.col("vec_id").cast("long"), "embedding", kind).mapInArrow(_units, "id long, kind string, dim int, unit binary"), "units")
        some = rows.select("dim", "unit").dropDuplicates(["unit"]).orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE).collect()
        x = np.zeros((len(some), max((r.dim for r in some), default=1)))
        for i, r in enumerate(some):
            x[i, : r.dim] = np.frombuffer(bytes(r.unit))
        self.pivots, self.rows, self.spark = _means(x, pivots), rows, spark
        self.blocks = written(self._sorted(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_packed(BLOCK, ["dim", "kind", "pivot"], self.pivots), _PACK).drop("dists"), "vector-blocks")

    def _sorted(self, rows: DataFrame, parts: int) -> DataFrame:
        keyed = rows.mapInArrow(_keyed(self.pivots), "id long, kind string, dim int, unit binary, pivot int, dist double")
        order = ["dim", "kind", "pivot", "dist", "id"]
        return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def search(self, queries: DataFrame, k: int = 3, floor: float = 0.0) -> tuple[DataFrame, DataFrame]:
        """(query_id, vec_id, similarity, rank) of queries (query_id, query and, to ask documents of one kind alone, doc_kind; null asks
        all), and one row with the number of pairs that were compared. Groups of queries first meet the blocks that may hold the
        nearest vectors, then those that can still hold nearer ones than were found."""
        kind = F.col("doc_kind").cast("string") if "doc_kind" in queries.columns else F.lit(None).cast("string")
        asked = written(queries.select(F.col("query_id").cast("long"), "query", kind).mapInArrow(_units, "id long, kind string, dim int, unit binary"), "queries")
        groups = written(self._sorted(asked, max(1, -(-asked.count() // GROUP))).mapInArrow(_packed(GROUP, ["dim", "kind"], self.pivots), _PACK), "query-groups")
        each = groups.select(F.col("name").alias("group"), "dim", F.col("kind").alias("q_kind"), F.inline("dists")).withColumnsRenamed({"d0": "q0", "d1": "q1"})
        x = each.join(self.blocks.select(F.col("name").alias("block"), "dim", F.col("kind").alias("b_kind"), "pivot", "d0", "d1"), ["dim", "pivot"]).where("q_kind is null or q_kind = b_kind")
        apart = F.greatest(F.lit(0.0), F.col("q0") - F.col("d1") - 1e-6, F.col("d0") - F.col("q1") - 1e-6)
        x = x.withColumn("most", 1 - apart * apart / 2).where(F.col("most") >= floor - 1e-9)
        # the first sixteenth of a group's blocks, by what they may hold and then by how near their pivot is
        hope = x.withColumn("hope", F.col("most") - (F.col("q0") + F.col("d0")) / 64)
        cut = hope.groupBy("group").agg(F.percentile_approx("hope", F.lit(15 / 16), 1000).alias("cut"))
        pairs = written(hope.join(cut, "group").select("group", "block", "most", (F.col("hope") >= F.col("cut")).alias("early")), "block-pairs")
        found, met_by = None, pairs.groupBy("group").count().agg(F.max("count")).first()[0] or 0
        rounds = ("early", "not early") if met_by > FEW else ("true",)
        for turn in rounds:
            now = pairs.where(turn)
            asks = groups.select(F.col("name").alias("group"), "dim", F.col("ids").alias("q_ids"), F.col("units").alias("q_units"))
            if found is None:
                asks = asks.withColumn("known", F.lit(None).cast("map<bigint, double>"))
            else:
                full = found.where("rank is not null").groupBy("query_id").agg(F.when(F.count("*") == k, F.min("similarity")).otherwise(floor).alias("least"))
                member = groups.select(F.col("name").alias("group"), F.explode("ids").alias("query_id")).join(full, "query_id", "left")
                known = member.groupBy("group").agg(F.map_from_entries(F.collect_set(F.when(F.col("least").isNotNull(), F.struct("query_id", "least")))).alias("known"), F.min(F.coalesce("least", F.lit(floor))).alias("worst"))
                known = written(known, "known")
                asks = asks.join(known.drop("worst"), "group")
                now = now.join(known.drop("known"), "group").where("most >= worst - 1e-9")
            met = now.select("group", "block").join(asks, "group").join(self.blocks.select(F.col("name").alias("block"), "pivot", "d0", "d1", F.col("ids").alias("b_ids"), F.col("units").alias("b_units")), "block")
            got = met.select("dim", "q_ids", "q_units", "known", "pivot", "d0", "d1", "b_ids", "b_units").mapInArrow(_compared(k, floor, self.pivots), _FOUND)
            if found is not None:
                got = got.unionByName(found.drop("rank"))
            by = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
            got = written(got, "found")
            best = got.where("query_id is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            counted = got.where("query_id is null").agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
            none = [F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("vec_id", "long"), ("similarity", "double"))]
            found = best.unionByName(counted.select(*none, "compared", F.lit(None).cast("int").alias("rank")))
        return best.drop("compared"), counted


def search(vectors: DataFrame, queries: DataFrame, k: int = 3, floor: float = 0.0) -> DataFrame:
    """(query_id, vec_id, similarity, rank): for each query (query_id, query) the k vectors (vec_id, embedding) of cosine at least floor
    that are nearest (ties: the smaller vec_id); none where nothing is near enough. With a doc_kind on both sides, a query with one
    finds only vectors of that kind. Null, zero and odd vectors and queries find nothing, nor do those of different lengths
    meet. Queries of one id are one query, which must have one vector. The plan is one, however many queries there are."""
    return Index(vectors).search(queries, k, floor)[0]


def retrieval_quality(found: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """One row: queries, the share with a relevant vector among the first k, and the mean reciprocal rank of the first one.
    relevant: (query_id, vec_id)."""
    first = found.join(relevant, ["query_id", "vec_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return _quality(relevant.select("query_id").distinct(), first, k)


def labelled_quality(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """retrieval_quality where vectors (vec_id, label) with the label of a query (query_id, label) are relevant to it, itself apart.
    The relevant pairs, whose number grows with the square of the rows, are not made: only what was found is compared."""
    wanted = queries.select("query_id", F.col("label").alias("wanted"))
    hits = found.join(wanted, "query_id").join(vectors.select("vec_id", "label"), "vec_id").where((F.col("label") == F.col("wanted")) & (F.col("vec_id") != F.col("query_id")))
    others = vectors.groupBy(F.col("label").alias("wanted")).agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))
    every = wanted.join(others, "wanted").where("low != query_id or high != query_id").select("query_id").distinct()
    return _quality(every, hits.groupBy("query_id").agg(F.min("rank").alias("rank")), k)


def _quality(every: DataFrame, first: DataFrame, k: int) -> DataFrame:
    every = every.join(first, "query_id", "left")
    return every.agg(F.count("*").alias("queries"), F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("recall_at_k"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def floor_calibration(top: DataFrame) -> DataFrame:
    """One row from (answerable, similarity) of each query's best vector: least answerable, most off-topic, and their gap."""
    low = F.min(F.when(F.col("answerable"), F.col("similarity")))
    high = F.max(F.when(~F.col("answerable"), F.col("similarity")))
    return top.agg(low.alias("answerable_min"), high.alias("off_topic_max"), (low - high).alias("gap"))
