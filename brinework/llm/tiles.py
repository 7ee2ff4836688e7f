"""Exact inner products of integer vectors in tiles of bounded size: what the top-k search and the mining of hard negatives share.

Vectors become integers floor(256 * x). Rows lie in blocks, those that ask in groups. An index gives for each pair of a group and a
block an interval that holds all their inner products; pairs whose interval cannot hold anything wanted are dropped, and the
others are scored exactly, the most promising first, in up to three rounds, after each of which what a group still wants is known
better. Within a task a block is skipped for every query whose own interval excludes it.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.llm import common

#: Rows of a block, queries of a group, blocks that a task scores in a row.
BLOCK, GROUP, RUN = 2048, 1024, 4
#: Groups that meet more blocks than this begin with the best 256th and 16th of them.
MANY = 64
#: Bytes of a component that 64 bits cannot hold: enough for any double times 256.
WIDE = 136
#: Relative error that bounds in floating point are allowed.
SLACK = 1e-9
#: Scores beyond 64 bits are kept to so many: Spark's decimals change their sign exactly up to 34 digits.
_MOST = 10**34 - 1


def _packed(x: np.ndarray) -> list[bytes]:
    """floor(256 * x) of each row of finite doubles, as little-endian integers of the smallest width of 2, 4, 8 or WIDE bytes that holds it."""
    big = np.abs(x).max(axis=1, initial=0.0)
    out: list[bytes | None] = [None] * len(x)
    with np.errstate(over="ignore"):
        y = np.floor(256.0 * x)
    for dtype, above, below in (("<i2", -1.0, 127.0), ("<i4", 127.0, 2.0**22), ("<i8", 2.0**22, 2.0**53)):
        rows = np.flatnonzero((big > above) & (big <= below))
        z = y[rows].astype(dtype)
        for i, v in zip(rows.tolist(), z, strict=True):
            out[i] = v.tobytes()
    for i in np.flatnonzero(big > 2.0**53).tolist():
        out[i] = b"".join((int(v) * 256 if abs(v) > 2.0**53 else int(np.floor(256 * v))).to_bytes(WIDE, "little", signed=True) for v in x[i].tolist())
    return out


def ints(blobs: list[bytes], dim: int) -> np.ndarray:
    """The integer vectors as rows: of 64 bits, or Python's integers where one is wider."""
    if not dim:
        return np.zeros((len(blobs), 0), np.int64)
    widths = np.array([len(b) // dim for b in blobs])
    out = np.empty((len(blobs), dim), object if (widths == WIDE).any() else np.int64)
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        data = b"".join([blobs[i] for i in rows])
        if w == WIDE:
            out[rows] = np.array([int.from_bytes(data[i : i + w], "little", signed=True) for i in range(0, len(data), w)], object).reshape(-1, dim)
        else:
            out[rows] = np.frombuffer(data, f"<i{w}").reshape(-1, dim)
    return out


def floats(x: np.ndarray, unit: float) -> np.ndarray:
    """The vectors in units in which no component is over 1; all zero where unit is infinite."""
    if unit == np.inf:
        return np.zeros(x.shape)
    return x.astype(np.float64) / unit


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of a and b, exactly."""
    if a.dtype != object and b.dtype != object and a.shape[1]:
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
        if most < 2.0**53:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        if most < 2.0**62:
            return a @ b.T
    return a.astype(object) @ b.astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), np.int64)


def _integers():
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("asks", pa.bool_()), ("dim", pa.int32()), ("cls", pa.binary()), ("vec", pa.binary()), ("big", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
            for dim in np.unique(size[size >= 0]).tolist():
                rows = np.flatnonzero(size == dim)
                x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
                fine = np.isfinite(x).all(axis=1)  # a null component is NaN here
                rows, x = rows[fine], x[fine]
                if not len(rows):
                    continue
                vec, label = _packed(x), batch.column(2).take(pa.array(rows))
                cls = [hashlib.blake2b(v, digest_size=16, key=b"%d" % dim, salt=b"%x" % (n & 0xFFFFFFFFFFFFFFFF)).digest() for v, n in zip(vec, label.to_pylist(), strict=True)]
                kept = [c.take(pa.array(rows)) for c in (batch.column(0), batch.column(3))]
                yield pa.RecordBatch.from_arrays([kept[0], label, kept[1], pa.array(np.full(len(rows), dim, np.int32)), pa.array(cls, pa.binary()), pa.array(vec, pa.binary()), pa.array(np.abs(x).max(axis=1, initial=0.0))], schema=schema)

    return run


def integer_rows(vectors: DataFrame, asks: Column, label: Column | None = None) -> DataFrame:
    """(id, label, asks, dim, cls, vec, big) of each row of vectors (vec_id, embedding) that takes part, written. cls names the vector
    with its label, big is its largest component. Rows whose vector is null or holds null or non-finite components, or whose label is
    null, are left out."""
    label = F.lit(0).cast("long") if label is None else label.cast("long")
    x = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding", label.alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"))
    x = x.where("embedding is not null and label is not null")
    return common.written(x.mapInArrow(_integers(), "id long, label long, asks boolean, dim int, cls binary, vec binary, big double"), "integer-vectors")


def first_copies(rows: DataFrame, n: int) -> DataFrame:
    """Of equal vectors the first n rows by id: the others come after them in any ranking by score and id."""
    by = Window.partitionBy("cls").orderBy(F.col("id").asc_nulls_last())
    return rows.withColumn("copy", F.row_number().over(by)).where(F.col("copy") <= n).drop("copy")


class Scale:
    """Of all rows: the unit of floats, and whether scores need more than 64 bits."""

    def __init__(self, rows: DataFrame):
        big, dim, self.count = rows.agg(F.max("big"), F.max("dim"), F.count("*")).first()
        big, self.dim = big or 0.0, dim or 0
        self.wide = (256.0 * big + 1) * (256.0 * big + 1) * max(1, self.dim) >= 2.0**62
        self.unit = 256.0 * big + 1 if big < 1e140 else np.inf
        self.score = "decimal(38,0)" if self.wide else "long"
        self.arrow = pa.decimal128(38, 0) if self.wide else pa.int64()

    def scaled(self, score: Column) -> Column:
        return score.cast("double") / F.lit(self.unit) / F.lit(self.unit)


def sample(rows: DataFrame, n: int, scale: Scale) -> np.ndarray:
    """n different rows chosen by hash as floats, shorter ones filled with zeros: any point may serve as a pivot or a direction."""
    some = rows.select("cls", "dim", "vec").dropDuplicates(["cls"]).orderBy(F.xxhash64("cls"), "cls").limit(n).collect()
    out = np.zeros((len(some), scale.dim))
    for i, r in enumerate(some):
        out[i, : r.dim] = floats(ints([bytes(r.vec)], r.dim), scale.unit)[0]
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, most at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        differ = np.zeros(held.num_rows - 1, bool)
        for k in keys:
            column = held.column(k).to_numpy()
            differ |= column[1:] != column[:-1]
        start = 0
        for edge in [*(np.flatnonzero(differ) + 1).tolist(), None]:
            stop = held.num_rows if edge is None else edge
            while most and stop - start >= most:
                yield held.slice(start, most)
                start += most
            if edge is not None and edge > start:
                yield held.slice(start, edge - start)
                start = edge
        held = held.slice(start).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def cut(keys: list[str], most: int, best: int, header: Callable[[pa.Table], tuple[bytes, float]] | None = None):
    """Of rows sorted within their partition: adds to each its block (number of the partition, number in it), and to rows that ask
    their number within the partition and the best-th score in their block, among rows of the same label. With header, each block
    begins with a row of kind 2 that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, asked = TaskContext.get().partitionId(), 0, 0
        for t in runs(batches, keys, most):
            kind = t.column("kind").to_numpy()
            low: list[int | None] = [None] * len(kind)
            at, rows = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
            if len(at) and len(rows) >= best:
                dim, vec, label = int(t.column("dim")[0].as_py()), t.column("vec").to_pylist(), t.column("label").to_numpy()
                s = product(ints([vec[i] for i in at], dim), ints([vec[i] for i in rows], dim))
                for i, line in zip(at.tolist(), s, strict=True):
                    mine = np.sort(line[label[rows] == label[i]])
                    if len(mine) >= best:
                        low[i] = int(mine[-best])
            n = np.cumsum(kind == 1) - 1 + asked
            out = t.append_column("part", pa.array(np.full(len(kind), part, np.int64))).append_column("number", pa.array(np.full(len(kind), number, np.int64)))
            out = out.append_column("asked", pa.array(n.astype(np.int64))).append_column("low", pa.array([None if v is None else decimal.Decimal(max(-_MOST, min(_MOST, v))) for v in low], pa.decimal128(38, 0)))
            if header and len(rows):
                vec, radius = header(t)
                one = out.slice(0, 1)
                for name, value in (("kind", 2), ("vec", vec), ("dist", radius)):
                    k = one.schema.get_field_index(name)
                    one = one.set_column(k, one.schema.field(k), pa.array([value], one.schema.field(k).type))
                out = pa.concat_tables([one, out])
            yield from out.combine_chunks().to_batches()
            number, asked = number + 1, asked + int((kind == 1).sum())

    return run


def numbered(df: DataFrame, of: str, alias: str) -> DataFrame:
    """`of` counts from 0 in each part: as alias, it goes on from part to part. There are as many parts as the table had partitions."""
    ends = df.groupBy("part").agg((F.max(of) + 1).alias("n"))
    starts = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return df.join(starts, "part").withColumn(alias, F.col("before") + F.col(of)).drop("before")


def _limits(mode: str, marks: list[int], lows: list[int | None], low: int, high: int) -> list[tuple[int | None, int | None]]:
    """The scores wanted: at least the low, or between low and high percent of a mark (and at least its low)."""
    if mode == "top":
        return [(lows[0] if lows else None, None)]
    out = []
    for i, p in enumerate(marks):
        a = -((-low * p) // 100)
        known = lows[i] if lows and i < len(lows) else None
        out.append((a if known is None else max(a, known), (high * p) // 100))
    return out


class Search:
    """The queries of one group, what they want, and the best rows found so far."""

    def __init__(self, t: pa.Table, scale: Scale, k: int, relation: str, mode: str, low: int, high: int):
        dim = int(t.column("dim")[0].as_py())
        self.scale, self.k, self.relation, self.dim = scale, k, relation, dim
        self.x, self.label, self.cls = ints(t.column("vec").to_pylist(), dim), t.column("label").to_numpy(), np.array(t.column("cls").to_pylist(), object)
        self.f = floats(self.x, scale.unit)
        limits = [_limits(mode, [int(v) for v in m or []], [None if v is None else int(v) for v in lows or []], low, high) for m, lows in zip(t.column("marks").to_pylist(), t.column("lows").to_pylist(), strict=True)]
        kind = object if scale.wide else np.int64
        least, most = (-(10**400), 10**400) if scale.wide else (-(2**63), 2**63 - 1)
        self.query = np.array([i for i, w in enumerate(limits) for _ in w], np.int64)
        self.which = np.array([n for w in limits for n in range(len(w))], np.int64)
        self.lo = np.array([least if a is None else a for w in limits for a, _ in w], kind)
        self.hi = np.array([most if b is None else b for w in limits for _, b in w], kind)
        self.slot, self.score, self.id, self.nul, self.own = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
        self.compared = 0

    def _scaled(self, v: np.ndarray) -> np.ndarray:
        if self.scale.wide:
            v = np.array([float(max(-(10**300), min(10**300, x))) for x in v])
        return v.astype(np.float64) / self.scale.unit / self.scale.unit

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """For each query the least and the greatest score, in units, that it may still want."""
        lo, hi = np.full(len(self.x), np.inf), np.full(len(self.x), -np.inf)
        np.minimum.at(lo, self.query, self._scaled(self.lo))
        np.maximum.at(hi, self.query, self._scaled(self.hi))
        return lo, hi

    def block(self, t: pa.Table, least: np.ndarray, greatest: np.ndarray) -> None:
        """Scores the rows of a block for those queries whose bounds, in units, allow something wanted."""
        lo, hi = self.wanted()
        on = np.flatnonzero((greatest >= lo) & (least <= hi))
        if not len(on):
            return
        c = ints(t.column("vec").to_pylist(), self.dim)
        self.compared += len(on) * len(c)
        s = product(self.x[on], c)
        if self.scale.wide:
            s = np.maximum(np.minimum(s.astype(object), _MOST), -_MOST)
        label, id_ = t.column("label").to_numpy(), t.column("id")
        nul = np.array([v is None for v in id_.to_pylist()]) if id_.null_count else np.zeros(len(c), bool)
        id_, cls = id_.fill_null(2**63 - 1).to_numpy(), np.array(t.column("cls").to_pylist(), object)
        line = np.full(len(self.x), -1)
        line[on] = np.arange(len(on))
        slots = np.flatnonzero(line[self.query] >= 0)
        for first in range(0, len(slots), 256):
            some = slots[first : first + 256]
            q = self.query[some]
            near = s[line[q]]
            good = (near >= self.lo[some, None]) & (near <= self.hi[some, None])
            if self.relation != "any":
                good &= (self.label[q][:, None] == label[None, :]) == (self.relation == "same")
            a, b = np.nonzero(good.astype(bool))
            if len(a):
                self._keep(some[a], near[a, b], id_[b], nul[b], self.cls[q[a]] == cls[b])

    def _keep(self, slot, score, id_, nul, own) -> None:
        slot, score = np.concatenate((self.slot, slot)), np.concatenate((self.score, score))
        id_, nul, own = np.concatenate((self.id, id_)), np.concatenate((self.nul, nul)), np.concatenate((self.own, own.astype(bool)))
        rank = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
        order = np.lexsort((id_, nul, -rank, slot))
        first = np.searchsorted(slot[order], slot[order])
        place = np.arange(len(order)) - first
        order = order[place < self.k]
        self.slot, self.score, self.id, self.nul, self.own = slot[order], score[order], id_[order], nul[order], own[order]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.lo[self.slot[full]] = np.maximum(self.lo[self.slot[full]], self.score[full])

    def found(self) -> pa.RecordBatch:
        score = [decimal.Decimal(max(-_MOST, min(_MOST, v))) for v in self.score] if self.scale.wide else self.score
        return pa.RecordBatch.from_arrays(
            [pa.array(self.cls[self.query[self.slot]], pa.binary()), pa.array(self.which[self.slot].astype(np.int32)), pa.array(score, self.scale.arrow), pa.array(self.id, mask=self.nul), pa.array(self.own)],
            names=["cls", "which", "score", "id", "own"],
        )


def _scored(bounds: Callable, scale: Scale, k: int, relation: str, mode: str, low: int, high: int):
    """Of rows sorted by unit: its queries (kind 0), then blocks: a header (kind 1) or none, and rows (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, header = None, None
        for t in runs(batches, ["qb", "unit", "block", "kind"]):
            kind = t.column("kind")[0].as_py()
            if kind == 0:
                if search is not None and len(search.slot):
                    yield search.found()
                search = Search(t, scale, k, relation, mode, low, high)
            elif kind == 1:
                header = t
            else:
                search.block(t, *bounds(search, t, header))
        if search is not None and len(search.slot):
            yield search.found()

    return run


_UNIT_ROW = ["qb", "unit", "ord", "block", "kind", "id", "label", "dim", "cls", "vec", "marks", "lows", "pivot", "dist"]


def best(queries: DataFrame, rows: DataFrame, pairs: DataFrame, bounds: Callable, scale: Scale, k: int, relation: str = "any", mode: str = "top", low: int = 0, high: int = 0) -> DataFrame:
    """(cls, which, score, id, own): for each query class the first k rows by score and id, for each of its marks in mode "band".

    queries: qb, label, dim, cls, vec, marks, lows (arrays of scores); rows: block, kind (1 a header, 2 a row), id, label, dim, cls,
    vec, pivot, dist; pairs: qb, block, least, greatest, a bound in units for all scores between them."""
    spark = queries.sparkSession
    many = pairs.groupBy("qb").agg(F.count("*").alias("n"), F.percentile_approx("greatest", F.array(F.lit(1 - 1 / 256), F.lit(1 - 1 / 16)), 1000).alias("p"))
    turn = F.when(F.col("n") <= MANY, 2).when(F.col("greatest") >= F.col("p")[0], 0).when(F.col("greatest") >= F.col("p")[1], 1).otherwise(2)
    pairs = common.written(pairs.join(many, "qb").select("qb", "block", "least", "greatest", turn.alias("turn")), "block-pairs")
    found, queries0 = None, queries
    for n in sorted(r.turn for r in pairs.select("turn").distinct().collect()):
        now = pairs.where(F.col("turn") == n)
        if found is not None:
            full = found.groupBy("cls", "which").agg(F.count("*").alias("n"), F.min("score").alias("s"))
            full = full.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("which", F.expr(f"case when n = {k} then s end")))).alias("known"))
            width = F.lit(1) if mode == "top" else F.size("marks")
            lows = F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda i: F.greatest(F.get("lows", i), F.try_element_at("known", i))))
            queries = common.written(queries0.join(full, "cls", "left").withColumn("lows", lows).select(queries0.columns), "group-queries")
            want = wanted(queries, scale, mode, low, high)
            now = now.join(want, "qb").where("greatest >= want_lo and least <= want_hi")
        sizes = now.groupBy("qb").agg(F.ceil(F.count("*") / RUN).alias("units"))
        now = common.written(now.join(sizes, "qb").select("qb", "block", F.pmod(F.xxhash64("block"), "units").alias("unit"), (-F.col("greatest")).alias("ord")), "units")
        units = now.select("qb", "unit").distinct()
        ask = queries.join(units, "qb").select("*", F.lit(float("-inf")).alias("ord"), F.lit(-1).cast("long").alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("pivot"), F.lit(None).cast("double").alias("dist"))
        ans = rows.join(now, "block").select("*", *[F.lit(None).cast(f"array<{scale.score}>").alias(c) for c in ("marks", "lows")])
        x = ask.select(_UNIT_ROW).unionByName(ans.select(_UNIT_ROW)).repartition(common.partitions(spark), "qb", "unit").sortWithinPartitions("qb", "unit", "ord", "block", "kind", "dist")
        got = x.mapInArrow(common.trimmed(_scored(bounds, scale, k, relation, mode, low, high)), f"cls binary, which int, score {scale.score}, id long, own boolean")
        got = got if found is None else got.unionByName(found)
        by = Window.partitionBy("cls", "which").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        found = common.written(got.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).drop("place"), "best")
    if found is None:
        return spark.createDataFrame([], f"cls binary, which int, score {scale.score}, id long, own boolean")
    return found


def wanted(queries: DataFrame, scale: Scale, mode: str, low: int, high: int) -> DataFrame:
    """(qb, want_lo, want_hi): the scores, in units, that any query of the group may still want."""
    slack = SLACK * max(1, scale.dim)
    if mode == "top":
        lo = F.coalesce(scale.scaled(F.col("lows")[0]), F.lit(float("-inf")))
        hi = F.lit(float("inf"))
    else:
        at = F.transform("marks", lambda p, i: F.greatest(p.cast("double") * low / 100, F.coalesce(F.get("lows", i).cast("double"), F.lit(float("-inf")))) - 1)
        lo, hi = scale.scaled(F.array_min(at)), scale.scaled(F.array_max(F.transform("marks", lambda p: p.cast("double") * high / 100)))
    return queries.groupBy("qb").agg((F.min(lo) - slack).alias("want_lo"), (F.max(hi) + slack).alias("want_hi"))


def without_own(asking: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(asker, cls, rank, score, id): for each row of asking (id, cls) the first k of its class's k + 1, itself left out."""
    tops = found.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("nul"), "id", "score", "own"))).alias("top"))
    tops = common.written(tops, "class-best")  # so that Spark can split a class that very many rows share
    mine = F.filter(F.transform("top", lambda t, i: F.when(t["own"] & t["id"].eqNullSafe(F.col("asker")), i)), lambda i: i.isNotNull())
    x = asking.select(F.col("id").alias("asker"), "cls").join(tops, "cls").withColumn("at", F.get(mine, F.lit(0)))
    x = x.withColumn("top", F.slice(F.filter("top", lambda t, i: F.col("at").isNull() | (i != F.col("at"))), 1, k))
    return x.select("asker", "cls", F.posexplode("top").alias("rank", "t")).select("asker", "cls", (F.col("rank") + 1).alias("rank"), F.col("t.score").alias("score"), F.col("t.id").alias("id"))
