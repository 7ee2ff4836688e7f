"""Embedding near-duplicates by E8 lattice hashing.

In each of TABLES tables a vector is projected at random to eight dimensions and decoded to its nearest point of the E8 lattice;
that cell and the next nearest neighbouring cells are its buckets. Two vectors meet if they share a bucket, and are linked if
their cosine in double precision is high enough. With the defaults a pair of 64 dimensions at cosine 0.9 exactly meets with
probability 0.98 or more, one at 0.92 with 0.995, and closer ones more surely (measured on planted pairs, as a test does); pairs
are never linked below the threshold.

Equal vectors are one class with a count. A bucket's members meet in blocks of bounded size, each in a task of its own: every pair must be
compared, since links are counted, but a bucket's n members move only n / BLOCK times each. What
leaves is a number of links for each member and only links that join components. A pair that shares several buckets is
counted in the one with the smallest name. Buckets with one member are dropped before any vector is moved.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm import common
from brinework.llm.components import components

TABLES, CELLS, SCALE, BLOCK = 8, 6, 1.0, 4096

_ROOTS = np.array([v for v in itertools.product((-1.0, 0.0, 1.0), repeat=8) if sum(map(abs, v)) == 2] + [v for v in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0])


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum (D8)."""
    r = np.rint(y)
    d = y - r
    k = np.abs(d).argmax(axis=1)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    r[odd, k[odd]] += np.where(d[odd, k[odd]] >= 0, 1, -1)
    return r


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points: of D8 or of D8 shifted by a half."""
    a, b = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def buckets(x: np.ndarray, tables: int = TABLES, cells: int = CELLS, scale: float = SCALE) -> np.ndarray:
    """For each unit vector its tables * cells bucket names (64-bit), ascending."""
    out = np.empty((len(x), tables * cells), np.int64)
    step = np.random.default_rng(3).integers(1, 2**62, 8, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
    for t in range(tables):
        rng = np.random.default_rng((x.shape[1], t))
        y = x @ rng.normal(0, scale, (x.shape[1], 8)) + rng.uniform(0, 2, 8)
        home = decode(y)
        gain = (y - home) @ _ROOTS.T - (_ROOTS**2).sum(axis=1) / 2
        near = np.argsort(-gain, axis=1, kind="stable")[:, : cells - 1]
        for c in range(cells):
            point = home if c == 0 else home + _ROOTS[near[:, c - 1]]
            h = (np.rint(2 * point).astype(np.int64).view(np.uint64) * step).sum(axis=1)
            out[:, t * cells + c] = common.mix(h + np.uint64((t + 1) * 0x9E3779B97F4A7C55 % 2**64) + np.uint64(x.shape[1])).view(np.int64)
    out.sort(axis=1)
    return out


def _unit(blobs: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers would overflow or vanish
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _classes(dtype: str):
    schema = pa.schema([("vec_id", pa.int64()), ("cls", pa.binary()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, vec = [], []
            for v in batch.column(1):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False) + 0.0
                    x = x.astype(dtype) if np.isfinite(x).all() and np.abs(x).max() > 0 else None
                vec.append(None if x is None else x.tobytes())
                cls.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(vec, pa.binary())], schema=schema)

    return run


def _bucketed(dtype: str, tables: int, cells: int, scale: float):
    schema = pa.schema([("cls", pa.binary()), ("bucket", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            cls, vec = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, v in enumerate(vec):
                by_size.setdefault(len(v), []).append(i)
            for rows in by_size.values():
                for s in range(0, len(rows), 2000):
                    part = rows[s : s + 2000]
                    names = buckets(_unit([vec[i] for i in part], dtype), tables, cells, scale)
                    yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in part for _ in range(names.shape[1])], pa.binary()), pa.array(names.ravel())], schema=schema)

    return run


class _Links:
    """Links among some rows (x: unit vectors): counted once for each pair, and as a forest."""

    def __init__(self, x: np.ndarray, bucket: np.ndarray, cls: list[bytes], mult: np.ndarray, shape: tuple[int, int, float]):
        self.x, self.bucket, self.cls, self.mult, self.shape = x, bucket, cls, mult, shape
        self.linked, self.forest = np.zeros(len(x), np.int64), []
        self.root = np.arange(len(x))

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the components of the pairs; a link of the forest for each that is new."""
        ra, rb = self.root[a], self.root[b]
        on = np.flatnonzero(ra != rb)
        if not len(on):
            return
        _, first = np.unique(ra[on] * len(self.root) + rb[on], return_index=True)
        parent: dict[int, int] = {}

        def top(i: int) -> int:
            while (p := parent.setdefault(i, i)) != i:
                parent[i] = i = parent[p]
            return i

        for k in on[first].tolist():
            if (p := top(int(ra[k]))) != (q := top(int(rb[k]))):
                parent[p] = q
                self.forest.append((self.cls[int(a[k])], self.cls[int(b[k])]))
        now = np.arange(len(self.root))
        now[list(parent)] = [top(i) for i in parent]
        self.root = now[self.root]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of rows of one bucket that are near enough."""
        if not len(a):
            return
        self._join(a, b)
        used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        names = buckets(self.x[used], *self.shape)
        na, nb = np.split(at, 2)
        here = np.ones(len(a), bool)  # whether no smaller bucket holds both
        for k in range(0, names.shape[1], 4):
            on = np.flatnonzero(here & (names[na, k] < self.bucket[a]))
            if not len(on):
                break
            for t in range(0, len(on), 8192):
                o = on[t : t + 8192]
                mine = names[na[o], k : k + 4]
                both = (mine[:, :, None] == names[nb[o]][:, None, :]).any(axis=2) & (mine < self.bucket[a[o], None])
                here[o[both.any(axis=1)]] = False
        np.add.at(self.linked, a[here], self.mult[b[here]])
        np.add.at(self.linked, b[here], self.mult[a[here]])


#: Groups up to this size are compared many at once.
SMALL = 24


def _meet(dtype: str, shape: tuple[int, int, float], threshold: float):
    """Of rows sorted by (size, bucket, bi, bj): (cls, n, other), links that each member has here and links that join components."""
    schema = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("other", pa.binary())])

    def of(table: pa.Table) -> pa.RecordBatch:
        bucket, bi, bj, size, side, mult = (table.column(k).to_numpy() for k in ("bucket", "bi", "bj", "size", "side", "mult"))
        x = _unit(table.column("vec").to_pylist(), dtype)
        group = np.cumsum(np.concatenate(([0], (bucket[1:] != bucket[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]))))
        links = _Links(x, bucket, table.column("cls").to_pylist(), mult, shape)
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        count = np.diff(np.append(start, len(group)))
        small = np.repeat(count <= SMALL, count)
        across = bi != bj
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(1, min(SMALL, int(count.max()))):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[d:] & ~(across[d:] & (side[d:] == side[:-d])))
            near = np.einsum("ij,ij->i", x[i], x[i + d]) >= threshold
            found.append((i[near], i[near] + d))
        if found:
            links.add(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        for s, n in zip(start[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
            index = np.arange(s, s + n)
            left, right = (index[side[index] == 0], index[side[index] == 1]) if across[s] else (index, index)
            for t in range(0, len(left), 256):
                near = x[left[t : t + 256]] @ x[right].T >= threshold
                if not across[s]:
                    near &= left[t : t + 256, None] < right
                a, b = np.nonzero(near)
                links.add(left[t : t + 256][a], right[b])
        some = np.flatnonzero(links.linked)
        cls = [links.cls[i] for i in some] + [u for u, _ in links.forest]
        n = [*links.linked[some].tolist(), *[0] * len(links.forest)]
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array([*[None] * len(some), *[v for _, v in links.forest]], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(k).to_numpy() for k in ("bucket", "bi", "bj", "size")]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(ends) and len(keys[0]) >= 4096:  # whole groups only; vectors of different lengths apart
                stop = int(ends[-1])
                cuts = [0, *(c for c in (np.flatnonzero(keys[3][1:] != keys[3][:-1]) + 1).tolist() if c < stop), stop]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield of(held.slice(a, b - a))
                held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            size = held.column("size").to_numpy()
            cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield of(held.slice(a, b - a))

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, cells: int = CELLS, scale: float = SCALE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding: array of float or double).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different lengths
    do not link. Repeated rows each count as a vector. component_id is the smallest vec_id of the component.
    """
    dtype = "<f8" if "double" in dict(vectors.dtypes)["embedding"] else "<f4"
    spark = vectors.sparkSession
    rows = common.written(vectors.select("vec_id", "embedding").mapInArrow(_classes(dtype), "vec_id long, cls binary, vec binary"), "vectors")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"), F.first("vec").alias("vec"))
    classes = common.written(classes, "vector-classes")
    members = classes.select("cls", "vec").repartition(common.partitions(spark)).mapInArrow(_bucketed(dtype, tables, cells, scale), "cls binary, bucket long").distinct()
    members = common.written(members, "vector-buckets")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    x = members.join(sizes, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    x = x.select("bucket", "cls", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    group = ["bucket", "bi", "bj"]
    x = x.join(classes.select("cls", "mult", "vec", F.octet_length("vec").alias("size")), "cls")
    x = x.repartition(common.partitions(spark), *group).sortWithinPartitions("size", *group)
    met = common.written(x.mapInArrow(_meet(dtype, (tables, cells, scale), threshold), "cls binary, n long, other binary"), "vector-links")
    roots = components(met.where("other is not null").select(F.col("cls").alias("u"), F.col("other").alias("v")))
    counts = met.where("other is null").groupBy("cls").agg(F.sum("n").alias("n"))
    named = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "first", "mult", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    done = named.join(least, "root").join(counts, "cls", "left").select("cls", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cls").join(done, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
