"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gets a signature of `k` symbols of 16 bits, one per hash function: each symbol agrees for
two sets with probability about their Jaccard similarity. The signature is split into `k_chunks` chunks. Two signatures that
differ in at most `radius` symbols differ in at most floor(radius / k_chunks) symbols of some chunk (pigeonhole), so
enumerating the symbols that may be wrong in each chunk, and joining on the rest, finds every pair within the radius.
Candidates within the radius are confirmed on the full sets.

Scale: documents with equal sets become one class before any join. A key's members hang on its most popular member, the one
whose keys hold most members in all, which in a group of near copies is the one that they were made from; so a group of n near
copies makes about n candidates. Only keys that still hold several components after that are expanded. There the largest
component's members meet the rest, and the rest each other, in blocks of bounded size; members of one component are not
compared, so a key with n members of one component and r others moves about n + r rows, not n * n. Joins that a hot key could
slow down read both sides from written tables, so that Spark splits the key between tasks.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinework.llm import common
from brinework.llm.components import components

K, CHUNKS, RADIUS = 48, 11, 21
#: Members of a mixed key, and shingles in their sets, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """For each document its distinct n-word shingles as sorted 64-bit hashes; fewer words make one shingle, no words none."""
    out = []
    if len(words) >= n:
        joined = words[: len(words) - n + 1] * _STEP[0]
        for k in range(1, n):
            joined += words[k : len(words) - n + 1 + k] * _STEP[k]
        joined = common.mix(joined)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s >= n:
            x = np.sort(joined[s : e - n + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif e > s:
            mixed = common.mix((words[s:e] * _STEP[: e - s]).sum(keepdims=True) + np.uint64(e - s))
            out.append(mixed)
        else:
            out.append(words[:0])
    return out


def set_name(shingles: np.ndarray) -> bytes | None:
    """128 bits that equal sets share: two independent sums. None for the empty set."""
    return np.array([shingles.sum(), common.mix(shingles).sum()], np.uint64).tobytes() if len(shingles) else None


def signature(shingles: np.ndarray, k: int = K) -> bytes:
    """k MinHash symbols of 16 bits."""
    x = (shingles >> np.uint64(17)).astype(np.uint32)
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 2048):
        part = x[s : s + 2048]
        np.minimum(least, (_A[:k, None] * part[None, :] + _B[:k, None]).min(axis=1), out=least)
    return (common.mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16).tobytes()


def _sketch(shingle: int, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, cls, sig = common.as_bytes(batch.column(1)), [], [], []
            for _, _, words, bounds in common.hashed_words(texts):
                for x in shingle_hashes(words, bounds, shingle):
                    n.append(len(x))
                    cls.append(set_name(x))
                    sig.append(signature(x, k) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], schema=schema)

    return run


def _masks(k: int, chunks: int, radius: int) -> list[list[int]]:
    """The symbols that stay in each key: each chunk without each choice of floor(radius / chunks) symbols."""
    out = []
    for part in np.array_split(np.arange(k), chunks):
        wrong = min(radius // chunks, len(part) - 1)
        out += [[int(i) for i in part if i not in gone] for gone in itertools.combinations(part.tolist(), wrong)]
    return out


def _mask_keys(sig: np.ndarray, masks: list[list[int]]) -> np.ndarray:
    """For each mask, the key of each signature (symbols as 64-bit integers)."""
    out = np.empty((len(masks), len(sig)), np.uint64)
    for number, mask in enumerate(masks):
        h = np.full(len(sig), number + 1, np.uint64)
        for i in mask:
            h = common.mix(h * _STEP[1] + sig[:, i] + np.uint64(1))
        out[number] = h
    return out


@functools.cache
def _mask_tables(k: int, chunks: int, radius: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which symbols each mask holds (k by masks), and the masks of each length: their numbers and symbols."""
    masks = _masks(k, chunks, radius)
    held = np.zeros((k, len(masks)), np.float32)
    by_length: dict[int, list[int]] = {}
    for number, mask in enumerate(masks):
        held[mask, number] = 1
        by_length.setdefault(len(mask), []).append(number)
    return held, [(np.array(numbers), np.array([masks[n] for n in numbers])) for numbers in by_length.values()]


def _number_of(key: int, sig: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """The mask under which one signature has the key."""
    for numbers, symbols in tables:
        h = (numbers + 1).astype(np.uint64)
        for j in range(symbols.shape[1]):
            h = common.mix(h * _STEP[1] + sig[symbols[:, j]] + np.uint64(1))
        at = np.flatnonzero(h.view(np.int64) == key)
        if len(at):
            return int(numbers[at[0]])
    raise ValueError("a signature lacks its key")


def _keys(k: int, chunks: int, radius: int, again: bool):
    """Rows (key, cls). A key that a batch holds several times is sent on once (again: its members are given instead)."""
    masks = _masks(k, chunks, radius)
    schema = pa.schema([("key", pa.int64()), ("cls", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cls = np.array(batch.column(0).to_pylist(), dtype=object)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, k).astype(np.uint64)
            rank = np.empty(len(cls), np.int64)
            rank[np.argsort(cls)] = np.arange(len(cls))
            for h in _mask_keys(sig, masks):
                order = np.lexsort((rank, h))
                s = h[order]
                new = np.concatenate(([True], s[1:] != s[:-1]))
                size = np.diff(np.append(np.flatnonzero(new), len(s)))
                many = np.repeat(size > 1, size)
                keep = many if again else new
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), pa.array(cls[order[keep]].tolist(), pa.binary())], schema=schema)

    return run


def _distance(a: list[bytes], b: list[bytes]) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(v), np.uint16).reshape(len(v), -1) for v in (a, b))
    return (x != y).sum(axis=1)


def _near(radius: int, percent: int):
    """Of rows (a, b, na, nb, siga, sigb), those whose signatures are within the radius and whose sizes allow the similarity."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                keep = (_distance(batch.column(4).to_pylist(), batch.column(5).to_pylist()) <= radius) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], schema=schema)

    return run


def _sets(shingle: int):
    """Of rows (cls, text), the sets of the texts that the class is named after; a repeated doc_id may bring others."""
    schema = pa.schema([("cls", pa.binary()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_bytes(batch.column(1))
            for first, last, words, bounds in common.hashed_words(texts):
                sets = shingle_hashes(words, bounds, shingle)
                own = [set_name(x) == c for x, c in zip(sets, batch.column(0).slice(first, last - first).to_pylist(), strict=True)]
                items = pa.array([x.tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).filter(pa.array(own)), items.filter(pa.array(own))], schema=schema)

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Of rows (a, b, ia, ib), the pairs whose full sets are similar enough."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, (ia, ib) = [], (batch.column(c) for c in (2, 3))
            for i in range(batch.num_rows):
                keep.append(_similar(*(np.frombuffer(c[i].as_buffer(), np.uint64) for c in (ia, ib)), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

    return run


class _Group:
    """The members of one block pair of a mixed key, and the pairs in it that are still to be compared: across components, within
    the radius, of a size that allows the similarity, and sharing no earlier key (so that no pair is compared under two keys)."""

    def __init__(self, rows, k: int, chunks: int, radius: int, percent: int):
        import pandas as pd

        held, tables = _mask_tables(k, chunks, radius)
        self.sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), k)
        self.n, self.side = rows["n"].to_numpy(), rows["side"].to_numpy()
        self.root = pd.factorize(rows["root"])[0]
        self.same = bool(rows["bi"].iloc[0] == rows["bj"].iloc[0])
        self.percent, self.radius = percent, radius
        self.earlier = held[:, : _number_of(int(rows["key"].iloc[0]), self.sig[0].astype(np.uint64), tables)]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        index = np.arange(len(self.n))
        left, right = (index, index) if self.same else (index[self.side == 0], index[self.side == 1])
        for s in range(0, len(left), 64):
            i = left[s : s + 64, None]
            near = (self.root[i] != self.root[right]) & (100 * np.minimum(self.n[i], self.n[right]) >= self.percent * np.maximum(self.n[i], self.n[right]))
            if self.same:
                near &= i < right
            a, b = np.nonzero(near)
            a, b = i[a, 0], right[b]
            for t in range(0, len(a), 1 << 16):
                x, y = a[t : t + (1 << 16)], b[t : t + (1 << 16)]
                agree = self.sig[x] == self.sig[y]
                keep = agree.shape[1] - agree.sum(axis=1) <= self.radius
                x, y, agree = x[keep], y[keep], agree[keep]
                if self.earlier.shape[1] and len(x):
                    first = ~(agree.astype(np.float32) @ self.earlier == self.earlier.sum(axis=0)).any(axis=1)
                    x, y = x[first], y[first]
                if len(x):
                    yield x, y


def _needed(k: int, chunks: int, radius: int, percent: int):
    """The members of a (key, bi, bj) group that have something to be compared with."""

    def run(rows):
        use = np.zeros(len(rows), bool)
        for x, y in _Group(rows, k, chunks, radius, percent).pairs():
            use[x] = use[y] = True
        return rows.loc[use]

    return run


def _inside(k: int, chunks: int, radius: int, percent: int):
    """Links that join the components of a (key, bi, bj) group, by its pairs' full sets: fewer than its members."""

    def run(rows):
        import pandas as pd

        group, sets = _Group(rows, k, chunks, radius, percent), [np.frombuffer(x, np.uint64) for x in rows["items"]]
        cls, parent, u, v = rows["cls"].to_numpy(), list(range(len(rows))), [], []

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        first = {}
        for i, r in enumerate(group.root.tolist()):
            parent[i] = first.setdefault(r, i)
        for xs, ys in group.pairs():
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                if (i := top(x)) != (j := top(y)) and _similar(sets[x], sets[y], percent):
                    parent[i] = j
                    u.append(cls[x])
                    v.append(cls[y])
        return pd.DataFrame({"u": u, "v": v})

    return run


def _class_sets(needed: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(cls, items): the full sets of the needed classes, from the texts of their first documents."""
    first = classes.join(needed, "cls", "left_semi").select("cls", F.col("first").alias("row_key"))
    texts = docs.join(first.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(first["row_key"])).select("cls", "text")
    sets = texts.mapInArrow(common.trimmed(_sets(shingle)), "cls binary, items binary")
    return common.written(sets.dropDuplicates(["cls"]), "near-sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (u, v): the pairs (a, b) that hold on the full sets of the classes' first documents."""
    needed = common.written(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "near-needed")
    sets = _class_sets(needed, classes, docs, shingle)
    x = pairs.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("ib")), "b")
    x = x.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("ia")), "a").select("a", "b", "ia", "ib")
    return x.mapInArrow(common.trimmed(_confirm(percent)), "u binary, v binary").distinct()


def _leaders(members: DataFrame) -> DataFrame:
    """(key, a): each key's most popular member (ties: the smallest)."""
    sizes = common.written(members.groupBy("key").agg(F.count("*").alias("c")), "near-sizes")
    popular = common.written(members.join(sizes, "key").groupBy("cls").agg(F.sum("c").alias("popular")), "near-popular")
    ranked = members.join(popular, "cls").select("key", F.struct((-F.col("popular")).alias("p"), F.col("cls")).alias("rank"))
    return common.written(ranked.groupBy("key").agg(F.min("rank").alias("top")).select("key", F.col("top.cls").alias("a")), "near-leaders")


def _block_pairs(labelled: DataFrame, side: DataFrame) -> DataFrame:
    """The members of keys that hold several components, once for each pair of blocks in which they are compared: blocks of the
    rest with blocks of the key's largest component (bj below 0 names those) and with each other."""
    side = side.select("cls", "n", "sig")
    parts = labelled.join(side.select("cls", "n"), "cls").groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    parts = common.written(parts, "near-parts")
    top = F.max(F.struct("c", "root"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("roots"), F.sum("c").alias("c"), F.sum("n").alias("n"), top.alias("top"), F.max_by("n", F.struct("c", "root")).alias("top_n")).where("roots > 1 and c > 2")
    blocks = lambda c, n: F.ceil(F.greatest(c / F.lit(BLOCK), n / F.lit(BLOCK_SHINGLES))).cast("int")
    mixed = mixed.select("key", F.col("top.root").alias("main"), blocks(F.col("top.c"), F.col("top_n")).alias("mains"), blocks(F.col("c") - F.col("top.c"), F.col("n") - F.col("top_n")).alias("rests"))
    x = labelled.join(common.written(mixed, "near-mixed-keys"), "key").join(side, "cls")
    is_main = F.col("root") == F.col("main")
    x = x.withColumn("own", F.pmod(F.xxhash64("cls"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    pair = lambda i, j, s: F.struct(i.alias("bi"), j.cast("int").alias("bj"), s.alias("side"))
    of_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda i: pair(i, -1 - F.col("own"), F.lit(1)))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: pair(F.col("own"), -1 - j, F.lit(0)))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: pair(F.least("own", k), F.greatest("own", k), F.when(F.col("own") <= k, 0).otherwise(1)))
    met = F.when(is_main, of_main).otherwise(F.concat(with_main, with_rest))
    return x.select("key", "cls", "root", "n", "sig", F.inline(met))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = K, chunks: int = CHUNKS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for documents linked at 100 * intersection >= percent * union.

    docs has doc_id and text; other columns are left alone. Null or empty texts, or texts without words, have no shingles and
    link with nothing; equal texts are one class. Repeated rows each get a row. A null doc_id never is a component's name
    unless all of the component is null, and is then kept as its own. Empty tables give empty tables.
    """
    return marked_duplicates(docs, shingle, percent, k, chunks, radius).select("doc_id", "n_shingles", "component_id", "kept")


def mark(text) -> F.Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def marked_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = K, chunks: int = CHUNKS, radius: int = RADIUS) -> DataFrame:
    """near_duplicates with the text's mark and `root`, which names the component where its doc_id does not: a doc_id may occur with
    several texts. root is null for texts without shingles."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    sketch = common.written(docs.select("doc_id", "text", mark(F.col("text")).alias("mark")).mapInArrow(common.trimmed(_sketch(shingle, k)), "doc_id long, mark long, n long, cls binary, sig binary"), "near-sketch")
    classes = sketch.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.first("sig").alias("sig"))
    classes = common.written(classes, "near-classes")

    keyed = "key long, cls binary"
    alone = classes.select("cls", "sig").mapInArrow(common.trimmed(_keys(k, chunks, radius, False)), keyed)
    inside = classes.select("cls", "sig").mapInArrow(common.trimmed(_keys(k, chunks, radius, True)), keyed)
    shared = alone.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1").select("key", "cls")
    members = common.written(shared.union(inside).distinct(), "near-members")

    pairs = members.join(_leaders(members), "key").where("cls != a").select("a", F.col("cls").alias("b")).distinct()
    side = classes.select("cls", "n", "sig")

    def within(pairs: DataFrame) -> DataFrame:
        x = pairs.join(side.toDF("b", "nb", "sigb"), "b").join(side.toDF("a", "na", "siga"), "a")
        return x.select("a", "b", "na", "nb", "siga", "sigb").mapInArrow(common.trimmed(_near(radius, percent)), "a binary, b binary")

    tested = common.written(within(common.written(pairs, "near-candidates")), "near-pairs")
    links = common.written(_confirmed(tested, classes, docs, shingle, percent), "near-links")
    roots = common.checkpointed(components(links))

    # keys that still hold several components: all pairs across those, in blocks
    labelled = members.join(roots, members["cls"] == roots["node"], "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    rest = _block_pairs(common.written(labelled, "near-labelled"), side)
    group, shape = ["key", "bi", "bj"], "key long, cls binary, root binary, n long, sig binary, bi int, bj int, side int"
    rest = rest.repartition(common.partitions(spark), *group).groupBy(*group)
    needed = common.written(rest.applyInPandas(_needed(k, chunks, radius, percent), shape), "near-mixed")
    if not needed.isEmpty():
        sets = _class_sets(common.written(needed.select("cls").distinct(), "near-needed"), classes, docs, shingle)
        more = needed.join(sets, "cls").repartition(common.partitions(spark), *group).groupBy(*group)
        more = more.applyInPandas(_inside(k, chunks, radius, percent), "u binary, v binary")
        links = common.written(links.union(more).distinct(), "near-links")
        roots = common.checkpointed(components(links))

    named = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = named.join(least, "root").select("cls", "root", "component_id")
    out = sketch.select("doc_id", "mark", "n", "cls").join(by_class, "cls", "left")
    out = out.select("doc_id", "mark", "root", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
