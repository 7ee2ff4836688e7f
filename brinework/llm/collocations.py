"""Phrase collocations: counts by minimal perfect hash.

A word, which its language is part of, has a 64-bit hash; the words table counts every word exactly and shows that no two share a
hash (else the next seed is taken). Candidates are Apriori-safe: a phrase counted `least` times or more has only words counted so,
and its bucket, counted over all documents, holds as much; both are asked of bit arrays that never deny a member. What passes is
summed within each mapper and dealt to shards by hash.

A shard has a minimal perfect hash over its candidates: a slot for each, where its words are stored. Mappers look up the slots of
their part of the shard's occurrences, compare the stored words, and add with numpy's bincount; their arrays are summed as a
tree. The cuts of a candidate are then read by slot: its parts, which are candidates themselves, are asked of their shards.

Bit arrays have at most BITS bits (16 MB) whatever the corpus: when it outgrows them, more phrases pass and are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.llm import common

#: Bits of a member array at most; candidates and bucket entries of a shard on average; occurrences that a mapper holds.
BITS, SHARD, BUCKETS, HELD = 1 << 27, 1 << 17, 1 << 21, 1 << 21
#: Packed rows that one mapper adds up, arrays that one sum takes, requests that one task answers, and places
#: to which a shard's requests are dealt before.
ROWS, FAN, ASKED, SALTS = 64, 32, 1 << 16, 64
#: Bits of a bucket's name.
BUCKET_BITS = 32

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_CUT
_WORD[[0x20, 0x09]] = False
_LOW = np.arange(256, dtype=np.int64)
_LOW[0x41:0x5B] += 0x20
_A, _B, _C = (np.uint64(v) for v in (0x9E6C63D0A8F2B1C5, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5))


def _lang_code(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, key=b"%d" % seed).digest(), "little")


def _marks(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word its length and two sums of its bytes, which have nothing to do with its hash."""
    low = _LOW[a]
    plain, placed = np.cumsum(low), np.cumsum(low * np.arange(len(a)))
    s = plain[ends - 1] - plain[starts - 1]
    return ((ends - starts) << 48) + (s << 24) + placed[ends - 1] - placed[starts - 1] - starts * s


def words_of(texts: list[bytes | None], langs: list[str], seed: int, marked: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, Callable[[int], tuple[str, str]]]]:
    """For runs of documents: the words' hashes, whether a word and its successor are in one piece, marks that words of one hash differ
    in, and a function from a word's number to its language and text."""
    codes = np.array([_lang_code(v, seed) for v in langs], np.uint64)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or b"") <= common.GROUP_BYTES):
            size += len(texts[last] or b"")
            last += 1
        run = [t or b"" for t in texts[first:last]]
        data = b"\n" + b"\n".join(run) + b"\n"
        a, starts, ends = common.word_spans(data, _WORD)
        if len(starts):
            doc = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in run)]), starts, "right") - 1
            h = common.mix(common.hash_spans(a, starts, ends) ^ codes[first + doc]) | np.uint64(1)
            piece = np.cumsum(_CUT[a])[starts]
            yield h, piece[1:] == piece[:-1], _marks(a, starts, ends) if marked else None, lambda i, data=data, s=starts, e=ends, d=doc, f=first: (langs[f + int(d[i])], data[s[i] : e[i]].lower().decode())
        first = last


def phrase_key(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> np.ndarray:
    """A 64-bit name of each phrase; a missing word is 0."""
    return common.mix(h1 * _A + h2 * _B + h3 * _C)


class Members:
    """A bit array that never denies a member."""

    def __init__(self, count: int):
        self.bits = 1 << 13
        while self.bits < min(BITS, 16 * count):
            self.bits *= 2

    def places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = common.mix(key.astype(np.uint64) + _C)
        return k & np.uint64(self.bits - 1), (k >> np.uint64(32)) & np.uint64(self.bits - 1)

    def has(self, array: np.ndarray, key: np.ndarray) -> np.ndarray:
        p, q = self.places(key)
        bit = lambda x: (array[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1
        return (bit(p) & bit(q)).astype(bool)

    def array(self, keys: DataFrame) -> np.ndarray:
        """The bits of keys (key: a long), set chunk by chunk in tasks; at most BITS bits come to the driver."""
        chunk_bits = 1 << 18
        spots = keys.select("key").mapInArrow(self._spots, "spot long").distinct()
        spots = spots.withColumn("chunk", F.expr(f"spot div {chunk_bits}"))
        out = np.zeros(self.bits // 8, np.uint8)
        chunks = spots.repartition(common.partitions(keys.sparkSession), "chunk").sortWithinPartitions("chunk").mapInArrow(_bitmaps(chunk_bits), "chunk long, bits binary")
        for r in common.written(chunks, "member-bits").toLocalIterator():
            part = np.frombuffer(bytes(r.bits), np.uint8)[: self.bits // 8]
            out[r.chunk * chunk_bits // 8 : r.chunk * chunk_bits // 8 + len(part)] |= part
        return out

    def _spots(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = self.places(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((p, q)).astype(np.int64))], names=["spot"])


def _bitmaps(chunk_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, np.zeros(chunk_bits, bool)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

        for batch in batches:
            spot, chunk = batch.column("spot").to_numpy(), batch.column("chunk").to_numpy()
            for c in np.unique(chunk).tolist():
                if now is not None and c != now:
                    yield done()
                    bits[:] = False
                now = c
                bits[spot[chunk == c] - c * chunk_bits] = True
        if now is not None:
            yield done()

    return run


# --- words ---


def _counted_words(seed: int):
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    def out(seen: dict[tuple[int, int], list]) -> pa.RecordBatch:
        h = np.fromiter((k for k, _ in seen), np.uint64, len(seen)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([v[1] for v in seen.values()], pa.string()), pa.array([v[2] for v in seen.values()], pa.string()), pa.array(h), pa.array([v[0] for v in seen.values()], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        for batch in batches:
            for h, _, mark, text in words_of(common.as_bytes(batch.column(0)), batch.column(1).to_pylist(), seed, marked=True):
                order = np.argsort(h, kind="stable")
                h, mark = h[order], mark[order]
                at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (mark[1:] != mark[:-1]))))
                for k, i, c in zip(zip(h[at].tolist(), mark[at].tolist(), strict=True), order[at].tolist(), np.diff(at, append=len(h)).tolist(), strict=True):
                    if (got := seen.get(k)) is None:
                        seen[k] = [c, *text(i)]
                    else:
                        got[0] += c
                if len(seen) > 1 << 19:
                    yield out(seen)
                    seen = {}
        if seen:
            yield out(seen)

    return run


def counted_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, h, n) of every word of docs (text, lang), written, and the seed under which no two words share a hash."""
    for seed in range(1, 16):
        local = docs.mapInArrow(common.trimmed(_counted_words(seed)), "lang string, word string, h long, n long")
        words = common.written(local.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return words, seed
    raise RuntimeError("words share hashes under every seed")


# --- candidates ---


class _Filter:
    """Which words, pairs and triples may be counted often enough, from broadcast bit arrays."""

    def __init__(self, spark: SparkSession, words: Members, word_bits: np.ndarray, buckets: Members | None = None, bucket_bits: np.ndarray | None = None):
        self.words, self.buckets = words, buckets
        self.word_bits = spark.sparkContext.broadcast(word_bits)
        self.bucket_bits = spark.sparkContext.broadcast(bucket_bits) if buckets else None

    def phrases(self, h: np.ndarray, joined: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(h1, h2, h3, key) of the pairs, then of the triples, that may be candidates."""
        often = self.words.has(self.word_bits.value, h)
        pair = joined & often[1:] & often[:-1]
        i = np.flatnonzero(pair)
        none = np.zeros(len(i), np.uint64)
        key = phrase_key(h[i], h[i + 1], none)
        if self.buckets:
            good = self._held(key)
            i, key, none = i[good], key[good], none[good]
            pair = np.zeros(len(pair), bool)
            pair[i] = True
        yield h[i], h[i + 1], none, key
        i = np.flatnonzero(pair[1:] & pair[:-1])
        key = phrase_key(h[i], h[i + 1], h[i + 2])
        if self.buckets:
            good = self._held(key)
            i, key = i[good], key[good]
        yield h[i], h[i + 1], h[i + 2], key

    def _held(self, key: np.ndarray) -> np.ndarray:
        return self.buckets.has(self.bucket_bits.value, key >> np.uint64(64 - BUCKET_BITS))


def _bucketed(keep: _Filter, seed: int, shards: int):
    """Packed rows of buckets and their counts up to 255, summed within the mapper."""
    schema = pa.schema([("shard", pa.int64()), ("bucket", pa.binary()), ("n", pa.binary())])

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        bucket, n = np.unique(np.concatenate(held), return_counts=True)
        n = np.minimum(n, 255).astype(np.uint8)
        edges = np.searchsorted(bucket, [(s << BUCKET_BITS) // shards for s in range(shards)] + [1 << BUCKET_BITS])
        some = [s for s in range(shards) if edges[s] < edges[s + 1]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([bucket[edges[s] : edges[s + 1]].tobytes() for s in some], pa.binary()), pa.array([n[edges[s] : edges[s + 1]].tobytes() for s in some], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for h, joined, *_ in words_of(common.as_bytes(batch.column(0)), batch.column(1).to_pylist(), seed):
                for *_, key in keep.phrases(h, joined):
                    held.append((key >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32 if BUCKET_BITS <= 32 else np.uint64))
                    size += len(key)
                if size > HELD:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    return run


def _sums(least: int):
    """The buckets of packed rows, sorted by shard, that reach `least` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.uint32 if BUCKET_BITS <= 32 else np.uint64
        now, key, n, held, waiting = None, np.zeros(0, dtype), np.zeros(0, np.int64), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            k = np.concatenate([key, *(a for a, _ in held)])
            c = np.concatenate([n, *(b for _, b in held)])
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
            return k[at], np.minimum(np.add.reduceat(c, at), least) if len(at) else c

        def done() -> pa.RecordBatch:
            k, c = added()
            return pa.RecordBatch.from_arrays([pa.array(k[c >= least].astype(np.uint64).view(np.int64))], names=["key"])

        for batch in batches:
            for shard, b, c in zip(batch.column("shard").to_pylist(), batch.column("bucket"), batch.column("n"), strict=True):
                if now is not None and shard != now:
                    yield done()
                    key, n, held, waiting = key[:0], n[:0], [], 0
                now = shard
                held.append((np.frombuffer(b.as_py(), dtype), np.frombuffer(c.as_py(), np.uint8).astype(np.int64)))
                waiting += len(held[-1][0])
                if waiting > BUCKETS + len(key):
                    key, n = added()
                    held, waiting = [], 0
        if now is not None:
            yield done()

    return run


# --- packed phrases: (shard, h1, h2, h3, n) as arrays ---

_PACKED = "shard long, h1 binary, h2 binary, h3 binary, n binary"
_PACKED_SCHEMA = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("h1", "h2", "h3", "n"))])


def summed(h1, h2, h3, n) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal phrases once, with the sum of their counts."""
    order = np.lexsort((h3, h2, h1))
    h1, h2, h3, n = h1[order], h2[order], h3[order], n[order]
    if not len(h1):
        return h1, h2, h3, n
    at = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (h3[1:] != h3[:-1]))))
    return h1[at], h2[at], h3[at], np.add.reduceat(n, at)


def _packed(h1, h2, h3, n, shards: int) -> pa.RecordBatch:
    h1, h2, h3, n = summed(h1, h2, h3, n)
    shard = (phrase_key(h1, h2, h3) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    some, start = np.unique(shard, return_index=True)
    cols = [[c[order][a:b].tobytes() for a, b in zip(start, [*start[1:], len(order)], strict=True)] for c in (h1, h2, h3, n)]
    return pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c, pa.binary()) for c in cols)], schema=_PACKED_SCHEMA)


def _phrases(keep: _Filter, seed: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            h1, h2, h3 = (np.concatenate(c) for c in zip(*held, strict=True))
            return _packed(h1, h2, h3, np.ones(len(h1), np.int64), shards)

        for batch in batches:
            for h, joined, *_ in words_of(common.as_bytes(batch.column(0)), batch.column(1).to_pylist(), seed):
                for h1, h2, h3, _ in keep.phrases(h, joined):
                    held.append((h1, h2, h3))
                    size += len(h1)
                if size > HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _single_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            none = np.zeros(len(h), np.uint64)
            yield _packed(h, none, none, batch.column("n").to_numpy(), shards)

    return run


# --- minimal perfect hash ---


class PerfectHash:
    """Slots 0 to n - 1 of n different phrases. In each level a phrase whose place no other has gets that bit; the others go on to the
    next level. The slot is the number of bits before its own; the words stored there tell whether the phrase is a member at all."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits, self.h = sizes, bits, (h1, h2, h3)
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @staticmethod
    def _place(h1, h2, h3, level: int, size: int) -> np.ndarray:
        turn = common.mix(np.array([level + 1], np.uint64))
        return (common.mix(common.mix(h1 * _B + turn) + common.mix(h2 * _C + turn) * _A + h3 * _A) % np.uint64(size)).astype(np.int64)

    @classmethod
    def built(cls, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> PerfectHash:
        left, sizes, bits = np.arange(len(h1)), [], [np.zeros(0, bool)]
        while len(left):
            size = max(64, 2 * len(left))
            place = cls._place(h1[left], h2[left], h3[left], len(sizes), size)
            count = np.bincount(place, minlength=size)
            sizes.append(size)
            bits.append(count == 1)
            left = left[count[place] != 1]
        out = cls(h1, h2, h3, sizes, np.concatenate(bits))
        slot = out._slots(h1, h2, h3)
        by_slot = np.argsort(slot)
        out.h = (h1[by_slot], h2[by_slot], h3[by_slot])
        return out

    def _slots(self, h1, h2, h3) -> np.ndarray:
        slot, left, offset = np.full(len(h1), -1), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            place = offset + self._place(h1[left], h2[left], h3[left], level, size)
            hit = self.bits[place]
            slot[left[hit]] = self.rank[place[hit]]
            left, offset = left[~hit], offset + size
        return slot

    def slots(self, h1, h2, h3) -> np.ndarray:
        """The slot of each phrase, -1 where the stored words are others."""
        slot = self._slots(h1, h2, h3)
        at = np.maximum(slot, 0)
        if len(self.h[0]):
            slot[(self.h[0][at] != h1) | (self.h[1][at] != h2) | (self.h[2][at] != h3)] = -1
        return slot

    def row(self) -> dict:
        return {"sizes": self.sizes, "bits": np.packbits(self.bits).tobytes(), **{f"k{i + 1}": h.tobytes() for i, h in enumerate(self.h)}}

    @classmethod
    def of(cls, row: dict) -> PerfectHash:
        return cls(*(np.frombuffer(row[k], np.uint64) for k in ("k1", "k2", "k3")), row["sizes"], np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool))


_HASH = "shard long, sizes array<long>, bits binary, k1 binary, k2 binary, k3 binary"
_HASH_SCHEMA = pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("k1", pa.binary()), ("k2", pa.binary()), ("k3", pa.binary())])


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], np.uint64) for c in ("h1", "h2", "h3"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows sorted by shard: each shard's perfect hash over its different phrases."""
    now, keys, held, waiting = None, tuple(np.zeros(0, np.uint64) for _ in range(3)), [], 0

    def merged():
        cols = [np.concatenate([k, *(h[i] for h in held)]) for i, k in enumerate(keys)]
        return summed(*cols, np.zeros(len(cols[0]), np.int64))[:3]

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"shard": now, **PerfectHash.built(*merged()).row()}], schema=_HASH_SCHEMA)

    for batch in batches:
        for row in batch.select(["shard", "h1", "h2", "h3"]).to_pylist():
            if now is not None and row["shard"] != now:
                yield done()
                keys, held, waiting = tuple(np.zeros(0, np.uint64) for _ in range(3)), [], 0
            now = row["shard"]
            held.append(_arrays(row))
            waiting += len(held[-1][0])
            if waiting > SHARD + len(keys[0]):
                keys, held, waiting = merged(), [], 0
    if now is not None:
        yield done()


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shard, part), a perfect hash and packed occurrences: an array of counts by slot for each part."""
    now, perfect, counts = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([counts.tobytes()], pa.binary())], names=["shard", "part", "counts"])

    for batch in batches:
        for row in batch.to_pylist():
            if now != (row["shard"], row["part"]):
                if now is not None:
                    yield done()
                now, perfect = (row["shard"], row["part"]), PerfectHash.of(row)
                counts = np.zeros(len(perfect.h[0]), np.int64)
                continue
            slot, n = perfect.slots(*_arrays(row)), np.frombuffer(row["n"], np.int64)
            member = slot >= 0
            if n.max(initial=0) < 2**40:  # bincount adds in double precision, which is exact below 2^53
                counts += np.bincount(slot[member], n[member], len(counts)).astype(np.int64)
            else:
                np.add.at(counts, slot[member], n[member])
    if now is not None:
        yield done()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of counts sorted by (shard, part), added up."""
    now, total = None, None
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["counts"], np.int64)
            if now == (row["shard"], row["part"]):
                total = total + counts
                continue
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([total.tobytes()], pa.binary())], names=["shard", "part", "counts"])
            now, total = (row["shard"], row["part"]), counts
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([total.tobytes()], pa.binary())], names=["shard", "part", "counts"])


def slot_counts(local: DataFrame) -> DataFrame:
    """(shard, sizes, bits, k1, k2, k3, counts): perfect hashes over all phrases of packed rows, with their counts by slot."""
    spark = local.sparkSession
    n = common.partitions(spark)
    hashes = common.written(local.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(common.trimmed(_hashes), _HASH), "perfect-hashes")
    parts = local.groupBy("shard").agg(F.ceil(F.count("*") / ROWS).alias("parts"))
    rows = local.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("h1", "n"), "parts")).drop("parts")
    copies = hashes.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    x = copies.withColumn("first", F.lit(0)).unionByName(rows.withColumn("first", F.lit(1)), allowMissingColumns=True)
    x = x.repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "first").drop("first")
    counts = common.written(x.mapInArrow(common.trimmed(_binned), "shard long, part long, counts binary"), "slot-counts")
    most = parts.agg(F.max("parts")).first()[0] or 0
    while most > 1:
        up = counts.withColumn("part", F.expr(f"part div {FAN}")).repartition(n, "shard", "part").sortWithinPartitions("shard", "part")
        counts = common.written(up.mapInArrow(_added, "shard long, part long, counts binary"), "slot-counts")
        most = -(-most // FAN)
    return common.written(hashes.join(counts.drop("part"), "shard"), "slots")


def _frequent(least: int):
    """(h1, h2, h3, a) of the phrases of two or three words with `least` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, n = [np.frombuffer(row[k], np.uint64) for k in ("k1", "k2", "k3")], np.frombuffer(row["counts"], np.int64)
                on = (n >= least) & (h[1] != 0)
                yield pa.RecordBatch.from_arrays([*(pa.array(v[on].view(np.int64)) for v in h), pa.array(n[on])], names=["h1", "h2", "h3", "a"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shard, part), a perfect hash with counts, then requests: the count in each requested slot."""
    perfect, counts, now = None, None, None
    for batch in batches:
        shard, part, first = (batch.column(c).to_numpy() for c in ("shard", "part", "first"))
        edges = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (first[1:] != first[:-1]))))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(shard)], strict=True):
            rows = batch.slice(a, b - a)
            if first[a] == 0:
                row = rows.to_pylist()[0]
                perfect, counts, now = PerfectHash.of(row), np.frombuffer(row["counts"], np.int64), (shard[a], part[a])
                continue
            if now != (shard[a], part[a]):
                raise ValueError("a shard that is asked has no perfect hash")
            slot = perfect.slots(*(rows.column(c).to_numpy().view(np.uint64) for c in ("p1", "p2", "p3")))
            n = np.where(slot >= 0, counts[np.maximum(slot, 0)], 0)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("h1", "h2", "h3", "a", "which")), pa.array(n)], names=["h1", "h2", "h3", "a", "which", "f"])


def _shard_of(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = phrase_key(*(batch.column(c).to_numpy().view(np.uint64) for c in ("p1", "p2", "p3")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((key % np.uint64(shards)).astype(np.int64))], names=[*batch.schema.names, "shard"])

    return run


def with_cuts(phrases: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """phrases (h1, h2, h3, a) with an array cuts of (l, r), after the first word and after the second. Parts are read by slot."""
    spark, none = phrases.sparkSession, F.lit(0).cast("long")
    part = lambda which, *h: F.struct(F.lit(which).alias("which"), *(c.alias(f"p{i + 1}") for i, c in enumerate([*h, *[none] * (3 - len(h))])))
    h1, h2, h3 = F.col("h1"), F.col("h2"), F.col("h3")
    parts = F.when(h3 == 0, F.array(part(0, h1), part(1, h2))).otherwise(F.array(part(0, h1), part(1, h2, h3), part(2, h1, h2), part(3, h3)))
    asked = phrases.select("h1", "h2", "h3", "a", F.explode(parts).alias("p")).select("h1", "h2", "h3", "a", "p.*")
    asked = common.written(asked.mapInArrow(_shard_of(shards), "h1 long, h2 long, h3 long, a long, which int, p1 long, p2 long, p3 long, shard long"), "asked-parts")
    sizes = asked.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).alias("parts"))
    # shards may be few, and each meets its number of parts in SALTS places
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = asked.withColumn("salt", F.pmod(F.xxhash64("h3", "h2", "h1"), F.lit(SALTS)).cast("int")).join(salted, ["shard", "salt"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("h1", "h2", "h3"), "parts")).drop("parts", "salt").withColumn("first", F.lit(1))
    copies = slots.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").withColumn("first", F.lit(0))
    x = copies.unionByName(rows, allowMissingColumns=True).repartition(common.partitions(spark), "shard", "part").sortWithinPartitions("shard", "part", "first")
    got = x.mapInArrow(common.trimmed(_answers), "h1 long, h2 long, h3 long, a long, which int, f long")
    f = lambda k: F.max(F.when(F.col("which") == k, F.col("f")))
    got = got.groupBy("h1", "h2", "h3", "a").agg(f(0).alias("l1"), f(1).alias("r1"), f(2).alias("l2"), f(3).alias("r2"))
    return got.withColumn("cuts", F.filter(F.array(F.struct(F.col("l1").alias("l"), F.col("r1").alias("r")), F.struct(F.col("l2").alias("l"), F.col("r2").alias("r"))), lambda c: c["l"].isNotNull())).drop("l1", "r1", "l2", "r2")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    above, below = wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right)
    return ((above - F.pmod(above, below)) / below).cast("decimal(38,0)").cast("long")


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two or three words, by score, count and text.

    Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at spaces and tabs into words. A phrase within a
    piece that occurs a >= least times is a candidate. Cut in two parts with l and r occurrences it scores floor(1000000 a a / (l r)),
    by its lowest cut, the earlier one among equals. A candidate inside a longer one that occurs at least `inside` percent as often
    is dropped. Null texts count as empty, a null language as `und`; repeated rows count each; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    words, seed = counted_words(docs)
    often = words.where(F.col("n") >= least)
    tokens, n_often = words.agg(F.sum("n")).first()[0] or 0, often.count()
    member_words = Members(n_often)
    word_bits = member_words.array(often.select(F.col("h").alias("key")))
    keep = _Filter(spark, member_words, word_bits)
    n, shards = common.partitions(spark), max(1, -(-2 * tokens // BUCKETS))
    packed = docs.mapInArrow(common.trimmed(_bucketed(keep, seed, shards)), "shard long, bucket binary, n binary")
    buckets = packed.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(common.trimmed(_sums(least)), "key long")
    buckets = common.written(buckets, "often-buckets")
    n_buckets = buckets.count()
    member_buckets = Members(n_buckets)
    keep = _Filter(spark, member_words, word_bits, member_buckets, member_buckets.array(buckets))
    shards = max(1, -(-(n_buckets + n_often) // SHARD))
    local = docs.mapInArrow(common.trimmed(_phrases(keep, seed, shards)), _PACKED).unionByName(often.select("h", "n").mapInArrow(_single_words(shards), _PACKED))
    slots = slot_counts(common.written(local, "local-phrases"))
    phrases = common.written(slots.mapInArrow(_frequent(least), "h1 long, h2 long, h3 long, a long"), "often-phrases")
    longer = phrases.where("h3 <> 0").select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), F.col("a").alias("by"))
    longer = longer.select("p.h1", "p.h2", F.lit(0).cast("long").alias("h3"), "by").groupBy("h1", "h2", "h3").agg(F.max("by").alias("by"))
    scored = with_cuts(phrases, slots, shards).join(longer, ["h1", "h2", "h3"], "left").where(F.col("by").isNull() | (F.col("by") * 100 < F.col("a") * inside))
    cut = F.transform("cuts", lambda c, k: F.struct(score(F.col("a"), c["l"], c["r"]).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    scored = scored.withColumn("cut", F.array_min(cut)).select("h1", "h2", "h3", "a", "cut.l", "cut.r", "cut.score")
    named = often.select("h", "word", "lang")
    for i in (1, 2, 3):
        # equal hashes are split between tasks, as both sides are read from written tables
        scored = common.written(scored.join(named.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), *([F.col("lang")] if i == 1 else [])), f"h{i}", "left" if i == 3 else "inner"), "named-phrases")
    scored = scored.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
