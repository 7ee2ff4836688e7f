"""Benchmark decontamination with suffix arrays of the training text.

Each task turns runs of documents into shards: one sequence of word hashes with separators between documents, and its suffix
array (packed first words are sorted once, ties are resolved by prefix doubling). Every suffix of every benchmark item is
located in it by binary search; an occurrence of at least a window's words is extended to its longest verbatim match.
Suffixes are sorted no deeper than the longest benchmark item, beyond which no match can reach.

Nothing is shuffled. The benchmark goes to the tasks in blocks of a checked size; a benchmark of one block needs one pass
over the documents, a larger one a pass for each block, whose matches are written and merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm import common

#: Bytes of benchmark text that are sent to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Bytes of documents in a shard.
SHARD_BYTES = 4 << 20

MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])


_FIELDS = ["item_id", "item_start", "doc_start", "n_words"]


class SuffixArray:
    """The suffixes of seq (64-bit word hashes), sorted by their first `depth` words at least."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.vocab, ids = np.unique(seq, return_inverse=True)
        self.bits = max(1, int(len(self.vocab)).bit_length())
        self.packed = max(1, min(62 // self.bits, depth))
        n, self.ids = len(seq), np.concatenate((ids.astype(np.int64) + 1, np.zeros(max(depth, self.packed) + 1, np.int64)))
        key = np.zeros(n, np.int64)
        for k in range(self.packed):
            key <<= self.bits
            key |= self.ids[k : k + n]
        sa = np.argsort(key)
        self.keys = key[sa]
        self.sa = self._resolve(sa, depth)

    def _resolve(self, sa: np.ndarray, depth: int) -> np.ndarray:
        n, h = len(sa), self.packed
        new = np.concatenate(([True], self.keys[1:] != self.keys[:-1]))
        rank = np.zeros(n + 1, np.int64)
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[sa] = head + 1
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))  # in groups of two or more
        while h < depth and len(slots):
            at = sa[slots]
            key = (rank[at] << 32) | rank[np.minimum(at + h, n)]
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            sa[slots] = at
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
            slots = slots[~(new & np.append(new[1:], True))]
            h *= 2
        return sa

    def interval(self, pattern: np.ndarray, starts: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern suffix, which suffixes begin with its first need words: sa[lo:hi]. pattern: hashes, padded behind."""
        at = np.minimum(np.searchsorted(self.vocab, pattern), len(self.vocab) - 1)
        ids = np.where(self.vocab[at] == pattern, at + 1, -1)
        known = np.ones(len(starts), bool)
        low = np.zeros(len(starts), np.int64)
        free = np.zeros(len(starts), np.int64)
        for k in range(self.packed):
            use = k < need
            x = np.where(use, ids[starts + np.where(use, k, 0)], 0)
            known &= x >= 0
            low = (low << self.bits) | np.maximum(x, 0)
            free = np.where(use, free, (free << self.bits) | ((1 << self.bits) - 1))
        lo, hi = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, low | free, "right")
        hi = np.where(known, hi, lo)
        for k in range(self.packed, int(need.max(initial=0))):
            on = np.flatnonzero((hi > lo) & (k < need))
            x = ids[starts[on] + k]
            lo[on], hi[on] = self._bound(lo[on], hi[on], x, k, False), self._bound(lo[on], hi[on], x, k, True)
        return lo, hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, k: int, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            word = self.ids[self.sa[np.minimum(mid, len(self.sa) - 1)] + k]
            right = open_ & ((word <= x) if after else (word < x))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo


class Items:
    """Benchmark items as one padded sequence of hashes, and the suffixes that can begin a window."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int):
        texts = [t.encode() if t else None for _, t in rows]
        words = [h[s:e] for _, _, h, b in common.hashed_words(texts, common.ALNUM) for s, e in zip(b[:-1], b[1:], strict=True)]
        self.depth = max((len(w) for w in words), default=0)
        gap = np.zeros(1, np.uint64)
        self.seq = np.concatenate([x for w in words for x in (gap, w)] + [np.zeros(self.depth + 2, np.uint64)])
        self.item, self.start, self.need, self.at = [], [], [], []
        at = 1
        for (item, _), w in zip(rows, words, strict=True):
            need = min(window, len(w))
            if need:
                k = len(w) - need + 1
                self.item += [item] * k
                self.start += range(k)
                self.need += [need] * k
                self.at += range(at, at + k)
            at += len(w) + 1
        self.start, self.need, self.at = (np.array(x, np.int64) for x in (self.start, self.need, self.at))

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, str | None, int, int, int]]:
        """(document, item_id, item_start, doc_start, n_words) for each longest match in the documents' words."""
        if not len(words) or not len(self.at):
            return
        docs = len(bounds) - 1
        own = np.repeat(np.arange(docs), np.diff(bounds))
        place = np.arange(len(words)) + own + 1  # a separator before each document
        seq = np.full(len(words) + docs + 1, 1, np.uint64)
        seq[place] = words
        sa = SuffixArray(seq, self.depth)
        lo, hi = sa.interval(self.seq, self.at, self.need)
        for s in np.flatnonzero(hi > lo).tolist():
            at = sa.sa[lo[s] : hi[s]]
            here = self.at[s]
            if self.start[s]:  # a match that goes on to the left has been given from there
                at = at[seq[at - 1] != self.seq[here - 1]]
            size = np.full(len(at), self.need[s])
            more = np.arange(len(at))
            while len(more):
                more = more[seq[np.minimum(at[more] + size[more], len(seq) - 1)] == self.seq[here + size[more]]]
                size[more] += 1
            doc = np.searchsorted(place, at)
            for p, n in zip(doc.tolist(), size.tolist(), strict=True):
                d = int(own[p])
                yield d, self.item[s], int(self.start[s]), p - int(bounds[d]), n


def _covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for s, e in sorted(spans):
        total += max(0, e - max(s, end))
        end = max(end, e)
    return total


def _scan(items: Items):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("matches", pa.list_(MATCH))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_bytes(batch.column(2))
            for first, last, words, bounds in common.hashed_words(texts, common.ALNUM, SHARD_BYTES):
                told: list[set] = [set() for _ in range(last - first)]
                for d, *match in items.matches(words, bounds):
                    told[d].add(tuple(match))
                found = [[dict(zip(_FIELDS, m, strict=True)) for m in sorted(t, key=lambda m: (m[0] is not None, m))] for t in told]
                hit = [_covered([(m["doc_start"], m["doc_start"] + m["n_words"]) for m in f]) for f in found]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(MATCH))], schema=schema)

    return common.trimmed(run)


_ROWS = "doc_id long, key long, n_words long, n_hit long, matches array<struct<item_id: string, item_start: long, doc_start: long, n_words: long>>"


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, key, n_words, n_hit, matches): for each row of docs (doc_id, text) its words, the words inside matches, and
    each longest verbatim match of at least `window` words (an item of fewer words: all of it) with both places.

    key is a hash of the text. Null or empty texts have no words; null or empty items match nothing; repeated rows each get a
    row. Matches are distinct and ordered by item_id (as text), place in the item and place in the document, however many blocks
    the benchmark takes.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    items = benchmark.select(F.col("item_id").cast("string"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    if blocks == 1:
        return docs.mapInArrow(_scan(Items([tuple(r) for r in items.collect()], window)), _ROWS)
    parts = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        found = docs.mapInArrow(_scan(Items([tuple(r) for r in rows], window)), _ROWS)
        found = common.written(found if b == 0 else found.where("n_hit > 0"), "matches")
        parts = found if parts is None else parts.unionByName(found)
    merged = parts.where("n_hit > 0").select("doc_id", "key", F.explode("matches").alias("m")).distinct()
    merged = merged.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("m")).alias("matches"))
    ends = F.sort_array(F.transform("all", lambda m: F.struct(m["doc_start"].alias("s"), (m["doc_start"] + m["n_words"]).alias("e"))))
    step = lambda acc, m: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), m["e"] - F.greatest(m["s"], acc["e"]))).alias("n"), F.greatest(acc["e"], m["e"]).alias("e")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
    base = common.written(docs.select("doc_id", "key", "text").mapInArrow(_scan(Items([], window)), _ROWS), "words").drop("n_hit", "matches")
    out = base.join(merged, base["doc_id"].eqNullSafe(merged["doc_id"]) & base["key"].eqNullSafe(merged["key"]), "left")
    out = out.select(base["doc_id"], base["key"], "n_words", F.coalesce("matches", F.array().cast(merged.schema["matches"].dataType)).alias("all"))
    return out.select("doc_id", "key", "n_words", F.aggregate(ends, zero, step)["n"].alias("n_hit"), F.col("all").alias("matches"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs; see verbatim_matches."""
    found = verbatim_matches(docs, benchmark, window)
    names = F.sort_array(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    found = found.withColumn("names", names)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "names"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, all their columns, that hold no benchmark window."""
    found = verbatim_matches(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    found = common.written(found, "contaminated")
    same = docs["doc_id"].eqNullSafe(found["_d"]) & F.xxhash64(docs["text"]).eqNullSafe(found["_k"])
    return docs.join(found.hint("shuffle_hash"), same, "left_anti")
