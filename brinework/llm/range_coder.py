"""Adaptive context-mixing range coder for token ids, and the file format around it.

A file row is a segment: whole documents in order, whose ids are one stream cut into blocks of BLOCK ids. Every block is coded
on its own, from the segment's starting model, with a checksum of its ids. The blocks of a segment are coded side by side, one
numpy lane each, so a step codes one id of every block.

Model: the segment's header holds how often each id occurs (order 0) and how often each pair of ids does, if often enough
(order 1). An id has the probability of its pair; ids of rare pairs share what is left by how often they occur in such. With
this the order-2 prediction is mixed, the id that last followed the same two ids in the block: it gets 1 - 1 / 2^j of the whole
beside its pair's share of the rest. j adapts in each block, every few ids, to how often such predictions have been right, apart
for predictions that have held 0, 1, 2 or more times in a row.

Coder: a range coder with asymmetric numerals (rANS). The whole has 1 << _BITS slots, and an id's share is a number of them, so
that no step of the decoder divides or searches: a table says whose each slot is. A context has a power of two of slots in that
table, by how often it occurs, which are spread over what the prediction leaves of the whole.

What the model tells of an id depends only on ids before it, so the encoder works out all intervals of a segment at once; only
the coder itself, from the last id to the first, and the decoder go step by step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.llm import common
from brinework.llm.bytebpe import encoder

#: Ids in a block; ids in a segment, about (a document is never cut between segments).
BLOCK, SEGMENT = 1024, 1 << 22
#: Slots of a block's order-2 predictions; pairs that occur less often are not in the header.
_SLOTS, _LEAST_PAIRS = 512, 4
#: Slots of the whole and, at most, of a context, in bits; the largest weight; steps from one change of weights to the next.
_BITS, _BITS1, _MOST, _PACE = 16, 13, 6, 32
#: Hits and misses, times 16, that predictions of each confidence start with.
_HITS, _MISSES = np.array([4, 12, 24, 48], np.int32), np.array([32, 16, 12, 8], np.int32)
#: Instead of a symbol or code: any symbol, none, the escape.
_ANY, _NONE, _ESCAPES = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFF
FILE = "part int, segment int, n_tokens long, doc_ids array<long>, lengths array<long>, sizes array<int>, checks array<long>, model binary, payload binary"


def _shared(count: np.ndarray, total: int) -> np.ndarray:
    """Whole shares of total in proportion to the counts, at least 1 for each that is not 0."""
    out = np.zeros(len(count), np.int64)
    on = np.flatnonzero(count)
    if len(on):
        out[on] = 1 + count[on] * (total - len(on)) // count.sum()
        out[np.argmax(out)] += total - out.sum()
    return out


class _Static:
    """What a segment's header says: symbols (distinct ids) and kept pairs, and the tables that both directions make of it.

    A code below `codes` is one of a context's intervals: its kept pairs in order, then the escape to all other symbols; above
    it stands for a symbol told on its own, and the last for nothing yet."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, keys: np.ndarray, pair_counts: np.ndarray):
        self.ids, self.counts, self.keys, self.pair_counts = ids, counts, keys, pair_counts
        n, ctx, sym = len(ids), keys >> 16, keys & 0xFFFF
        held = np.bincount(ctx, minlength=n + 1)  # the last context is a block's beginning
        room = np.append(np.maximum(counts, np.bincount(ctx, weights=pair_counts, minlength=n).astype(np.int64)), 1) + 1
        #: Each context has 1 << bits slots: more for those that occur often.
        bits = np.minimum(np.maximum(np.frexp(room // 2)[1], np.frexp(held)[1]), _BITS1)
        #: Code of each kept pair, and of each context's escape.
        self.pair = np.arange(len(keys)) + ctx
        escape = np.cumsum(held) + np.arange(n + 1)
        self.codes = len(keys) + n + 1
        freq = np.empty(self.codes, np.int64)
        freq[self.pair] = 1 + pair_counts * ((1 << bits[ctx]) - held[ctx] - 1) // room[ctx]
        freq[escape] = 0
        ends = np.cumsum(freq)[escape]
        freq[escape] = (1 << bits) - np.diff(ends, prepend=0)
        first = np.cumsum(1 << bits) - (1 << bits)
        of = np.repeat(np.arange(n + 1), held + 1)
        cum = np.cumsum(freq) - freq - first[of]
        self.escape = escape.astype(np.uint32)
        self.table = np.repeat(np.arange(self.codes, dtype=np.uint32), freq)
        self.first, self.spare = first.astype(np.uint32), (_BITS - bits).astype(np.uint32)
        #: Of each code: its slots and those before it, the symbol before (or any, or none), the symbol (or that it escapes).
        self.freq, self.cum = (np.append(x, np.zeros(n + 1)).astype(np.uint32) for x in (freq, cum))
        self.ctx = np.concatenate((of, np.full(n, _ANY), [_NONE])).astype(np.uint32)
        self.sym = np.full(self.codes + n + 1, _ESCAPES, np.uint32)
        self.sym[self.pair], self.sym[self.codes : -1] = sym, np.arange(n)
        #: How often each symbol was told on its own, hits of predictions counted too.
        alone = np.maximum(counts - np.bincount(sym, weights=pair_counts, minlength=n).astype(np.int64), 0)
        self.freq0 = _shared(alone, 1 << _BITS).astype(np.uint32)
        self.cum0 = (np.cumsum(self.freq0) - self.freq0).astype(np.uint32)
        self.table0 = np.repeat(np.arange(n, dtype=np.uint32), self.freq0)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[_Static, np.ndarray, np.ndarray]:
        """The model of a stream, and each id's symbol and code."""
        counts = np.bincount(ids, minlength=1 << 16)
        names = np.flatnonzero(counts)
        symbol = np.zeros(1 << 16, np.uint32)
        symbol[names] = np.arange(len(names))
        sym = symbol[ids]
        # each pair before its place in one number; nothing is before a block's first id
        key = np.empty(len(sym), np.uint64)
        place, pair = key.view("<u4").reshape(-1, 2).T
        place[:] = np.arange(len(sym), dtype=np.uint32)
        pair[1:] = sym[:-1] << np.uint32(16) | sym[1:]
        key[::BLOCK] = np.uint64(0xFFFFFFFFFFFFFFFF)  # behind all others
        key.sort()
        place, pair = key[: len(sym) - len(sym[::BLOCK])].view("<u4").reshape(-1, 2).T
        pair = np.ascontiguousarray(pair)
        rows = np.flatnonzero(np.concatenate((np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1])))
        size = np.diff(np.append(rows, len(pair)))
        keys, counts = pair[rows].astype(np.int64), counts[names]
        kept = (size >= _LEAST_PAIRS) & (size > counts[keys >> 16] >> _BITS1 - 1)
        static = cls(names, counts, keys[kept], size[kept])
        codes = (keys & 0xFFFF) + static.codes
        codes[kept] = static.pair
        code = np.empty(len(sym), np.uint32)
        code[place] = np.repeat(codes.astype(np.uint32), size)
        code[::BLOCK] = sym[::BLOCK] + np.uint32(static.codes)
        return static, sym, code

    def to_bytes(self) -> bytes:
        parts = [np.diff(self.ids, prepend=0).astype("<u2"), self.counts.astype("<u4"), np.diff(self.keys, prepend=0).astype("<u4"), self.pair_counts.astype("<u4")]
        planes = [x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in parts]
        return np.array([len(self.ids), len(self.keys)], "<u4").tobytes() + zstandard.compress(b"".join(planes), 3)

    @classmethod
    def from_bytes(cls, data: bytes) -> _Static:
        n, pairs = np.frombuffer(data[:8], "<u4").tolist()
        raw, at, out = zstandard.decompress(data[8:]), 0, []
        for size, kind in ((n, "<u2"), (n, "<u4"), (pairs, "<u4"), (pairs, "<u4")):
            width = np.dtype(kind).itemsize
            out.append(np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T.copy().view(kind).ravel().astype(np.int64))
            at += size * width
        return cls(np.cumsum(out[0]), out[1], np.cumsum(out[2]), out[3])


def _weights(hits: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """j for each confidence (the last axis): a prediction gets 1 - 1 / 2^j of the whole, as often as its like have been right."""
    most, least = all_ * 16, (all_ - hits) * 16
    most, least = (most + (_HITS + _MISSES)) * 7, (least + _MISSES) * 5
    out = np.zeros(most.shape, np.uint32)
    for _ in range(_MOST):
        least += least
        out += least <= most
    return out


def _slot(before: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Slot of the two symbols before."""
    return before * np.uint32(13) + ctx * np.uint32(977) & np.uint32(_SLOTS - 1)


def _widths(n: int) -> np.ndarray:
    """Ids in each block of a stream of n."""
    return np.diff(np.append(np.arange(0, n, BLOCK), n))


def _intervals(static: _Static, sym: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each id: its slots of 1 << _BITS, how many of them begin the whole, those before the others, and if its symbol
    must be told on its own. sym, code: those of so many blocks that their slots have 16-bit numbers."""
    n = len(code)
    place = np.arange(n, dtype=np.int32)
    none = np.uint32(len(static.ids))
    ctx, before = np.full(n, none, np.uint32), np.full(n, none, np.uint32)
    ctx[1:], before[2:] = sym[:-1], sym[:-2]
    ctx[::BLOCK] = before[::BLOCK] = before[1::BLOCK] = none
    # the place before with the same slot in the block
    slot = (_slot(before, ctx) + (place // BLOCK * _SLOTS).astype(np.uint32)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    slot, told = slot[order], code[order]
    entry = np.full(n, static.codes + none, np.uint32)
    again = slot[1:] == slot[:-1]
    np.copyto(entry[1:], told[:-1], where=again)
    run = place.copy()
    run -= np.maximum.accumulate(np.where(entry == told, 0, run))  # hits in a row, this one counted
    state = np.zeros(n, np.uint32)
    state[order[1:]] = np.minimum(run[:-1], 3) * again
    back = np.empty(n, np.uint32)
    back[order] = entry
    entry = back
    told_of = static.ctx[entry]
    valid = (told_of == ctx) | (told_of == _ANY)
    hit = entry == code
    # weights follow what has been seen up to the last multiple of _PACE
    at = (place // _PACE).astype(np.uint32) * np.uint32(4) + state
    groups = -(-n // BLOCK) * (BLOCK // _PACE)
    seen = [np.bincount(x, minlength=groups * 4).reshape(-1, BLOCK // _PACE, 4) for x in (at[hit], at[valid])]
    j = _weights(*((np.cumsum(x, axis=1) - x).astype(np.int32) for x in seen)).ravel()[at] * valid
    spare = static.spare[ctx]
    j = np.minimum(j, spare)
    share = np.uint32(1 << _BITS) - (np.uint32(1 << _BITS) >> j)
    hit &= j > 0
    spare -= j
    alone = code >= static.codes
    alone &= ~hit
    told = np.where(alone, static.escape[ctx], code)
    mine = share * hit
    return (static.freq[told] << spare) + mine, mine, (static.cum[told] << spare) + share - mine, alone


def encode_blocks(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """The header of a stream of ids (below 65,536), and each block as bytes."""
    if not len(ids):
        return b"", []
    static, sym, code = _Static.of(ids)
    widths = _widths(len(ids))
    lanes, several = len(widths), (1 << 16) // _SLOTS
    # a row for each step, with a number for each block
    freq, mine, start = grids = [np.ones((BLOCK, lanes), np.uint32) for _ in range(3)]
    alone = []
    for b in range(0, lanes, several):
        part = slice(b * BLOCK, (b + several) * BLOCK)
        *parts, told = _intervals(static, sym[part], code[part])
        for grid, x in zip(grids, parts, strict=True):
            whole = len(x) // BLOCK
            grid[:, b : b + whole] = x[: whole * BLOCK].reshape(-1, BLOCK).T
            grid[: len(x) - whole * BLOCK, b + whole : b + whole + 1] = x[whole * BLOCK :, None]
        alone.append(np.flatnonzero(told) + b * BLOCK)
    # what is told on its own, step by step
    alone = np.concatenate(alone)
    alone = alone[np.argsort(alone % BLOCK, kind="stable")]
    bounds = np.searchsorted(alone % BLOCK, np.arange(BLOCK + 1)).tolist()
    rows, alone = alone // BLOCK, sym[alone]
    # the coder goes from the last id to the first; words[2 t] leave before id t's interval, words[2 t + 1] before its symbol
    words, leaves = np.zeros((2 * BLOCK, lanes), np.uint16), np.zeros((2 * BLOCK, lanes), bool)
    state = np.full(lanes, 1 << _BITS, np.uint32)
    low = np.uint32(_BITS)
    for t in range(int(widths[0]) - 1, -1, -1):
        n = lanes if t < widths[-1] else lanes - 1
        if bounds[t] < bounds[t + 1]:
            rest, s = rows[bounds[t] : bounds[t + 1]], alone[bounds[t] : bounds[t + 1]]
            x, f = state[rest], static.freq0[s]
            go = x >> low >= f
            words[2 * t + 1, rest], leaves[2 * t + 1, rest] = x, go
            x >>= go * low
            q = x // f
            state[rest] = (q << low) + (x - q * f) + static.cum0[s]
        x, f = state[:n], freq[t, :n]
        go = np.greater_equal(x >> low, f, out=leaves[2 * t, :n])
        words[2 * t, :n] = x
        x >>= go * low
        q = x // f
        x -= q * f
        x += start[t, :n] * (x >= mine[t, :n])
        x += q << low
    del grids, freq, mine, start
    leaves = np.ascontiguousarray(leaves.T)
    payload = np.ascontiguousarray(words.T)[leaves].astype("<u2", copy=False)
    ends = np.cumsum(leaves.sum(axis=1))
    heads = np.stack((state & 0xFFFF, state >> low), axis=1).astype("<u2")
    return static.to_bytes(), [heads[k].tobytes() + payload[a:b].tobytes() for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]


def decode_blocks(model: bytes, blocks: list[bytes], n: int) -> np.ndarray:
    """The n ids of a stream's blocks."""
    if not n:
        return np.zeros(0, np.uint16)
    static = _Static.from_bytes(model)
    widths = _widths(n)
    lanes, none = len(widths), len(static.ids)
    grid = np.zeros((BLOCK, lanes), np.uint16)
    size = np.array([len(b) // 2 for b in blocks])
    data = np.frombuffer(b"".join([*blocks, b"\0\0"]), "<u2").astype(np.uint32)
    at = np.cumsum(size) - size
    state = data[at] | data[at + 1] << np.uint32(16)
    at += 2
    table = np.full(lanes * _SLOTS, static.codes + none << 2, np.uint32)  # code * 4 + confidence
    seen = np.zeros(lanes * 4, np.uint32)  # predictions, and 1 << 16 for each that was right
    ctx, before = np.full(lanes, none, np.uint32), np.full(lanes, none, np.uint32)
    # arrays, since numpy takes longer to look at scalars
    low, mask, whole, one, two, three, any_, escapes = (np.array(x, np.uint32) for x in (_BITS, (1 << _BITS) - 1, 1 << _BITS, 1, 2, 3, _ANY, _ESCAPES))
    base, counters = np.arange(lanes, dtype=np.uint32) * np.uint32(_SLOTS), np.arange(lanes, dtype=np.uint32) * np.uint32(4)
    for t in range(int(widths[0])):
        if t == widths[-1]:
            ctx, before, base, counters, at, state = (x[:-1] for x in (ctx, before, base, counters, at, state))
        if t % _PACE == 0:
            counts = seen.reshape(-1, 4).astype(np.int32)
            weights = _weights(counts >> 16, counts & 0xFFFF).ravel()
        slot = _slot(before, ctx)
        slot += base
        slot = slot.astype(np.intp)
        got = table.take(slot)
        entry, like = got >> two, got & three
        told_of = static.ctx.take(entry)
        valid = (told_of == ctx) | (told_of == any_)
        counter = (counters + like).astype(np.intp)
        at_ctx = ctx.astype(np.intp)
        j = weights.take(counter)
        j *= valid
        spare = static.spare.take(at_ctx)
        np.minimum(j, spare, out=j)
        spare -= j
        share = whole - (whole >> j)
        value = state & mask
        behind = value >= share
        place = value - share
        place *= behind
        place >>= spare
        place += static.first.take(at_ctx)
        code = np.where(behind, static.table.take(place), entry)
        hit = code == entry
        # a hit owns the beginning too; the others begin behind it
        mine = share * hit
        at_code = code.astype(np.intp)
        start = static.cum.take(at_code) << spare
        start += share
        start -= mine
        start *= behind
        size = static.freq.take(at_code) << spare
        size += mine
        state >>= low
        state *= size
        value -= start
        state += value
        reads = state < whole
        state = np.where(reads, (state << low) | data.take(at), state)
        at += reads
        sym = static.sym.take(at_code)
        rest = np.flatnonzero(sym == escapes)
        if len(rest):
            x = state[rest]
            value = x & mask
            s = static.table0[value]
            x = static.freq0[s] * (x >> low) + (value - static.cum0[s])
            reads = x < whole
            from_ = at[rest]
            state[rest] = np.where(reads, (x << low) | data[from_], x)
            at[rest] = from_ + reads
            sym[rest] = s
            s += np.uint32(static.codes)
            code[rest] = s
            hit[rest] = s == entry[rest]
        seen[counter] += valid + (hit << low)
        like += one
        np.minimum(like, three, out=like)
        like *= hit
        code <<= two
        code |= like
        table[slot] = code
        grid[t, : len(sym)] = sym
        ctx, before = sym, ctx
    return static.ids.astype(np.uint16)[np.ascontiguousarray(grid.T).ravel()[:n]]


def _write(vocabulary: str, end: int):
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("checks", pa.list_(pa.int64())), ("model", pa.binary()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, room, held, docs, lengths = TaskContext.get().partitionId(), 0, SEGMENT, [], [], []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            model, blocks = encode_blocks(ids)
            checks = [zlib.crc32(ids[s : s + BLOCK].tobytes()) for s in range(0, len(ids), BLOCK)]
            row = {"part": part, "segment": segment, "n_tokens": len(ids), "doc_ids": docs, "lengths": lengths, "sizes": list(map(len, blocks)), "checks": checks, "model": model, "payload": b"".join(blocks)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            names, first = batch.column(0).to_pylist(), 0
            for ids, sizes in encoder(vocabulary).groups(batch.column(1), end):
                ids, ends, at = ids.astype("<u2", copy=False), np.cumsum(sizes, dtype=np.int64), 0
                while at < len(ends):
                    begin = ends[at - 1] if at else 0
                    # up to the text that fills the segment
                    to = min(len(ends), int(np.searchsorted(ends, begin + room)) + 1)
                    held.append(ids[begin : ends[to - 1]])
                    docs += names[first + at : first + to]
                    lengths += sizes[at:to].tolist()
                    room -= int(ends[to - 1] - begin)
                    at = to
                    if room <= 0:
                        yield flush()
                        segment, room, held, docs, lengths = segment + 1, SEGMENT, [], [], []
                first += len(sizes)
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str, end: int = 2) -> None:
    """Writes docs (doc_id, text) in ascending doc_id order (nulls first; equal ones by text), each with the end id behind it."""
    docs = docs.select("doc_id", "text").repartitionByRange(common.partitions(docs.sparkSession), "doc_id")
    docs = docs.sortWithinPartitions("doc_id", F.xxhash64("text"))
    docs.mapInArrow(_write(vocabulary, end), FILE).write.option("compression", "none").parquet(path)


def _read():
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks, at = [], 0
                for size in row["sizes"]:
                    blocks.append(row["payload"][at : at + size])
                    at += size
                ids = decode_blocks(row["model"], blocks, row["n_tokens"])
                for k, check in enumerate(row["checks"]):
                    if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u2").tobytes()) != check:
                        raise ValueError(f"block {k} of part {row['part']}, segment {row['segment']} is damaged")
                ends = np.cumsum([0, *row["lengths"]])
                for s in range(0, len(row["doc_ids"]), 1000):
                    cuts = ends[s : s + 1001]
                    data = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    k = len(data)
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * k, pa.int32()), pa.array([row["segment"]] * k, pa.int32()), pa.array(row["doc_ids"][s : s + k], pa.int64()), pa.array(cuts[:-1]), pa.array(data, pa.binary())], schema=schema)

    return run


def read_ids(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Of written files, (part, segment, doc_id, offset, ids) with ids as little-endian 32-bit integers, the end id last, and
    (part, segment, base); base + offset counts the ids of all documents before it. A block that fails its checksum raises."""
    files = spark.read.schema(FILE).parquet(path)
    segments = files.select("part", "segment", "n_tokens")
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.join(F.broadcast(before), "part")  # a row for each part file
    bases = bases.select("part", "segment", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base"))
    docs = files.mapInArrow(_read(), "part int, segment int, doc_id long, offset long, ids binary")
    return docs, bases


def coded_documents(docs: DataFrame, vocabulary: str, end: int = 2, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): docs written to files, read back, and summed up. Null texts hold only the end id;
    repeated rows each get a row."""
    path = path or common.new_path(docs.sparkSession, "ids")
    write_ids(docs, path, vocabulary, end)
    read, bases = read_ids(docs.sparkSession, path)
    read = read.select("part", "segment", "doc_id", "offset", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return read.join(bases, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
