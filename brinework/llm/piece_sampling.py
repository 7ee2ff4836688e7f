"""Sampled segmentations over the lattice of a sentence-piece model, by forward filtering and backward sampling.

A text, with a space before it, is cut where a space follows something else. Pieces reach across several spaces only if they are
runs of spaces, and none goes on from another character to a space, so no piece reaches across a cut: the lattice of the text is
the chain of its words' lattices, where a word has all the spaces before it, one or more. The distinct words of a run of texts
are filtered side by side in numpy: all places walk down the trie of pieces together, and a word's forward filter (for each place,
the weights of the pieces that end there) goes on byte by byte for all words at once. Backward sampling then runs for all words
of the texts side by side. Each draw's random number is a hash of the seed, the row's key, the word's place and the step, so a
row is cut alike wherever it is processed.

A segmentation has probability in proportion to exp(temperature * sum of log weights). Scores of unigram models are log
probabilities; those of BPE models are minus the rank of the piece's merge, and the log weight is then that of Zipf's law,
-log(rank + 1): a frequent long piece outweighs the many short ones that it is made of.

Characters without a piece become their UTF-8 bytes' pieces, and so does a literal U+2581, which marks spaces in pieces:
decoding gives back every text exactly.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm import common

#: Log weights are multiplied by this: below 1 the segmentations vary more.
TEMPERATURE = 0.5
#: Log weight of a byte's piece, used only for characters without a piece.
BYTE_WEIGHT = -12.0
#: Characters of texts whose words are filtered together.
RUN = 1 << 20
_SPACE = "▁".encode()
#: A word with the spaces before it.
_WORD = re.compile(" +[^ ]*")
#: Words of up to so many bytes are filtered with plain weights, tilted against vanishing; longer ones with logarithms.
_SHORT, _TILT = 64, 4.0
#: Bytes of a character by its first byte; 0 for bytes inside one.
_UTF8 = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.int64)


class Pieces:
    def __init__(self, path: str, temperature: float = TEMPERATURE):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        scores = [model.get_score(i) for i in range(size)]
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ranked = [i for i in normal if scores[i] > -1e8]
        by_rank = all(scores[i] <= 0 and scores[i] == int(scores[i]) for i in ranked)
        last = max((-scores[i] for i in ranked), default=0.0)

        def log_weight(i: int) -> float:
            score = scores[i] if scores[i] > -1e8 else -last  # pieces of spaces alone have no score in some models
            return temperature * (-math.log(1 - score) if by_rank else score)

        self.surface: list[bytes] = []
        #: (id, log weight) of each piece.
        self.weights: dict[bytes, tuple[int, float]] = {}
        self.byte_ids = np.zeros(256, np.int32)
        use = set(normal)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
                continue
            self.surface.append(piece.encode().replace(_SPACE, b" "))
            if i not in use:
                continue
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {i} has a space after another character")
            if "▁▁" in piece and piece.strip("▁"):
                raise ValueError(f"piece {i} joins several spaces to other characters")
            if scores[i] > -1e8 or not piece.strip("▁"):
                self.weights[piece.encode()] = (i, log_weight(i))
        self.weights.setdefault(_SPACE, (model.piece_to_id("▁"), temperature * -math.log(1 + last) if by_rank else temperature * -last))
        self.log_weights = np.full(size, BYTE_WEIGHT)
        self._trie()

    def _trie(self) -> None:
        """Transitions node * classes + class of byte -> node (0: none), and the piece that ends at a node (-1: none)."""
        entries = {piece.replace(_SPACE, b" "): got for piece, got in self.weights.items()}
        nodes = {b"": 1}
        for surface in sorted(entries):
            for k in range(1, len(surface) + 1):
                nodes.setdefault(surface[:k], len(nodes) + 1)
        used = sorted({c for surface in entries for c in surface})
        self.classes = np.zeros(256, np.int64)  # class 0 leads nowhere
        self.classes[used] = np.arange(1, len(used) + 1)
        self.n_classes = len(used) + 1
        self.go = np.zeros((len(nodes) + 1) * self.n_classes, np.int32)
        for prefix, node in nodes.items():
            if prefix:
                self.go[nodes[prefix[:-1]] * self.n_classes + self.classes[prefix[-1]]] = node
        self.ends = np.full(len(nodes) + 1, -1, np.int32)
        for surface, (i, w) in entries.items():
            self.ends[nodes[surface]] = i
            self.log_weights[i] = w

    def _edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of all pieces in data; stop: for each byte, where its word ends."""
        first = _UTF8[data]
        at = np.flatnonzero(first).astype(np.int32)
        node, step = np.full(len(at), 1, np.int64), 0
        begins, ends, ids = [], [], []
        alone = np.zeros(len(data), bool)  # characters that are a piece
        cls = self.classes[data]
        here = at
        while len(at):
            node = self.go[node * self.n_classes + cls[here]]
            go = np.flatnonzero(node)
            at, here, node = at[go], here[go] + 1, node[go].astype(np.int64)
            step += 1
            piece = self.ends[node]
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                begins.append(at[hit])
                ends.append(here[hit])
                ids.append(piece[hit])
                if step <= 4:
                    alone[at[hit][first[at[hit]] == step]] = True
            on = np.flatnonzero(here < stop[at])
            at, here, node = at[on], here[on], node[on]
        # the bytes of characters without a piece
        bare = np.flatnonzero((first > 0) & ~alone).astype(np.int32)
        if len(bare):
            size = first[bare]
            at = np.repeat(bare, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            begins.append(at)
            ends.append(at + 1)
            ids.append(self.byte_ids[data[at]])
        return np.concatenate(begins), np.concatenate(ends), np.concatenate(ids)

    def lattices(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' forward filters, each word with a space before it besides those that it begins with: (length of each word,
        first edge that ends at each byte, and for the edges the cumulated probability among those with one end, piece, begin)."""
        coded = [w.encode() for w in words]
        data = np.frombuffer(b" " + b" ".join(coded), np.uint8)
        length = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
        base = np.cumsum(length) - length
        begin, end, ids = self._edges(data, np.repeat((base + length).astype(np.int32), length))
        # in order of the bytes where edges end; sorts of 16-bit numbers take linear time
        order = np.argsort((end & 0xFFFF).astype(np.uint16), kind="stable")
        order = order[np.argsort((end[order] >> 16).astype(np.uint16), kind="stable")]
        begin, end, ids = begin[order], end[order], ids[order]
        home = np.repeat(base.astype(np.int32), length)[begin]
        place = end - home
        chance = np.exp(self.log_weights[ids] + _TILT * (end - begin))
        long = np.flatnonzero(length > _SHORT).tolist()
        for k in long:
            chance[np.searchsorted(end, base[k], "right") : np.searchsorted(end, base[k] + length[k], "right")] = 0.0
        # by the place in the word: each place of all words at once
        order = np.argsort(np.minimum(place, 255).astype(np.uint8), kind="stable")
        came = begin[order]
        starts, chance, node = came == home[order], chance[order], end[order]
        new = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        cuts = np.searchsorted(place[order], np.arange(1, min(int(place.max()), _SHORT) + 2))
        alpha = np.zeros(len(data) + 1)  # weight of all ways to end before a byte
        share = np.zeros(len(begin))
        heads = np.searchsorted(new, cuts)
        for x, y, s, e in zip(heads[:-1], heads[1:], cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            weight = chance[s:e] * np.where(starts[s:e], 1.0, alpha[came[s:e]])
            at = new[x:y]
            run = np.add.reduceat(weight, at - s)
            alpha[node[at]] = run
            share[order[s:e]] = weight / np.repeat(np.maximum(run, 1e-300), np.diff(np.append(at, e)))
        for k in long:
            self._long(int(base[k]), int(length[k]), begin, end, ids, share)
        count = np.bincount(end, minlength=len(data) + 2)
        first = np.cumsum(count) - count
        running = np.cumsum(share)
        cdf = running - (running - share)[first[end]]
        cdf[first[count > 0] + count[count > 0] - 1] = 2.0  # the last edge takes what is left
        return length, first, cdf, ids, begin

    def _long(self, base: int, n: int, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, share: np.ndarray) -> None:
        """The forward filter of one long word, with logarithms; share gets its edges' probabilities."""
        own = np.arange(np.searchsorted(end, base, "right"), np.searchsorted(end, base + n, "right"))
        own = own[begin[own] >= base]
        alpha = {base: 0.0}
        rows, ends = own.tolist(), end[own].tolist()
        begins, weights = begin[own].tolist(), self.log_weights[ids[own]].tolist()
        k = 0
        while k < len(rows):
            j = k
            while j < len(rows) and ends[j] == ends[k]:
                j += 1
            some = [alpha.get(begins[i], -math.inf) + weights[i] for i in range(k, j)]
            top = max(some)
            parts = [math.exp(w - top) if w > -math.inf else 0.0 for w in some]
            total = sum(parts)
            share[rows[k:j]] = [p / total for p in parts]
            alpha[ends[k]] = top + math.log(total)
            k = j

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and the bounds of each text's; keys (64-bit) seed the rows."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        local: dict[str, int] = {}
        index, counts = [], []
        for text in texts:
            # the first space before a word is left out
            words = [w[1:] for w in _WORD.findall(" " + text)] if "  " in text or text.startswith(" ") else text.split(" ")
            counts.append(len(words))
            index += [local.setdefault(w, len(local)) for w in words]
        length, first, cdf, ids, begin = self.lattices(list(local))
        base = np.cumsum(length) - length
        word = np.array(index, np.int64)
        place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
        state = common.mix(np.repeat(keys, counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55))
        at, floor, on, steps = (base + length)[word], base[word], np.arange(len(word)), []
        n = np.zeros(len(word), np.int64)
        while len(on):
            state = state * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
            u = (state >> np.uint64(11)) * 2.0**-53
            e = first[at]
            more = np.flatnonzero(cdf[e] <= u)
            while len(more):
                e[more] += 1
                more = more[cdf[e[more]] <= u[more]]
            steps.append((on, ids[e]))
            n[on] += 1
            at = begin[e]
            go = np.flatnonzero(at > floor)
            on, at, floor, state = on[go], at[go], floor[go], state[go]
        stop = np.cumsum(n)
        out = np.empty(stop[-1] if len(stop) else 0, np.int32)
        for k, (which, piece) in enumerate(steps):
            out[stop[which] - 1 - k] = piece
        bounds = np.concatenate(([0], np.append(0, stop)[np.cumsum(counts)]))
        return out, bounds.astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in ids.tolist()])[1:].decode()


@functools.cache
def pieces(path: str, temperature: float = TEMPERATURE) -> Pieces:
    """One for each Python worker."""
    return Pieces(path, temperature)


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit seed for each row key; null has its own."""
    x = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return common.mix(x * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))


def _runs(batch: pa.RecordBatch, text_at: int, key_at: int, seed: int, model: Pieces) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    texts, keys = batch.column(text_at).to_pylist(), row_keys(batch.column(key_at), seed)
    s = 0
    while s < len(texts):
        e, size = s, 0
        while e < len(texts) and (e == s or size + len(texts[e] or "") < RUN):
            size += len(texts[e] or "")
            e += 1
        yield s, texts[s:e], *model.sample([t or "" for t in texts[s:e]], keys[s:e])
        s = e


def sampled_pieces(docs: DataFrame, path: str, seed: int = 0, temperature: float = TEMPERATURE) -> DataFrame:
    """docs (all columns; doc_id and text are used) with `pieces`, an array of piece ids. Null texts have null pieces; the empty
    text has the one piece of its leading space. A column named pieces is replaced."""
    docs = docs.drop("pieces")
    schema = docs.selectExpr("*", "cast(null as array<int>) as pieces").schema
    text_at, key_at = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, temperature)
        for batch in batches:
            for s, texts, ids, bounds in _runs(batch, text_at, key_at, seed, model):
                null = pa.array([t is None for t in texts])
                part, lists = batch.slice(s, len(texts)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                lists = pa.compute.if_else(null, pa.scalar(None, pa.list_(pa.int32())), lists)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "pieces"])

    import pyarrow.compute  # noqa: F401

    return docs.mapInArrow(common.trimmed(run), schema)


def decoded_pieces(rows: DataFrame, path: str) -> DataFrame:
    """rows (all columns; pieces is used) with `decoded`, the text that the piece ids stand for; null for null."""
    rows = rows.drop("decoded")
    schema = rows.selectExpr("*", "cast(null as string) as decoded").schema
    at = rows.columns.index("pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def sampled_digest(docs: DataFrame, path: str, seed: int = 0, temperature: float = TEMPERATURE) -> DataFrame:
    """(doc_id, n_pieces, pieces_crc32, lossless) of each row's sampled segmentation and of its decoding, in one pass. Null texts
    have no pieces and count as lossless; repeated rows are cut alike."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("pieces_crc32", pa.int64()), ("lossless", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, temperature)
        for batch in batches:
            for s, texts, ids, bounds in _runs(batch, 1, 0, seed, model):
                own = [ids[a:b] if t is not None else ids[:0] for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                same = [t is None or model.decode(x) == t for t, x in zip(texts, own, strict=True)]
                crc = [zlib.crc32(x.astype("<i4").tobytes()) for x in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, len(texts)), pa.array([len(x) for x in own], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.trimmed(run), "doc_id long, n_pieces long, pieces_crc32 long, lossless boolean")
