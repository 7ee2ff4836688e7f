"""Hierarchical Pitman-Yor language model, trained and applied as exchanges between batches of documents and restaurant servers.

Restaurants: one for every word that stands before another in the training text (the end of a document among them), and the one of
single words that they all share as parent, over a uniform base of V + 1 types. Nothing limits the number of contexts: it grows
with the corpus. A server holds the restaurants of its contexts, by the context's hash, with all their dishes; a context that a
large part of the tokens follows is dealt by dish over all servers, and only the totals of those few contexts are gathered.

Seating: a sweep lifts the party of each dish at each restaurant and seats its customers again one by one by the Chinese
restaurant process, given the totals of the sweep before and the parent's probabilities (Gibbs sampling, all parties of a sweep in
parallel). New tables are customers of the parent, whose own parties lie with other servers, by the dish's hash. So sweeps come in
rounds: the parent is seated from what the servers' tables send it, its customers and tables go back to the servers that asked,
and these sweep SWEEPS times. In the first round every party has one table to begin with. The predictive probabilities of all
sweeps of the last round are averaged. Random numbers are hashes of dish, context and sweep, so a lost task is seated alike.

Exchange: a batch sends each of its distinct (context, word) pairs once, with its training count, to the context's server; a hot
pair is thus one entry for each batch. The servers keep which pairs each batch asked for, and answer with their probabilities and
the contexts' counts, which are the words' own counts too, since every token stands before another. Words are 48-bit hashes there.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm import common

ROUNDS, SWEEPS, BATCH_TOKENS = 2, 4, 1 << 20
#: Words that a server of the parent takes from all servers of contexts, about.
HOME_WORDS = 1 << 18
STRENGTH = (1.0, 1.0)  # of the contexts' restaurants and of their parent
_END = np.uint64(1)
STATE = "batch long, doc_ids array<long>, train binary, lengths binary, words binary, ids binary, often array<struct<word: long, n: long>>"
ASKED = "bucket int, batch long, contexts binary, sizes binary, words binary, index binary, counts binary"
MODEL = "bucket int, contexts binary, words binary, sizes binary, index binary, counts binary, refs array<struct<batch: long, pairs: binary>>"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _packed(a: np.ndarray) -> bytes:
    """The array's bytes, the same byte of all numbers together, compressed."""
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return planes.T.copy().view(kind).ravel()


def _six(words: np.ndarray) -> bytes:
    """48-bit hashes as six bytes each."""
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _by_frequency(index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below n in order of how often index has them, and index in those terms: small numbers compress."""
    order = np.argsort(-np.bincount(index, minlength=n), kind="stable")
    rank = np.empty(n, np.uint32)
    rank[order] = np.arange(n)
    return order, rank[index]


def _tokenised(buckets: int):
    often_kind = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()), ("ids", pa.binary()), ("often", often_kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        lengths: list[np.ndarray] = []
        hashes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            words, ids = np.unique(np.concatenate(hashes), return_inverse=True)
            order, ranked = _by_frequency(ids, len(words))
            counts = np.bincount(ids, minlength=len(words))
            often = np.flatnonzero(counts >= max(2, len(ids) // (8 * buckets)))
            told = [{"word": int(w), "n": int(n)} for w, n in zip(words[often].tolist(), counts[often].tolist(), strict=True)]
            train = np.array([not held_out(d) for d in docs])
            row = {"batch": part << 24 | number, "doc_ids": list(docs), "train": train.tobytes(), "lengths": np.concatenate(lengths).astype(np.int32).tobytes(), "words": _six(words[order]), "ids": _packed(ranked), "often": told}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), common.as_bytes(batch.column(1))
            for first, last, words, bounds in common.hashed_words(texts):
                # the end token behind each document's words
                n = np.diff(bounds)
                at = bounds[1:] + np.arange(len(n))
                seq = np.empty(len(words) + len(n), np.uint64)
                mask = np.ones(len(seq), bool)
                mask[at] = False
                seq[at], seq[mask] = _END, words >> np.uint64(16)
                docs += names[first:last]
                lengths.append(n + 1)
                hashes.append(seq)
                held += len(seq)
                if held >= BATCH_TOKENS:
                    yield flush()
                    docs, lengths, hashes, held, number = [], [], [], 0, number + 1
        if docs:
            yield flush()

    return run


class _Batch:
    """A batch's distinct (context, word) pairs, in order of bucket, context's hash and word's hash, and which pair each token is."""

    def __init__(self, row: dict, hot: np.ndarray, buckets: int):
        words = _from_six(row["words"])
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words, self.ids = words[order], place[_unpacked(row["ids"], np.uint32)]
        self.lengths, self.train = np.frombuffer(row["lengths"], np.int32), np.frombuffer(row["train"], bool)
        before = np.concatenate(([np.searchsorted(self.words, _END)], self.ids[:-1]))
        code, pair = np.unique(before << 32 | self.ids, return_inverse=True)
        context, word = code >> 32, code & 0xFFFFFFFF
        deal = np.isin(self.words, hot)
        own = (common.mix(self.words) % np.uint64(buckets)).astype(np.int32)
        by_word = (common.mix(self.words + np.uint64(buckets)) % np.uint64(buckets)).astype(np.int32)
        bucket = np.where(deal[context], by_word[word], own[context])
        order = np.argsort(bucket, kind="stable")
        self.context, self.word = context[order], word[order]
        self.cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        self.pair = moved[pair]
        self.tokens_train = np.repeat(self.train, self.lengths)


def _requests(hot: np.ndarray, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("contexts", "sizes", "words", "index", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Batch(row, hot, buckets)
                counts = np.bincount(b.pair[b.tokens_train], minlength=len(b.word)).astype(np.uint32)
                out = []
                for k in np.flatnonzero(np.diff(b.cuts)).tolist():
                    x, y = b.cuts[k], b.cuts[k + 1]
                    contexts, sizes = np.unique(b.context[x:y], return_counts=True)
                    words, index = np.unique(b.word[x:y], return_inverse=True)
                    order, ranked = _by_frequency(index, len(words))
                    out.append({"bucket": k, "batch": row["batch"], "contexts": _six(b.words[contexts]), "sizes": _packed(sizes.astype(np.uint32)), "words": _six(b.words[words[order]]), "index": _packed(ranked), "counts": _packed(counts[x:y])})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """The server's restaurants: all pairs asked for, with training counts, and which of them each batch asked for."""
    contexts = [_from_six(c) for c in rows["contexts"]]
    words = [_from_six(w) for w in rows["words"]]
    all_contexts, context_at = np.unique(np.concatenate(contexts), return_inverse=True)
    all_words, word_at = np.unique(np.concatenate(words), return_inverse=True)
    codes, at_c, at_w = [], 0, 0
    for c, w, sizes, index in zip(contexts, words, rows["sizes"], rows["index"], strict=True):
        own = np.repeat(context_at[at_c : at_c + len(c)], _unpacked(sizes, np.uint32))
        codes.append(own << 32 | word_at[at_w : at_w + len(w)][_unpacked(index, np.uint32)])
        at_c, at_w = at_c + len(c), at_w + len(w)
    pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([_unpacked(c, np.uint32) for c in rows["counts"]]), minlength=len(pairs))
    refs, at = [], 0
    for batch, code in zip(rows["batch"].tolist(), codes, strict=True):
        refs.append({"batch": batch, "pairs": _packed(np.diff(place[at : at + len(code)], prepend=0).astype(np.uint32))})
        at += len(code)
    sizes = np.bincount(pairs >> 32, minlength=len(all_contexts)).astype(np.uint32)
    out = {"bucket": int(rows["bucket"].iloc[0]), "contexts": _six(all_contexts), "words": _six(all_words), "sizes": _packed(sizes), "index": _packed((pairs & 0xFFFFFFFF).astype(np.uint32)), "counts": _packed(counts.astype(np.uint32)), "refs": refs}
    return pd.DataFrame({k: [v] for k, v in out.items()})


def _uniform(key: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    return ((common.mix(key + np.asarray(step).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55)) >> np.uint64(11)) + 0.5) * 2.0**-53


def seat(count: np.ndarray, mass: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of each party of `count` customers where a new table has weight `mass`, others their customers less the discount.

    The first 64 customers are seated one by one; beyond, the wait for the next new table is drawn at once from
    ((x + h) / (x + m + h)) ** mass, h = (mass - 1) / 2, for x = seated customers less discounts."""
    tables = np.minimum(count, 1).astype(np.int64)
    order = np.argsort(-count, kind="stable")
    size = np.searchsorted(-count[order], -np.arange(2, 66), "right")  # parties of at least that many
    for i in range(1, 64):
        on = order[: size[i - 1]]
        if not len(on):
            break
        x = i - discount * tables[on]
        tables[on] += _uniform(key[on], i) * (x + mass[on]) < mass[on]
    on, seated, step = np.flatnonzero(count > 64), None, 64
    seated = np.full(len(on), 64.0)
    while len(on):
        x, a = seated - discount * tables[on], np.maximum(mass[on], 1e-12)
        h = np.maximum((a - 1) / 2, 0.0)
        wait = np.floor((x + h) * np.expm1(np.minimum(-np.log(_uniform(key[on], step)) / a, 60.0))) + 1
        go = seated + wait <= count[on]
        on, seated = on[go], (seated + wait)[go]
        tables[on] += 1
        step += 1
    return tables


class _Server:
    """One bucket's restaurants, seated round by round given what the parent told before each (rows of its servers)."""

    def __init__(self, row: dict, known: dict):
        self.contexts, self.words = _from_six(row["contexts"]), _from_six(row["words"])
        self.context = np.repeat(np.arange(len(self.contexts)), _unpacked(row["sizes"], np.uint32))
        self.word, self.count = _unpacked(row["index"], np.uint32).astype(np.int64), _unpacked(row["counts"], np.uint32).astype(np.int64)
        self.refs = row["refs"]
        self.n = np.bincount(self.context, weights=self.count, minlength=len(self.contexts))
        hot = np.array(sorted(known["hot"]), np.uint64)
        at = np.minimum(np.searchsorted(hot, self.contexts), max(len(hot) - 1, 0))
        self.hot = np.flatnonzero(hot[at] == self.contexts) if len(hot) else np.zeros(0, np.int64)
        self.hot_names = self.contexts[self.hot].tolist()
        self.known = known
        self.n[self.hot] = [known["hot"][v].get("c", 0) for v in self.hot_names]

    def totals(self, tables: np.ndarray, name: str) -> np.ndarray:
        """Tables of each context; those of hot ones, which several servers hold, as they were gathered under a name."""
        out = np.bincount(self.context, weights=tables, minlength=len(self.contexts))
        out[self.hot] = [self.known["hot"][v].get(name, 0) for v in self.hot_names]
        return out

    def parent(self, told: list[dict], n: int) -> np.ndarray:
        """The parent's probability of each word in round n."""
        own = sorted((t for t in told if t["round"] == n), key=lambda t: t["home"])
        customers, tables = (np.concatenate([_unpacked(t[c], np.uint32) for t in own]).astype(float) for c in ("customers", "tables"))
        k = self.known
        base = (STRENGTH[1] + k["d1"] * k[f"root{n}"]) / (k["V"] + 1)
        return (customers - k["d1"] * tables + base) / (STRENGTH[1] + k[f"customers{n}"])

    def sweeps(self, told: list[dict], rounds: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(round, sweep, tables of each pair, parent's probabilities) after each sweep. Parties of a round are seated given the tables
        that their context had in all before the round, whether one server holds the context or several."""
        d, tables = self.known["d"], np.minimum(self.count, 1)
        some = np.flatnonzero(self.count > 1)
        key = common.mix(self.words[self.word[some]] + self.contexts[self.context[some]] * np.uint64(0xD1B54A32D192ED03))
        for n in range(rounds):
            parent = self.parent(told, n)
            mass = (STRENGTH[0] + d * self.totals(tables, f"t{n}")[self.context[some]]) * parent[self.word[some]]
            for s in range(SWEEPS):
                tables = tables.copy()
                tables[some] = seat(self.count[some], mass, d, key + np.uint64((n * SWEEPS + s) * 1_000_003))
                yield n, s, tables, parent


def _sums(known: dict, rounds: int):
    """(kind, values) sums over a task's servers: before any round counts, later the tables of hot contexts (in the order of their
    hashes), after the last round those of each of its sweeps."""
    hot = np.array(sorted(known["hot"]), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def add(kind: str, s: _Server, values: np.ndarray) -> None:
            sums = total.setdefault(kind, np.zeros(len(hot), np.int64))
            sums[np.searchsorted(hot, s.contexts[s.hot])] += values[s.hot].astype(np.int64)

        def count(kind: str, n) -> None:
            total[kind] = total.get(kind, np.zeros(1, np.int64)) + int(n)

        for batch in batches:
            for row in batch.to_pylist():
                s = _Server(row, known)
                if rounds:
                    for n, sweep, tables, _ in s.sweeps(row["told"], rounds):
                        if n == rounds - 1 == ROUNDS - 1 and len(s.hot):
                            add(f"s{sweep}", s, np.bincount(s.context, weights=tables, minlength=len(s.contexts)))
                else:
                    tables = np.minimum(s.count, 1)
                    own = np.bincount(s.context, weights=s.count, minlength=len(s.contexts))
                    count("N", own.sum())
                    count("one", np.sum(s.count == 1))
                    count("two", np.sum(s.count == 2))
                    add("c", s, own)
                    own[s.hot] = 0
                    count("V", np.sum(own > 0))
                add(f"t{rounds}", s, np.bincount(s.context, weights=tables, minlength=len(s.contexts)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["kind", "values"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of each kind added up."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for kind, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = np.frombuffer(values, np.int64)
            total[kind] = total[kind] + values if kind in total else values
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["kind", "values"])


def _sent(known: dict, rounds: int, homes: int):
    """What each server sends the parent: for its words, in ranges of their hashes, how many tables they have here."""
    schema = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("customers", pa.binary())])
    edges = np.array([(b << 48) // homes for b in range(1, homes)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _Server(row, known)
                tables = np.minimum(s.count, 1)
                if rounds:
                    *_, (_, _, tables, _) = s.sweeps(row["told"], rounds)
                customers = np.bincount(s.word, weights=tables, minlength=len(s.words)).astype(np.uint32)
                cuts = np.concatenate(([0], np.searchsorted(s.words, edges), [len(s.words)]))
                out = [{"home": h, "bucket": row["bucket"], "words": _six(s.words[x:y]), "customers": _packed(customers[x:y])} for h, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


TOLD = "bucket int, round int, home int, customers binary, tables binary, k long, r long, one long, two long"


def _parents(known: dict, n: int):
    """The parent's parties in a range of hashes: their customers and tables go back to each server that asked, in its order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        words = [_from_six(w) for w in rows["words"]]
        vocab, at = np.unique(np.concatenate(words), return_inverse=True)
        customers = np.bincount(at, weights=np.concatenate([_unpacked(c, np.uint32) for c in rows["customers"]]), minlength=len(vocab)).astype(np.int64)
        mass = np.full(len(vocab), (STRENGTH[1] + known.get("d1", 0.5) * known.get(f"root{n - 1}", known["V"])) / (known["V"] + 1))
        tables = seat(customers, mass, known.get("d1", 0.5), common.mix(vocab + np.uint64(n + 17)))
        cuts = np.cumsum([0, *map(len, words)])
        back = [[_packed(x[at[a:b]].astype(np.uint32)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (customers, tables)]
        first = np.arange(len(rows)) == 0  # the range's sums, told once
        sums = {"k": customers.sum(), "r": tables.sum(), "one": np.sum(customers == 1), "two": np.sum(customers == 2)}
        return pd.DataFrame({"bucket": rows["bucket"], "round": n, "home": rows["home"], "customers": back[0], "tables": back[1], **{c: first * int(v) for c, v in sums.items()}})

    return run


def _discount(one: int, two: int) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


def _answers(known: dict):
    """For each batch that asked, log10 probabilities of its pairs, and training counts of their contexts."""
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("scores", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _Server(row, known)
                total = np.zeros(len(s.count))
                for n, sweep, tables, parent in s.sweeps(row["told"], ROUNDS):
                    if n == ROUNDS - 1:
                        seated = s.totals(tables, f"s{sweep}")
                        total += (s.count - known["d"] * tables + (STRENGTH[0] + known["d"] * seated[s.context]) * parent[s.word]) / (STRENGTH[0] + s.n[s.context])
                score = np.log10(total / SWEEPS).astype(np.float32)
                for ref in s.refs:
                    pairs = np.cumsum(_unpacked(ref["pairs"], np.uint32).astype(np.int64))
                    own = s.context[pairs]
                    new = np.concatenate(([True], own[1:] != own[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array([ref["batch"]]), pa.array([row["bucket"]], pa.int32()), pa.array([_packed(score[pairs])], pa.binary()), pa.array([_packed(s.n[own[new]].astype(np.uint32))], pa.binary())], schema=schema)

    return run


def _scored(hot: np.ndarray, buckets: int, known: dict):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Batch(row, hot, buckets)
                score, count = np.empty(len(b.word)), np.zeros(len(b.words), np.int64)
                for told in row["told"]:
                    x, y = b.cuts[told["bucket"]], b.cuts[told["bucket"] + 1]
                    score[x:y] = _unpacked(told["scores"], np.float32)
                    count[np.unique(b.context[x:y])] = _unpacked(told["counts"], np.uint32)
                base = np.log10((count + 0.5) / (known["N"] + 0.5 * (known["V"] + 1)))
                at = np.concatenate(([0], np.cumsum(b.lengths)[:-1]))
                n_known, base, score = (np.add.reduceat(x, at) for x in ((count > 0)[b.ids].astype(np.int64), base[b.ids], score[b.pair]))
                held = [held_out(d) for d in row["doc_ids"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(held), pa.array(b.lengths, pa.int64()), pa.array(n_known), pa.array([known["N"]] * len(held), pa.int64()), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / b.lengths))], schema=schema)

    return run


def _kept_by(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows, written in buckets by key: they join what comes back to them without being moved again."""
    spark, name = rows.sparkSession, f"lm_{key}_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", common.new_path(spark, f"lm-{key}")).saveAsTable(name)
    return spark.table(name)


def _with_told(rows: DataFrame, told: DataFrame, key: str) -> DataFrame:
    columns = [c for c in told.columns if c != key]
    return rows.join(told.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("told")), key)


def document_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of docs (doc_id, text).

    Learns from documents whose crc32(doc_id) mod 5 is not 1; a null doc_id is learned from. Null and empty texts hold only the
    end token; repeated rows each count and each get a row. Without training documents every word is unknown.
    """
    spark = docs.sparkSession
    partitions = common.partitions(spark)
    buckets = 2 * partitions
    state = _kept_by(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.trimmed(_tokenised(buckets)), STATE), "batch", partitions)
    # contexts with more than a quarter of a server's share of tokens: 4 * buckets at most
    often = state.select(F.explode("often").alias("o")).groupBy("o.word").agg(F.sum("o.n").alias("n"))
    tokens = state.agg(F.sum(F.aggregate("often", F.lit(0).cast("long"), lambda a, o: a + o["n"]))).collect()[0][0] or 0
    hot = np.sort(np.array([r["word"] for r in often.where(F.col("n") > tokens // (4 * buckets)).select("word").collect()], np.int64).astype(np.uint64))
    slim = state.drop("often")
    asked = slim.mapInArrow(common.trimmed(_requests(hot, buckets)), ASKED)
    model = _kept_by(asked.groupBy("bucket").applyInPandas(common.trimmed_group(_merge), MODEL), "bucket", partitions)

    known: dict = {"hot": {int(v): {} for v in hot}, "N": 0, "V": 0}

    def gather(rows: DataFrame, rounds: int) -> dict:
        sums = rows.mapInArrow(common.trimmed(_sums(known, rounds)), "kind string, values binary")
        got = {r["kind"]: np.frombuffer(bytes(r["values"]), np.int64) for r in sums.repartition(partitions, "kind").mapInArrow(_added, "kind string, values binary").collect()}
        for kind, values in got.items():
            if kind in ("c", f"t{rounds}", *(f"s{k}" for k in range(SWEEPS))):
                for v, n in zip(sorted(known["hot"]), values.tolist(), strict=True):
                    known["hot"][v][kind] = n
        return {kind: int(v[0]) for kind, v in got.items() if kind in ("N", "one", "two", "V")}

    first = gather(model, 0)
    homes = -(-(model.agg(F.sum(F.octet_length("words"))).collect()[0][0] or 0) // (6 * HOME_WORDS)) or 1
    known |= {"N": first.get("N", 0), "V": first.get("V", 0) + sum(h.get("c", 0) > 0 for h in known["hot"].values()), "d": _discount(first.get("one", 0), first.get("two", 0))}
    told = None
    for n in range(ROUNDS):
        rows = model if told is None else _with_told(model, told, "bucket")
        if n and len(hot):
            gather(rows, n)
        sent = rows.mapInArrow(common.trimmed(_sent(known, n, homes)), "home int, bucket int, words binary, customers binary")
        now = common.written(sent.groupBy("home").applyInPandas(common.trimmed_group(_parents(known, n)), TOLD), "lm-told")
        sums = now.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("k", "r", "one", "two")]).collect()[0]
        known |= {f"customers{n}": sums["k"], f"root{n}": sums["r"]}
        if n == 0:
            known["d1"] = _discount(sums["one"], sums["two"])
        now = now.select("bucket", "round", "home", "customers", "tables")
        told = now if told is None else told.unionByName(now)
    if len(hot):
        gather(_with_told(model, told, "bucket"), ROUNDS)
    answers = _with_told(model, told, "bucket").mapInArrow(common.trimmed(_answers(known)), "batch long, bucket int, scores binary, counts binary")
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return _with_told(slim, answers, "batch").mapInArrow(common.trimmed(_scored(hot, buckets, known)), shape)
