"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of a text (lengths, shares of character classes, repetition of words and lines) are standardised and mapped by
z = sqrt(2 / D) cos(W x + b), which approximates a Gaussian kernel. Each partition sums its z z' and z y; the sums of all
partitions are the normal equations, solved once. Ridge scores are calibrated by pool-adjacent-violators over a histogram of
BINS bins, which holds every training row at any size. All that reaches the driver is D x D sums and the histogram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm import common

D, GAMMA, RIDGE, BINS = 160, 0.25, 1e-3, 2048

#: Classes of bytes whose shares are statistics.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "|\t", "#$%&*+=<>@^~_\\/", "\"'()[]{}-`"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[0x80:] = len(_CLASSES) + 1
N_STATS = len(_CLASSES) + 2 + 11


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of N_STATS numbers for each text; nulls count as empty."""
    out = np.zeros((len(texts), N_STATS))
    k = len(_CLASSES) + 2
    for first, _, words, bounds in common.hashed_words(texts):
        for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), first):
            data = texts[i] or b""
            n, w = len(data), e - s
            if n:
                out[i, :k] = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=k) / n
            out[i, k] = np.log1p(n)
            out[i, k + 1] = np.log1p(w)
            if not w:
                continue
            h = words[s:e]
            counts = np.diff(np.flatnonzero(np.concatenate(([True], (x := np.sort(h))[1:] != x[:-1], [True]))))
            lines = data.split(b"\n")
            last = np.frombuffer(data, np.uint8)
            out[i, k + 2] = (n - out[i, 3] * n) / w  # bytes a word
            out[i, k + 3] = len(counts) / w
            out[i, k + 4] = counts.max() / w
            out[i, k + 5] = np.log(len(counts)) / np.log(w) if w > 1 else 1.0  # how the vocabulary grows
            out[i, k + 6] = np.mean(h[1:] == h[:-1]) if w > 1 else 0.0
            out[i, k + 7] = 1 - len(set(lines)) / len(lines)
            out[i, k + 8] = np.log1p(n / len(lines))
            p = counts / w
            out[i, k + 9] = -(p * np.log(p)).sum()
            out[i, k + 10] = np.mean(_CLASS[last[1:]] != _CLASS[last[:-1]]) if n > 1 else 0.0
    return out


@dataclass
class QualityModel:
    """mean and scale of the statistics, ridge weights of the Fourier features, and the calibration's knots."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_STATS))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_STATS))
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    seed: int = 11

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(0, np.sqrt(2 * GAMMA / N_STATS), (N_STATS, D)), rng.uniform(0, 2 * np.pi, D)
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / D) * np.cos(x @ w + b)
        return np.hstack((z, np.ones((len(z), 1))))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """From 0 to 1, higher where label 1 is likelier; 0.5 for all if there were no training rows."""
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), *self.knots), 0.0, 1.0)


def _stats():
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(common.as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), N_STATS).cast(pa.list_(pa.float64()))], schema=schema)

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy().reshape(-1, N_STATS) if len(column) else np.zeros((0, N_STATS))


def _normal_equations(model: QualityModel):
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((D + 1, D + 2))
        for batch in batches:
            z, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.hstack((z, y[:, None]))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], schema=schema)

    return run


def _raw(model: QualityModel):
    schema = pa.schema([("raw", pa.float64()), ("y", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], schema=schema)

    return run


def _isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit to mean y at x with weights n (x ascending), by pooling adjacent violators."""
    pools: list[list[float]] = []  # [sum of n y, sum of n, sum of n x]
    for a, b, c in zip(x, y, n, strict=True):
        pools.append([b * c, c, a * c])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of docs (doc_id, text), written."""
    return common.written(docs.select("doc_id", "text").mapInArrow(common.trimmed(_stats()), "doc_id long, stats array<double>"), "statistics")


def held_out(doc_id) -> F.Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on the statistics (doc_id, stats) of rows that are not held out and have a label (doc_id, quality of 0 or 1)."""
    model = QualityModel()
    rows = stats.join(labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("quality in (0, 1)"), "doc_id")
    rows = common.written(rows.where(~held_out(F.col("doc_id"))).select("stats", "y"), "training")
    sums = rows.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not sums:
        return model
    for r in sums:
        model.mean[r["k"]], model.scale[r["k"]] = r["m"], max(r["s"], 1e-6)
    total = np.zeros((D + 1, D + 2))
    parts = rows.mapInArrow(common.trimmed(_normal_equations(model)), "i int, j int, value double")
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        total[r["i"], r["j"]] = r["value"]
    n = total[D, D]
    model.weights = np.linalg.solve(total[:, : D + 1] + RIDGE * n * np.diag([*[1.0 / D] * D, 0.0]), total[:, D + 1])
    raw = rows.mapInArrow(common.trimmed(_raw(model)), "raw double, y int")
    bins = F.floor((F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) + 0.5) * (BINS / 2)).cast("int")
    held = raw.groupBy(bins.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    x, y, c = (np.array([float(r[k]) for r in held]) for k in ("x", "y", "n"))
    model.knots = _isotonic(x, y, c)
    return model


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for each row of the statistics."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], schema=schema)

    return stats.mapInArrow(common.trimmed(run), "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text). Null and empty texts are scored like any other;
    rows of labels that are null or neither 0 nor 1 are not learned from; without training rows every score is 0.5."""
    stats = document_statistics(docs)
    out = scored(stats, fit(stats, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all their columns, that score at least the threshold."""
    model = fit(document_statistics(docs), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = model.score(statistics(common.as_bytes(batch.column(at)))) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(common.trimmed(run), docs.schema)
