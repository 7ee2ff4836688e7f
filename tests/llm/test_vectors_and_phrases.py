"""Top-k search, hard negatives and collocations against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brinework.llm import collocations, dual_tree, pitman_yor, pivot_search, tiles


def whole(v):
    """floor(256 * x) without overflow, or None if the vector takes no part."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v]


def ranked(s):
    """Scores are told apart up to 34 digits."""
    return max(1 - 10**34, min(10**34 - 1, s))


def clipped(s):
    return max(-(2**63), min(2**63 - 1, s))


def order(i):
    return (i is None, i or 0)


def vectors(rng, n, dim, kind):
    """Clusters, copies, repeated rows, ties, several lengths, and vectors that take no part."""
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dim))
    x = [list(map(float, v)) for v in x.astype(np.float32 if kind == "float" else np.float64)]
    rows = [(i, x[i], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, x[0], 1) for i in range(25)] + [(100, x[100 % n], 2)] * 2 + [(50, x[3], 0), (None, x[0], 1), (None, x[5], 1)]
    rows += [(2000, None, 1), (2050, [math.nan] * dim, 1), (2100, [1.0, None], 1), (2150, [math.inf] + [0.0] * (dim - 1), 1)]
    rows += [(3000, [0.0] * dim, 1), (3050, [], 1), (3051, [], 2), (3100, [1.0, -0.5], 1), (3101, [0.25, 0.25], 1), (3102, [0.25, 0.75], 3), (3103, [2.0, 1.0], 1), (3150, [-3.0] * dim, None)]
    return rows


def frame(spark, rows, kind):
    return spark.createDataFrame([(i, v, y, "a", 7) for i, v, y in rows], f"vec_id long, embedding array<{kind}>, label int, cls string, block int")


def brute_top(rows, k):
    ints, out = [(i, whole(v)) for i, v, _ in rows], []
    for a, (q, x) in enumerate(ints):
        if x is None or q is None or q % 50:
            continue
        found = sorted(((-ranked(sum(p * r for p, r in zip(x, y, strict=True))), order(i)), i) for b, (i, y) in enumerate(ints) if b != a and y is not None and len(y) == len(x))
        out += [(q, n, i, clipped(-s)) for n, ((s, _), i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("kind", "huge"), [("float", False), ("double", True)])
def test_top_k(spark, monkeypatch, kind, huge):
    rng = np.random.default_rng(2)
    rows = vectors(rng, 300, 8, kind)
    if huge:
        rows += [(4000, [1e12] * 8, 1), (4050, [-1e300] + [0.5] * 7, 1), (4051, [2.5e14, 1.0] + [0.0] * 6, 2)]
    for name, value in (("BLOCK", 16), ("GROUP", 4), ("RUN", 2), ("MANY", 5)):
        monkeypatch.setattr(tiles, name, value)
    df = frame(spark, rows, kind)
    got = sorted([tuple(r) for r in pivot_search.top_k(df, F.col("vec_id") % 50 == 0, k=5, pivots=7).collect()], key=str)
    assert got == brute_top(rows, 5)
    assert pivot_search.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert pivot_search.top_k(df.where("vec_id is null or vec_id % 50 <> 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_far_annuli_are_skipped(spark):
    """Rows of far clusters are ruled out by the triangle inequality, without being compared."""
    rng = np.random.default_rng(3)
    centres = np.linalg.qr(rng.normal(size=(32, 32)))[0][:12]
    x = np.repeat(centres, 200, axis=0) + 0.01 * rng.normal(size=(2400, 32))
    scale = tiles.Scale(tiles.integer_rows(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.lit(False)))
    packed = tiles._packed(x)
    f = tiles.floats(tiles.ints(packed, 32), scale.unit)
    most = float((f * f).sum(axis=1).max())
    pivots = pivot_search.means(np.column_stack((f, pivot_search.lifted(f, most))), 12)
    bounds = pivot_search.annulus_bounds(most, pivots)
    ask = pa.table({"dim": pa.array([32], pa.int32()), "vec": pa.array(packed[:1], pa.binary()), "label": [0], "cls": pa.array([b"q"], pa.binary()), "marks": pa.array([None], pa.list_(pa.int64())), "lows": pa.array([None], pa.list_(pa.int64()))})
    search = tiles.Search(ask, scale, 6, "any", "top", 0, 0)
    d = pivot_search._from_pivots(f, pivot_search.lifted(f, most), pivots)
    for p in np.argsort(d[0]):
        rows = np.flatnonzero(d.argmin(axis=1) == p)
        block = pa.table({"pivot": np.full(len(rows), p, np.int32), "dist": d[rows, p], "vec": pa.array([packed[i] for i in rows], pa.binary()), "label": np.zeros(len(rows), np.int64), "id": rows, "cls": pa.array([b"%d" % i for i in rows], pa.binary())})
        search.block(block, *bounds(search, block, None))
    scores = tiles.product(tiles.ints(packed[:1], 32), tiles.ints(packed, 32))[0]
    assert sorted(search.score.tolist()) == sorted(scores.tolist())[-6:] and search.compared < 600


def brute_negatives(rows, positives, negatives, every):
    ints = [(i, whole(v), y) for i, v, y in rows]
    ints = [(i, v, y) for i, v, y in ints if v is not None and y is not None]
    dot = lambda a, b: sum(p * r for p, r in zip(a, b, strict=True))
    out = []
    for a, (q, x, y) in enumerate(ints):
        if q is None or q % every:
            continue
        others = sorted((-dot(x, v), order(i), i, z == y) for b, (i, v, z) in enumerate(ints) if b != a and len(v) == len(x))
        for s, _, i, _ in [o for o in others if o[3]][:positives]:
            found = [o for o in others if not o[3] and 30 * -s <= 100 * -o[0] <= 90 * -s][:negatives]
            out += [(q, i, n, o[2], clipped(-s), clipped(-o[0])) for n, o in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("kind", "huge"), [("float", False), ("double", True)])
def test_hard_negatives(spark, monkeypatch, kind, huge):
    rng = np.random.default_rng(7)
    rows = vectors(rng, 300, 8, kind)
    if huge:
        rows += [(4000, [1e12] * 8, 1), (4001, [4e11] * 8, 2), (4002, [9e11] * 8, 1), (4051, [-1e300] + [0.5] * 7, 3)]
    for name, value in (("RUN", 2), ("MANY", 5)):
        monkeypatch.setattr(tiles, name, value)
    for name, value in (("LEAF", 16), ("ANCHORS", 4), ("FAN", 3)):
        monkeypatch.setattr(dual_tree, name, value)
    df = frame(spark, rows, kind)
    got = sorted([tuple(r) for r in dual_tree.hard_negatives(df, F.col("vec_id") % 50 == 0, 5, 10).collect()], key=str)
    want = brute_negatives(rows, 5, 10, 50)
    assert got == want and len(want) > 100
    assert dual_tree.hard_negatives(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert dual_tree.hard_negatives(df.where("label is null"), F.col("vec_id") % 50 == 0).count() == 0


def test_balls_hold_their_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    directions, cuts = dual_tree.splits(x, 3)
    assert len(cuts) == 15 and np.isfinite(directions).all()
    parts = [x[i : i + 20] for i in range(0, 200, 20)]
    balls = [dual_tree._ball(p, np.zeros(len(p)), np.ones(len(p))) for p in parts]
    c, r = dual_tree._ball(np.array([b[0] for b in balls]), np.array([b[1] for b in balls]), np.full(10, 20))
    assert all((np.linalg.norm(p - b[0], axis=1) <= b[1]).all() for p, b in zip(parts, balls, strict=True)) and (np.linalg.norm(x - c, axis=1) <= r).all()


# --- collocations ---


def brute_phrases(rows, least, inside, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for key, a in f.items():
        lang, *w = key
        if len(w) == 1 or a < least:
            continue
        longer = [f[k] for k in f if len(w) == 2 and len(k) == 4 and k[0] == lang and f[k] >= least and (k[1:3] == tuple(w) or k[2:4] == tuple(w))]
        if any(100 * x >= inside * a for x in longer):
            continue
        s, k, left, right = min((10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for r, (s, a, p, x, y) in enumerate(sorted(v)[:first], 1))


@pytest.mark.parametrize(("first", "shard"), [(2000, 1 << 17), (5, 8)])
def test_collocations(spark, monkeypatch, first, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "ROWS", 1 if shard == 8 else 64)
    monkeypatch.setattr(collocations, "FAN", 2)
    rng = random.Random(5)
    vocab = ["the", "The", "of", "new", "york", "city", "é", "ÀB", "x\x85y", "a-b", "1", " ", "🙂", "ab"]
    rows = []
    for i in range(160):
        words = [rng.choice(vocab[: 4 + i % 10]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", ";x ", "!\r\n"]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    rows += [("en", None), ("fr", ""), ("fr", " . , "), (None, None), ("en", "new york " * 3000), ("de", "aaa"), ("en", "New York new york")] + [("es", "hola mundo. hola mundo")] * 6
    docs = spark.createDataFrame([(i, t, g, "p", 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, first=first).collect())
    want = brute_phrases(rows, 10, 50, first)
    assert got == want and len(want) > 15 and any(r[2] == "hola mundo" for r in got)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.where("text is null or lang = 'fr'")).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    h = [rng.integers(1, 2**63, 5000, dtype=np.uint64) for _ in range(3)]
    h[2][::2] = 0
    perfect = collocations.PerfectHash.of(collocations.PerfectHash.built(*h).row())
    slots = perfect.slots(*h)
    assert sorted(slots) == list(range(5000)) and all((perfect.h[i][slots] == h[i]).all() for i in range(3))
    assert (perfect.slots(h[0] + np.uint64(1), h[1], h[2]) == -1).all()
    none = collocations.PerfectHash.built(*[np.zeros(0, np.uint64)] * 3)
    assert (none.slots(*[x[:3] for x in h]) == -1).all() if none.sizes else True


def test_members_are_never_denied(spark):
    keys = np.random.default_rng(4).integers(-(2**62), 2**62, 3000)
    m = collocations.Members(3000)
    bits = m.array(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert m.has(bits, keys.view(np.uint64)).all() and m.has(bits, np.arange(10_000, dtype=np.uint64)).mean() < 0.1


def test_scores_are_exact(spark):
    rows = [(10, 10, 10), (3_000_000_000_000, 3_000_000_000_001, 4_000_000_000_007), (999_999_999_999, 999_999_999_999, 10**12), (12, 24_000_001, 12), (10**13, 10**13, 10**13)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in got)


# --- mended operators ---


def test_scores_do_not_hang_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(rng.randrange(0, 80)))) for i in range(120)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({r.doc_id: r.score for r in pitman_yor.document_scores(docs).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got[0]) == 120 and all(abs(got[0][d] - got[1][d]) <= 1e-9 * abs(got[0][d]) for d in got[0])


def test_found_personal_data_stays_out_of_columns(spark):
    docs = spark.createDataFrame([(1, "write to a.b@ex.co.uk", "KEEP", 5), (2, None, None, None), (3, "nothing", "KEEP", 6)], "doc_id long, text string, _entities string, _entities_ int")
    out = corpus_pipeline.personal_data(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert got[1]["_entities"] == "KEEP" and got[1]["_entities_"] == 5 and "a.b@ex.co.uk" not in str(tuple(got[1])) and got[2]["_entities"] is None and got[3].text == "nothing"
