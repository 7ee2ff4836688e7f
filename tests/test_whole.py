"""Queries that do the whole job where the ones with SQL take a part: against brute force on small fixtures."""

import re

import numpy as np
import pytest

from brinework.operators import search, text
from brinework.plans import registry


def by_hand(raw):
    out = (raw or "").replace("\r\n", "\n").replace("\xa0", " ")
    out = re.sub(r"(?<!\n)\n(?!\n)", " ", re.sub(r"[ \t]+", " ", out))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def test_all_documents_are_normalized(spark, tmp_path):
    texts = ["a\nb\nc", "one\n\ntwo", None, "", "x\n\n\n\ny\r\nz", "\n-\n", " lead\t\t\xa0end \n", "- \n1\n2\n\n3"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.normalized for r in registry.QUERIES["k01_normalized_all_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def neighbours(x, q, k, floor):
    """(row, similarity) of the k nearest, ties by row."""
    near = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
    return sorted(((i, s) for i, s in enumerate(near) if s >= floor), key=lambda r: (-round(r[1], 12), r[0]))[:k]


def test_kinds_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "GROUP", 3)
    monkeypatch.setattr(search, "FEW", 4)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(6, 12))[rng.integers(0, 6, 250)] + 0.05 * rng.normal(size=(250, 12)), np.repeat(rng.normal(size=(1, 12)), 30, axis=0)])
    kinds = [["a", "b", None][i % 3] for i in range(len(x))]
    rows = [(i, v.tolist(), kinds[i]) for i, v in enumerate(x)] + [(900, None, "a"), (901, [0.0] * 12, "a"), (902, [float("nan")] * 12, "a"), (903, [None] * 12, "a"), (904, [1.0, 2.0], "a"), (905, [], "b")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, doc_kind string")
    asked = [(i, x[i].tolist(), k) for i, k in ((0, None), (3, "a"), (4, "b"), (260, None), (261, "a"), (7, "none"), (100, "b"))] + [(800, [0.0] * 12, None), (801, None, None), (802, [2.0, 4.0], None)]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>, doc_kind string")
    found, counted = search.Index(vectors, pivots=6).search(queries, 4, 0.3)
    want = {}
    for q, _, kind in asked[:7]:
        near = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        hits = sorted((-round(s, 12), i) for i, s in enumerate(near) if s >= 0.3 and kind in (None, kinds[i]))[:4]
        want |= {(q, n): i for n, (_, i) in enumerate(hits, 1)}
    assert {(r.query_id, r.rank): r.vec_id for r in found.collect()} == want | {(802, 1): 904}
    assert 0 < counted.first()[0] < 0.7 * 7 * len(x)  # far clusters are not compared
    assert search.search(vectors.where("false"), queries).count() == 0 and search.search(vectors, queries.where("false")).count() == 0


@pytest.mark.parametrize("block", [2, 1000])
def test_every_50th_vector_is_asked(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(search, "GROUP", block)
    monkeypatch.setattr(search, "BLOCK", 10 * block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(320, 8)).astype(np.float32).astype(float)
    x[7], x[201] = x[50], x[50]  # ties
    labels = [int(v) for v in rng.integers(0, 6, 320)]
    labels[100] = 99  # nothing else is relevant
    spark.createDataFrame([(i, v.tolist(), labels[i]) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.rank): (r.vec_id, r.similarity) for r in registry.QUERIES["k05_vector_search_every_50th"](spark, str(tmp_path)).collect()}
    want = {(q, n): r for q in range(0, 320, 50) for n, r in enumerate(neighbours(x, q, 3, 0.2), 1)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-3 for k in want)
    first = [next((n for n, (i, _) in enumerate(neighbours(x, q, 10, -1.0), 1) if i != q and labels[i] == labels[q]), None) for q in range(0, 320, 50) if q != 100]
    r = registry.QUERIES["k08_retrieval_quality_every_50th"](spark, str(tmp_path)).first()
    assert r.queries == 6
    assert abs(r.recall_at_k - np.mean([n is not None and n <= 3 for n in first])) < 1e-3 and abs(r.mrr - np.mean([1 / n if n else 0 for n in first])) < 1e-3


def test_all_kinds_are_detected(spark, tmp_path):
    texts = [
        "a@b.org, a@b.org and 123-45-6789; Password: hunter2 api_key=xyz",
        "card 4111 1111 1111 1111, call (743) 555-3824 or +1 743-555-3824",
        None, "", "nothing, 12 of them", "token = t0 secret:s1 c.d@e.net",
    ]
    want = {(i, kind, m[0]) for i, t in enumerate(texts) for kind, p in text.PII.items() for m in re.finditer(p, t or "")}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.QUERIES["r18_detected_all_kinds"](spark, str(tmp_path)).collect()]
    assert {k for _, k, _ in got} == set(text.PII) and len(got) == len(set(got)) and set(got) == want
