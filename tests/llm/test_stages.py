"""Kept rows of the pipeline's stages against brute force."""

import re

from helpers import SCHEMA, documents, low, prose, words

import corpus_pipeline
from brinework.llm.fourier_quality import quality_scores
from brinework.llm.piece_sampling import decoded_pieces
from brinework.llm.queries import vocabulary


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_kept(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    heads = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            heads[g] = min(heads.get(g, d), d)
    kept, nulls = {}, []
    for (d, t), g, x in zip(rows, group, sets, strict=True):
        if d is None:
            nulls.append((d, t))
        elif d == heads[g]:
            key = (d, g if x else t)
            kept[key] = min(kept.get(key, t), t) if t is not None else None
    return sorted([*nulls, *((k[0], t) for k, t in kept.items())], key=str)


def test_near_dedup_keeps_one_of_each_group(spark):
    a, b, c = prose(21, 100), prose(22, 100), prose(23, 100)
    rows = [(1, a), (5, a + " end"), (5, b), (6, b + " end"), (7, b), (8, c), (8, c), (8, c + " end"), (9, c), (10, None), (10, "")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=str)
    assert out.columns == docs.columns and got == brute_kept(rows)
    assert (5, b) in got and (5, a + " end") not in got and sum(d == 8 for d, _ in got) == 1


def test_near_dedup_of_mixed_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted([(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()], key=str) == brute_kept(rows)


def test_other_stages_keep_what_they_should(spark, tmp_path):
    docs = documents(spark)
    rows = sorted([(r.doc_id, r.text) for r in docs.collect()], key=str)
    spark.createDataFrame([(1, prose(1, 40)), (2, prose(99, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    windows = {tuple(w[i : i + 10]) for t in (prose(1, 40), prose(99, 12)) for w in [words(t)] for i in range(len(w) - 9)}
    clean = [(d, t) for d, t in rows if not any(tuple(w[i : i + 10]) in windows for w in [re.findall("[^\\x00-/:-`{-\\x7f]+", low(t))] for i in range(len(w) - 9))]
    pairs = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=str)
    assert pairs(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == clean != rows
    scores = quality_scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), threshold=0.3)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()) == sorted(str(r.doc_id) for r in scores.collect() if r.score >= 0.3)
    assert pairs(corpus_pipeline.personal_data(spark, docs, "")) == rows  # no personal data in it
    pieces = decoded_pieces(corpus_pipeline.piece_ids(spark, docs, ""), vocabulary("piece_bpe_32k.model"))
    assert all(r.decoded == r.text for r in pieces.collect()) and pairs(pieces) == rows


def test_stages_take_odd_rows_and_empty_tables(spark):
    """Nulls in any column, empty and blank texts, repeated rows, and columns that are named like the stages' own."""
    import corpus_pipeline
    from helpers import prose

    names = ["d", "m", "root", "kept", "row", "mark", "number", "_d", "_k", "pieces"]
    text = prose(9, 90)
    rows = [(1, text), (1, text), (1, text + " more"), (2, text), (3, None), (3, None), (None, text), (None, None), (4, ""), (5, " \n "), (6, prose(8, 40))]
    docs = spark.createDataFrame([(i, t, *([None] * len(names) if i is None else [f"{c}{i}" for c in names])) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        own = [c for c in docs.columns if c != "pieces" or name != "sentencepiece_sampling"]
        got = out.collect()
        assert set(docs.columns) <= set(out.columns) and len(got) <= len(rows), name
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got for c in own[2:]), name
        assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0, name
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "/root/testdata/sf0.001").collect()}
    assert {3, 4, 5, 6} <= kept and 2 not in kept
