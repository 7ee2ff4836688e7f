"""Plans whose work must grow no faster than their input."""

import io
from contextlib import redirect_stdout
from datetime import date

from pyspark.sql import functions as F

from brinework.operators import build, knowledge, rules, text, tools
from brinework.plans import registry
from brinework.sources.field import Field

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def test_documents_are_normalized_once_and_not_for_each_chunk(spark):
    docs = spark.createDataFrame([(1, "a  b\nc" * 300), (2, ""), (3, None), (4, "  ")], "doc_id long, text string")
    for strategy in ("fixed", "paragraphs"):
        chunks = text.chunked(docs.select("doc_id", text.normalized(F.col("text")).alias("text")), strategy)
        filters = [line for line in plan_of(chunks).partition("== Optimized Logical Plan ==")[2].splitlines() if "Filter" in line]
        assert not any("regexp_replace" in line for line in filters)
    rows = knowledge.ingested(docs, "fixed").collect()
    assert {r.doc_id for r in rows} == {1} and [r.chunk for r in sorted(rows)] == list(range(rows[0].chunks_in_doc))
    assert "".join(r.piece for r in sorted(rows)).replace(" ", "") == "abc" * 300


def physical(df) -> str:
    return plan_of(df).partition("== Physical Plan ==")[2]


def test_lineage_rows_are_neither_sorted_nor_dealt_again(spark):
    x = build.contrib_of(Field(spark, SF))
    assert "SortMergeJoin" not in physical(x)
    assert "REPARTITION_BY_NUM" in physical(x) and not [line for line in physical(x).splitlines() if "Exchange hashpartitioning" in line and "vrr_date" in line]
    # names are strings, which make Spark sort all rows where a sum over them is taken beside a name
    assert "SortAggregate" not in physical(build._day_sums(x))


def test_a_look_by_stretches_is_the_look_itself(spark):
    kind = "id_completion long, test_date date, pressure double, " + ", ".join(f"{p} double" for p in build.PROPERTIES)
    points = [[10.0, 20.0, 30.0], [10.0], [10.0, 10.0, 20.0], [None], [None, 5.0], [20.0, 10.0]]
    rows = [(c, date(2020, 1, 1), p, *[(p or 1.0) * k for k in range(1, 8)]) for c, ps in enumerate(points) for p in ps]
    pvt = spark.createDataFrame(rows, kind)
    windows = build.pvt_windows(pvt)
    asked = spark.createDataFrame([(None,), (5.0,), (10.0,), (12.5,), (20.0,), (25.0,), (30.0,), (31.0,), (float("nan"),), (float("inf"),), (float("-inf"),)], "pressure double")
    want = build.pvt_lookup(windows.select("id_completion", "points").crossJoin(asked))
    s, t = build.pvt_stretches(windows).crossJoin(asked), F.col("pressure")
    inside = (F.col("lo").isNull() | (t > F.col("lo"))) & (F.col("hi").isNull() | (t < F.col("hi")))
    s = s.where(F.when(t.isNull(), F.col("missing")).otherwise(~F.col("missing") & ((t == F.col("eq")) | (F.col("eq").isNull() & inside))))
    got = build._between_ends(s).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 6 * 11


def test_methods_of_rows_are_gathered_without_sorting_the_rows(spark):
    x = spark.createDataFrame([(1, 1, date(2020, 1, 1), m) for m in ("none", "exact", "none", "closest")], "id_pattern int, id_completion int, vrr_date date, pvt_method string")
    got = x.groupBy("id_pattern").agg(build.methods_of().alias("m"))
    assert got.first().m == ["closest", "exact", "none"]
    assert "ObjectHashAggregate" not in physical(got) and "SortAggregate" not in physical(got)
    contrib = build.contrib_of(Field(spark, SF))
    for made in (tools.completions(contrib), tools.lineage_rows(contrib)):
        assert "collect_set" not in physical(made)
    state = rules.input_state(contrib, Field(spark, SF).volumes, Field(spark, SF).factors)
    assert "collect_set" not in physical(state)


def test_verdicts_and_drafts_are_computed_once_for_all_writes(spark, monkeypatch):
    made = []
    kept = registry.written
    monkeypatch.setattr(registry, "written", lambda df, name: made.append(name) or kept(df, name))
    registry.QUERIES["j03_stored_audit"](spark, SF)
    registry.QUERIES["t17_submitted_drafts"](spark, SF)
    assert made == ["verdicts", "drafts"]


def test_recursive_chunks_reach_python_a_hundred_documents_at_a_time(spark):
    docs = spark.createDataFrame([(i, "One sentence of a text. " * 40) for i in range(300)] + [(300, None), (301, "")], "doc_id long, text string")
    chunks = text.chunked(docs, "recursive")
    assert "ArrowEvalPython" not in physical(chunks)
    want = text.recursive_pieces("One sentence of a text. " * 40)
    got = chunks.collect()
    assert {r.doc_id for r in got} == set(range(300)) and [r.piece for r in sorted(got) if r.doc_id == 7] == want
