"""Workers live on from stage to stage: what a stage hands to mapInArrow gives its freed memory back when the rows of a task end."""

from helpers import documents
from pyspark.sql import DataFrame

import corpus_pipeline
from brinework.llm import common


def test_stages_give_back_the_memory_of_their_workers(spark, monkeypatch):
    # of the class that the session's tables have, which is not the one that is imported from pyspark.sql
    kind, seen, given = type(spark.range(0)), [], []
    assert issubclass(kind, DataFrame)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, func, *a, **b: (seen.append((name, func)), plain(self, func, *a, **b))[1])
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        if name != "pii_surrogates":  # has no Python workers
            stage(spark, docs, "/root/testdata/sf0.001")
    assert {x for x, _ in seen} == {x for x, _ in corpus_pipeline.STAGES} - {"pii_surrogates"}
    monkeypatch.setattr(common, "_trim", lambda: given.append(1))
    for name, func in seen:
        given.clear()
        list(func(iter([])))
        assert given == [1], (name, func)
