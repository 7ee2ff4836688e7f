"""A training corpus from raw documents: quality, near-duplicates, decontamination, personal data, piece ids.

Every stage reads what its predecessor wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.llm import common
from brinework.llm.fourier_quality import accepted
from brinework.llm.hamming_join import mark, marked_duplicates
from brinework.llm.piece_sampling import sampled_pieces
from brinework.llm.queries import SURROGATE_KEY, vocabulary
from brinework.llm.suffix_array import decontaminated
from brinework.llm.surrogates import replaced


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Fourier classifier accepts. It is fitted on the labelled rows that are not held out."""
    return accepted(docs, common.table(spark, sf_dir, "labels"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the smallest doc_id.
    Documents that link with nothing, those without words among them, stay. Of repeated rows with the kept doc_id one stays; where a
    doc_id has texts of several groups, each text is kept or not by its own group."""
    found = marked_duplicates(docs, shingle=5, percent=80).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "root", "kept")
    gone = found.where("not kept").select("d", "m").distinct()
    rest = docs.join(gone.hint("shuffle_hash"), (docs["doc_id"] == gone["d"]) & (mark(docs["text"]) == gone["m"]), "left_anti")
    again = common.written(rest.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("d")), "repeated")
    if again.isEmpty():
        return rest
    many = rest.join(again, rest["doc_id"] == again["d"], "left_semi").dropDuplicates(["doc_id", "text"])
    # one column holds the whole row, so that no name of documents meets one of ours
    many = common.written(many.select(F.struct(*[many[c] for c in docs.columns]).alias("row"), "doc_id", "text", mark(many["text"]).alias("mark")), "several")
    roots = found.where("kept and root is not null").join(again, "d").select("d", "m", "root").distinct()
    many = many.join(roots, (many["doc_id"] == roots["d"]) & (many["mark"] == roots["m"]), "left")
    own = Window.partitionBy("doc_id", F.coalesce("root", many["text"].cast("binary"))).orderBy("text")
    many = many.withColumn("number", F.row_number().over(own)).where("number = 1").select("row.*")
    return rest.join(again, rest["doc_id"] == again["d"], "left_anti").unionByName(many)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten benchmark words."""
    return decontaminated(docs, common.table(spark, sf_dir, "benchmark"), window=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data."""
    found = "_entities"
    while found in docs.columns:  # what was found must not stand under a name of documents
        found += "_"
    return replaced(docs, SURROGATE_KEY, found).select(*docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the piece ids of a sampled segmentation, which decode to its text."""
    return sampled_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_surrogates", personal_data),
    ("sentencepiece_sampling", piece_ids),
]

#: The classifier and the sampled segmentations have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
