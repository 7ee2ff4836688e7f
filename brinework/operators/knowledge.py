"""Documents on their way into the searchable knowledge: registration, review, ingestion, usage, and help topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.functions.scan import running_sums
from brinework.operators import text
from brinework.sources.store import written
from brinework.sources.versioned import VersionedTable

# Most documents and chunks that may be registered.
MAX_DOCUMENTS, MAX_CHUNKS = 200, 20_000


def registered(registry: DataFrame, uploads: DataFrame, chunks: int = 0, max_documents: int = MAX_DOCUMENTS, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """uploads (file_name, content, uploaded_by; with `received`, what orders them, else by file name; with `errors`, what validation
    found) as registry rows (doc_id, file_name, status, sha256, uploaded_by), each with `accepted` and, where it is not, `reason`.

    An upload is refused where the registry's documents that are not rejected, with those accepted before it, are as many as may be,
    or its chunks are; where validation found errors; and where the same content is registered or was accepted before."""
    used = registry.where("status <> 'rejected'").count()
    order = ["received", "file_name", "uploaded_by"] if "received" in uploads.columns else ["file_name", "uploaded_by"]
    x = uploads.withColumn("sha256", F.sha2("content", 256)).drop("content").withColumn("copy", F.monotonically_increasing_id())
    x = written(x, "uploads")
    fine = F.coalesce(F.size("errors"), F.lit(0)) == 0 if "errors" in uploads.columns else F.lit(True)
    known = registry.where("sha256 is not null").select("sha256", F.lit(True).alias("known")).distinct()
    first = x.where(fine).groupBy("sha256").agg(F.min(F.struct(*order, "copy")).alias("first"))
    x = x.join(known, "sha256", "left").join(first, "sha256", "left").withColumn("new", fine & F.col("known").isNull() & F.coalesce(F.struct(*order, "copy") == F.col("first"), F.lit(False))).drop("first")
    x = running_sums(x, [*order, "copy"], {"before": F.col("new").cast("long")})
    full = F.col("before") + used >= max_documents
    reason = F.when(full, "documents are full").when(F.lit(chunks >= max_chunks), "chunks are full")
    reason = reason.when(~fine, F.concat(F.lit("rejected: "), F.array_join("errors", "; "))) if "errors" in uploads.columns else reason
    reason = reason.when(~F.col("new"), "content is registered already")
    rows = x.select(F.concat(F.lit("up-"), F.substring("sha256", 1, 24)).alias("doc_id"), "file_name", F.lit("pending_review").alias("status"), "sha256", "uploaded_by", reason.alias("reason"), *[c for c in ("received",) if c in uploads.columns])
    return rows.withColumn("accepted", F.col("reason").isNull())


def reviewed(registry: DataFrame, reviews: DataFrame, chunks: DataFrame, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """The registry after reviews (doc_id, approve, reviewer), with `review_note`: only pending documents move; an approved one without
    chunks (it could not be ingested) stays pending, and so do those that come, in order of doc_id, when the chunks of what is
    approved before them are as many as may be."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    x = registry.join(reviews.select("doc_id", "approve"), "doc_id", "left").join(n, "doc_id", "left")
    waits = F.col("status") == "pending_review"
    x = x.withColumn("fits", F.coalesce(waits & F.col("approve") & F.col("n_chunks").isNotNull(), F.lit(False)))
    used = registry.where("status = 'approved'").join(n, "doc_id").agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0]
    x = running_sums(x, ["doc_id"], {"before": F.when(F.col("fits"), F.col("n_chunks"))})
    within = F.col("before") + used < max_chunks
    status = F.when(F.col("fits") & within, "approved").when(waits & ~F.coalesce(F.col("approve"), F.lit(True)), "rejected").otherwise(F.col("status"))
    note = F.when(F.col("fits") & ~within, "chunks are full").when(waits & F.col("approve") & F.col("n_chunks").isNull(), "nothing could be ingested")
    return x.select(*[status.alias("status") if c == "status" else F.col(c) for c in registry.columns], note.alias("review_note"))


def ingested(docs: DataFrame, strategy: str = "recursive") -> DataFrame:
    """(doc_id, chunk, chunks_in_doc, piece, kinds) of docs (doc_id, text): normalized, split, and personal data redacted."""
    chunks = text.chunked(docs.select("doc_id", text.normalized(F.col("text")).alias("text")), strategy)
    clean = text.redacted(chunks.withColumnRenamed("piece", "text"))
    return clean.select("doc_id", "chunk", "chunks_in_doc", F.col("clean").alias("piece"), "kinds")


def upserted_chunks(table: VersionedTable, docs: DataFrame, strategy: str = "recursive") -> DataFrame:
    """Ingests docs into the stored chunks (see chunk_table), all chunks of a document in place of those it had, and gives the registry's
    counters: (doc_id, n_chunks, n_redacted), documents without any chunk among them."""
    new = written(ingested(docs, strategy), "chunks")
    every = docs.select("doc_id").distinct()

    def how(old: DataFrame, ids: DataFrame) -> DataFrame:
        return old.join(ids, "doc_id", "left_anti").unionByName(new.select(*old.columns))

    table.change(every, how)
    counted = new.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.size("kinds") > 0).alias("n_redacted"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_chunks", "n_redacted")}
    return every.join(counted, "doc_id", "left").withColumns(zero)


def chunk_table(spark: SparkSession, path: str, buckets: int = 16) -> VersionedTable:
    return VersionedTable(spark, path).create("doc_id long, chunk int, chunks_in_doc int, piece string, kinds array<string>", ["doc_id"], buckets)


def health(monthly: DataFrame, registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of what the running system holds: monthly_rows, n_patterns, docs and chunks that can be searched, pending_review."""
    a = monthly.agg(F.count("*").alias("monthly_rows"), F.countDistinct("id_pattern").alias("n_patterns"))
    b = chunks.agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("chunks"))
    c = registry.agg(F.count_if(F.col("status") == "pending_review").alias("pending_review"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def usage(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents by state, chunks, and what is left of the quotas."""
    n = chunks.agg(F.count("*").alias("chunks"))
    x = registry.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "pending_review").alias("pending")).crossJoin(F.broadcast(n))  # one row each
    return x.withColumn("documents_left", F.greatest(MAX_DOCUMENTS - F.col("documents"), F.lit(0))).withColumn("chunks_left", F.greatest(MAX_CHUNKS - F.col("chunks"), F.lit(0)))


def matched_topics(questions: DataFrame, topics: DataFrame, limit: int = 1) -> DataFrame:
    """(question_id, topic_id, score, rank) for questions (question_id, question): topics (topic_id, keywords: array) by the total
    length of their keywords in the question, then the longest one, then topic_id. For topics of a caller's own; routing.routed() reads
    each question once for the fixed ones."""
    pairs = questions.join(topics.select("topic_id", F.explode("keywords").alias("k")), F.contains(F.lower(F.coalesce("question", F.lit(""))), F.col("k")))
    x = pairs.groupBy("question_id", "topic_id").agg(F.sum(F.length("k")).alias("score"), F.max(F.length("k")).alias("longest"))
    by = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("longest").desc(), "topic_id")
    return x.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).drop("longest")
