"""Separator scan: documents of flat, unindexed token files, found by their end identifiers.

A flat file is a run of fixed-width ids, cut into blocks without regard to documents. Each block is searched at once (numpy),
which gives its separators' places; sums and maxima over the blocks before it (a prefix scan, as a window over small block
summaries) turn those into document numbers and starts, so a document may span any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.llm import common
from brinework.llm.bytebpe import encoder

#: Ids in a block.
BLOCK_IDS = 1 << 20
BLOCKS = "file int, block int, ids binary, doc_ids array<long>"


def _flatten(vocabulary: str, separator: int, block_ids: int):
    schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def row(file: int, block: int | None, ids: bytes | None, docs: list | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": file, "block": block, "ids": ids, "doc_ids": docs}], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, True).encode, np.uint16(separator).tobytes()
        file, block, held, docs = TaskContext.get().partitionId(), 0, bytearray(), []
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s in range(0, len(texts), 256):
                for ids in encode(texts[s : s + 256]):
                    held += ids
                    held += end
                while len(held) >= 2 * block_ids:
                    yield row(file, block, bytes(held[: 2 * block_ids]), None)
                    del held[: 2 * block_ids]
                    block += 1
            yield row(file, None, None, batch.column(0).to_pylist())
        if held:
            yield row(file, block, bytes(held), None)

    return run


def flat_files(docs: DataFrame, vocabulary: str, separator: int = 50256, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes docs (doc_id, text) as flat files of 16-bit ids, one for each input partition, each document followed by the
    separator, which no text encodes to. Rows with ids are blocks (file, block, ids), cut anywhere. Rows without tell, in
    order, which documents a file was written from; they hold no places. Null texts are empty documents."""
    rows = docs.select("doc_id", "text").mapInArrow(_flatten(vocabulary, separator, block_ids), BLOCKS)
    path = common.new_path(docs.sparkSession, "flat")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(BLOCKS).parquet(path)


def read_flat(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (file, block, ids) of raw binary files of little-endian ids; each file up to 2 GB, as Spark's binary source reads. A
    file's task cuts it; its bytes are not copied for each block."""
    step = width * block_ids
    schema = pa.schema([("file", pa.string()), ("block", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                for block, at in enumerate(range(0, data.size, step)):
                    part = data.slice(at, min(step, data.size - at))
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int32()), pa.array([part.to_pybytes()], pa.binary())], schema=schema)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, "file string, block int, ids binary")


def _search(separator: int, width: int):
    schema = pa.schema([("n", pa.int64()), ("at", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = [], []
            for x in batch.column(2):
                ids = np.frombuffer(x.as_buffer(), f"<u{width}") if x.is_valid else np.zeros(0, "<u2")
                n.append(len(ids))
                at.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int64()))], schema=pa.schema([batch.schema.field(0), batch.schema.field(1), *schema]))

    return run


def scan(blocks: DataFrame, separator: int = 50256, width: int = 2) -> DataFrame:
    """(file, number, start, n_tokens, ended) for each document of the blocks (file, block, ids): its place in the file's order,
    the place of its first id, its ids without the separator, and whether a separator ends it (only a file's last may lack one).

    Null or empty blocks hold nothing; consecutive separators are empty documents; an empty table has none.
    """
    kind = dict(blocks.dtypes)["file"]
    found = blocks.select("file", "block", "ids").mapInArrow(_search(separator, width), f"file {kind}, block int, n long, at array<long>")
    found = common.written(found, "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    # the scan runs over a few numbers of each block; the separators' places stay where they are
    x = found.select("file", "block", "n", F.size("at").alias("k"), F.when(F.size("at") > 0, F.element_at("at", -1)).alias("last"))
    x = x.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("number", F.coalesce(F.sum("k").over(before), F.lit(0)))
    x = x.withColumn("last", F.col("base") + F.col("last"))
    x = x.withColumn("carry", F.coalesce(F.max("last").over(before), F.lit(-1)))
    x = x.withColumn("more", F.coalesce(F.sum("n").over(after), F.lit(0))).drop("n", "k")
    x = found.join(common.written(x, "scanned"), ["file", "block"])
    end = F.col("base") + F.col("n")
    tail = F.when((F.col("more") == 0) & (F.greatest("carry", F.coalesce("last", F.lit(-1))) + 1 < end) & (F.col("n") > 0), F.array(end)).otherwise(F.array().cast("array<long>"))
    ends = F.transform("at", lambda p: p + F.col("base"))
    x = x.select("file", "number", "carry", ends.alias("ends"), F.posexplode(F.concat(ends, tail)).alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    return x.select("file", (F.col("number") + F.col("k")).alias("number"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("k") < F.size("ends")).alias("ended"))


def document_token_counts(docs: DataFrame, vocabulary: str, separator: int = 50256) -> DataFrame:
    """(doc_id, file, number, start, n_tokens): docs written as flat files, which are then scanned. Repeated rows each get a row."""
    flat = flat_files(docs, vocabulary, separator)
    found = scan(flat.where("block is not null"), separator)
    batches = Window.partitionBy("file").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    named = flat.where("block is null").select("file", "doc_ids", F.monotonically_increasing_id().alias("order"))
    named = named.withColumn("before", F.coalesce(F.sum(F.size("doc_ids")).over(batches), F.lit(0)))
    named = named.select("file", "before", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("before") + F.col("k")).alias("number"), "doc_id")
    return found.join(named, ["file", "number"], "left").select("doc_id", "file", "number", "start", "n_tokens")
