"""Document sources: text, html, csv, docx and pdf files as rows of (path, file_type, page, title, text, error)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from brinework.operators.text import html_text, html_title

LOADED = "path string, file_type string, page int, title string, text string, error string"
TEXT_TYPES, HTML_TYPES = ["txt", "md"], ["html", "htm"]


def file_type(path) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, file_type, content, length) of a folder's files, by Spark's own reader."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return read.load(folder).select("path", file_type(F.col("path")).alias("file_type"), "content", "length")


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
    return "\n".join("".join(re.findall(r"<w:t[^>]*>(.*?)</w:t>", p, re.S)) for p in paragraphs)


def _pdf(content: bytes) -> list[str]:
    from pypdf import PdfReader  # optional; without it a pdf becomes an error row

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, kind, content in zip(frame["path"], frame["file_type"], frame["content"], strict=True):
            try:
                pages = _pdf(content) if kind == "pdf" else [_docx(content)]
                out += [(path, kind, i, None, text, None) for i, text in enumerate(pages, 1)]
            except Exception as e:  # one bad file does not stop a folder: it becomes a row with its error
                out.append((path, kind, None, None, None, f"{type(e).__name__}: {e}"[:200]))
        yield pd.DataFrame(out, columns=["path", "file_type", "page", "title", "text", "error"])


def load_directory(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """A row for each page of each file; files of unknown types and those that cannot be read are rows with an error."""
    found = files(spark, folder, recursive)
    text = F.decode("content", "UTF-8")
    none = F.lit(None).cast("string")
    one = F.lit(1)
    plain = found.where(F.col("file_type").isin(TEXT_TYPES)).select("path", "file_type", one.alias("page"), none.alias("title"), text.alias("text"), none.alias("error"))
    html = found.where(F.col("file_type").isin(HTML_TYPES)).select("path", "file_type", one.alias("page"), html_title(text).alias("title"), html_text(text).alias("text"), none.alias("error"))
    binary = found.where(F.col("file_type").isin("docx", "pdf")).select("path", "file_type", "content").mapInPandas(_parsed, LOADED)
    other = found.where(~F.col("file_type").isin(*TEXT_TYPES, *HTML_TYPES, "docx", "pdf", "csv")).select("path", "file_type", F.lit(None).cast("int").alias("page"), none.alias("title"), none.alias("text"), F.concat(F.lit("unknown type "), "file_type").alias("error"))
    return plain.unionByName(html).unionByName(binary).unionByName(_csv_rows(found)).unionByName(other)


def _csv_rows(found: DataFrame) -> DataFrame:
    """A row for each row of each csv file, its number as page; a file that cannot be read is a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = pd.read_csv(io.BytesIO(content), dtype=str, keep_default_na=False)
                    texts = ["\n".join(f"{c}: {v}" for c, v in zip(rows.columns, r, strict=True)) for r in rows.itertuples(index=False)]
                    out = [(path, "csv", i, None, t, None) for i, t in enumerate(texts, 1)]
                except Exception as e:  # one bad file does not stop a folder: it becomes a row with its error
                    out = [(path, "csv", None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(out, columns=["path", "file_type", "page", "title", "text", "error"])

    return found.where("file_type = 'csv'").select("path", "content").mapInPandas(run, LOADED)


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A document for each row, as `column: value` lines."""
    rows = spark.read.option("header", True).csv(path)
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit(""))) for c in rows.columns]
    return rows.select(F.concat_ws("\n", *lines).alias("text"))


# What uploads are held against, and their types, sizes in bytes, and first bytes.
TYPE_OF = {"pdf": "pdf", "txt": "text", "md": "text", "html": "html", "htm": "html", "docx": "docx", "csv": "csv"}
MAX_BYTES = {"pdf": 25 << 20, "docx": 15 << 20, "csv": 10 << 20, "html": 5 << 20, "text": 5 << 20}
MIN_BYTES = 16
MAGIC = {"pdf": ["255044462D"], "docx": ["504B0304", "504B0506", "504B0708"]}
FORBIDDEN = ["4D5A", "7F454C46", "CAFEBABE", "CFFAEDFE", "2321", "1F8B", "425A68", "52617221", "377ABCAF", "D0CF11E0"]
MAX_CONTROL_SHARE = 0.10
MAX_ZIP_ENTRIES, MAX_ZIP_BYTES, MAX_ZIP_RATIO = 2000, 200 << 20, 120


@F.pandas_udf(ArrayType(StringType()))
def _archive_errors(contents: pd.Series) -> pd.Series:
    """What is wrong with a docx as an archive, by its directory alone; nothing is unpacked."""

    def one(content: bytes | None) -> list[str] | None:
        if content is None:
            return None
        try:
            entries = zipfile.ZipFile(io.BytesIO(content)).infolist()
        except (zipfile.BadZipFile, ValueError, NotImplementedError):
            return ["archive cannot be read"]
        names, unpacked = [e.filename for e in entries], sum(e.file_size for e in entries)
        tests = {
            "archive has too many entries": len(entries) > MAX_ZIP_ENTRIES,
            "archive unpacks to too many bytes": unpacked > MAX_ZIP_BYTES,
            "archive is packed too tightly": unpacked > MAX_ZIP_RATIO * len(content),
            "archive is no document": "[Content_Types].xml" not in names,
            "archive names paths outside itself": any(n.startswith("/") or ".." in n for n in names),
        }
        return [rule for rule, broken in tests.items() if broken]

    return contents.map(one)


def validated(found: DataFrame) -> DataFrame:
    """(path, file_type, errors): every rule that a file (path, file_type, content, length) breaks; of files of other types only
    that. Text is judged by its whole content: no NUL byte, and at most a tenth of it control characters. Archives are looked
    into only where nothing else is wrong."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_OF.items() for x in pair]), F.col("file_type"))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in MAX_BYTES.items() for x in pair]), kind)
    begins = lambda starts: F.exists(F.array(*map(F.lit, starts)), lambda x: F.hex(F.substring("content", 1, 5)).startswith(x))
    signed = F.when(kind == "pdf", begins(MAGIC["pdf"])).when(kind == "docx", begins(MAGIC["docx"]))
    characters = F.decode("content", "ISO-8859-1")  # one for each byte
    controls = F.length(characters) - F.length(F.regexp_replace(characters, r"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f\x7f-\x9f]", ""))
    binary = signed.isNull() & ((F.instr(characters, "\x00") > 0) | (controls > MAX_CONTROL_SHARE * F.length(characters)))
    forbidden = begins(FORBIDDEN)
    rules = {"file is empty or truncated": F.col("length") < MIN_BYTES, "file is too large": F.col("length") > limit, "content does not match its type": ~forbidden & ~F.coalesce(signed, F.lit(True)), "executable or packed content": forbidden, "text holds binary data": ~forbidden & binary}
    errors = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda e: e.isNotNull())
    x = found.withColumn("errors", F.when(kind.isNull(), F.array(F.lit("type is not accepted"))).otherwise(errors))
    archive = _archive_errors(F.when((kind == "docx") & (F.size("errors") == 0), F.col("content")))
    return x.select("path", "file_type", F.concat("errors", F.coalesce(archive, F.array().cast("array<string>"))).alias("errors"))
