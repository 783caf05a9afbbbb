"""Crawled pages and uploads as input."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.text import rejects_html, trim, url_part
from kbspark.sources.shared import arrow_files, make_folder, qualified

#: Upload types by extension or MIME type; all are read as UTF-8 text.
TEXT_EXTENSIONS = ("txt", "csv", "md", "rtf")
#: Uploads in a folder at most; Spark lists many folders in many tasks.
FOLDER_FILES = 1000


def site_domain(url: Column) -> Column:
    """The last three labels of the host: subdomains of a site belong to it."""
    return F.regexp_extract(url_part(url, 2), r"((?:[^.]+\.){0,2}[^.]+)$", 1)


def crawled_pages(raw: DataFrame) -> DataFrame:
    """``(domain, page_seq, url, html)`` of raw pages (``page_id, url, html`` and maybe ``content_type``) that
    are HTML text."""
    kind = F.col("content_type") if "content_type" in raw.columns else None
    fine = raw.filter(~rejects_html(F.col("html"), kind))
    return fine.select(site_domain(F.col("url")).alias("domain"), F.col("page_id").alias("page_seq"), "url", "html")


def write_uploads(texts: DataFrame, path: str) -> None:
    """Each row of ``texts`` (``text``; nulls are left out) as a UTF-8 text file of its own below ``path``, an unused folder.
    A line end follows the text, as Spark's writer has it, so that no file is without a byte, which Spark's readers pass over.

    Tasks write through Arrow, since Spark's writer takes several processes a file for its mode and checksum on a local
    store and renames file by file in the driver. A file's name is its task's number and its place there, so a task that
    is run again replaces its own. Stores that Arrow doesn't know get their files from Spark's writer.
    """
    given, uri = texts.filter("text IS NOT NULL").select("text"), qualified(texts.sparkSession, path)
    make_folder(texts.sparkSession, path)
    if arrow_files(uri) is None:
        given.write.mode("append").option("maxRecordsPerFile", 1).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, top), task, n = arrow_files(uri), TaskContext.get().partitionId(), 0
        for batch in batches:
            for text in batch.column(0):
                folder = f"{top}/{task:05d}-{n // FOLDER_FILES:05d}"
                if n % FOLDER_FILES == 0:
                    system.create_dir(folder)
                with system.open_output_stream(f"{folder}/{n % FOLDER_FILES:03d}.txt") as out:
                    out.write(text.as_buffer())
                    out.write(b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"files": [n]})

    given.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def marked_uploads(spark: SparkSession, path: str) -> DataFrame:
    """``(path, kind, text, reason)`` of the files below ``path``; ``reason`` is null for accepted ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = trim(F.try_validate_utf8(F.col("content").cast("string")))
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    read = files.select("path", kind.alias("kind"), text.alias("text"))
    reason = F.when(~F.col("kind").isin(*TEXT_EXTENSIONS), "unsupported type").when(F.col("text").isNull(), "not UTF-8").when(F.col("text") == "", "empty")
    return read.withColumn("reason", reason)


def read_uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) text files below ``path``: ``(path, kind, text)`` and ``(path, kind, reason)``."""
    marked = marked_uploads(spark, path)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").drop("text")
