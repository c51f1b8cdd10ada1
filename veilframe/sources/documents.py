"""Readers: whole text files, PDF pages with OCR for weak ones, inbox listings, role profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import is_weak, lines, strip, subject_id

PAGE_GAP = "\n\n"


def texts(spark: SparkSession, path: str, reject_blank: bool = True) -> DataFrame:
    """(path, text) of whole UTF-8 files; a blank file is an error, or left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    blank = strip(F.col("text")) == ""
    if not reject_blank:
        return rows.where(~blank)
    return rows.withColumn("text", F.when(blank, F.raise_error(F.concat(F.lit("empty document: "), "path")).cast("string")).otherwise(F.col("text")))


def pdf_pages(spark: SparkSession, path: str, read_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page, text, error) of PDF files; read_pages turns a file's bytes into page texts (pypdf where it is installed).

    A file that cannot be read gives one row with an error instead of ending the job.
    """

    def default(content: bytes) -> list[str]:
        import io

        from pypdf import PdfReader

        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]

    reader = read_pages or default

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for where, content in zip(frame.path, frame.content):
                try:
                    rows += [(where, k, text, None) for k, text in enumerate(reader(bytes(content)), 1)]
                except Exception as error:
                    rows.append((where, None, None, f"{type(error).__name__}: unreadable PDF"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page long, text string, error string")


def with_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """pages(path, page, text) with weak pages replaced by ocr(path, page, text); method tells which."""
    patched = pages.withColumn("weak", is_weak(F.col("text"))).join(ocr.select("path", "page", F.col("text").alias("ocr_text")), ["path", "page"], "left")
    return patched.select("path", "page", F.when(F.col("weak"), F.coalesce("ocr_text", "text")).otherwise(F.col("text")).alias("text"), F.when(F.col("weak"), "ocr").otherwise("text_layer").alias("method"))


def assembled(pages: DataFrame) -> DataFrame:
    """(path, text, stats): pages in order; a page still weak after OCR is suspicious, one still empty is an error."""
    numbers = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("page").cast("int"))))
    whole = pages.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"), F.count("*").cast("int").alias("pages_total"), numbers(F.col("method") == "text_layer").alias("text_layer_pages"),
        numbers(F.col("method") == "ocr").alias("ocr_pages"), numbers(is_weak(F.col("text"))).alias("suspicious_pages"), numbers(strip(F.coalesce("text", F.lit(""))) == "").alias("empty_pages"),
    )
    text = F.when(F.size("empty_pages") > 0, F.raise_error(F.concat(F.lit("pages without text in "), "path")).cast("string")).otherwise(F.array_join(F.transform("pages", lambda p: strip(p.text)), PAGE_GAP))
    stats = F.struct(F.lit("pdf").alias("kind"), "pages_total", "text_layer_pages", "ocr_pages", "suspicious_pages")
    return whole.select("path", text.alias("text"), stats.alias("stats"))


def pending(inbox: DataFrame, previews: DataFrame) -> DataFrame:
    """inbox(name) with a known suffix and without a preview(stem) yet, by name. Keyed by the safe stem."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    safe = F.when(strip(stem) == "", "document").otherwise(subject_id(stem))
    listed = inbox.where(suffix.isin(*fixed.INBOX_SUFFIXES)).withColumn("stem", safe)
    return listed.join(previews.select("stem").distinct(), "stem", "left_anti").orderBy("name")


def role_profiles(files: DataFrame, names: DataFrame) -> DataFrame:
    """(role, title, content, path): requested names(role), with files(role, path, content) where there is one."""
    heading = F.filter(lines(F.coalesce("content", F.lit(""))), lambda x: x.startswith("# "))
    joined = names.join(files, "role", "left")
    return joined.select("role", F.coalesce(F.when(F.size(heading) > 0, strip(F.substr(F.get(heading, F.lit(0)), F.lit(3)))), "role").alias("title"), F.coalesce("content", F.lit("")).alias("content"), "path")
