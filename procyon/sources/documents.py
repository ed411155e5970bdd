"""Document files: bytes, formats, text."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import visible_text
from ..functions.urls import sniff_format

ALLOWED = ("PDF", "DOC", "DOCX", "XLS", "XLSX", "CSV", "TXT", "HTML", "ZIP")
MOST_CHARS = 2_000_000


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of the files under a path: bytes, size, sha256, format; empty or unknown files are rejects."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = files.select("path", "modificationTime", "length", "content", F.substring_index("path", "/", -1).alias("filename"))
    out = out.withColumn("format", sniff_format(F.col("content"), F.lit(None).cast("string"), F.col("filename"))).withColumn("sha256", F.sha2("content", 256))
    bad = (F.col("length") == 0) | ~F.col("format").isin(*ALLOWED)
    code = F.when(F.col("length") == 0, "EMPTY_FILE").otherwise("FORMAT_NOT_ALLOWED")
    return out.where(~bad), out.where(bad).select("path", F.lit("DOCUMENT").alias("stage"), code.alias("code"))


def _docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = z.read("word/document.xml").decode("utf-8", "replace")
    body = re.sub(r"</w:p>", "\n", re.sub(r"<w:tab/>", "\t", body))
    return re.sub(r"&(lt|gt|amp|quot|apos);", lambda m: {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}[m[1]], re.sub(r"<[^>]+>", "", body)).strip()


def extract_text(documents: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keep, text, method, char_count): TXT, CSV (cells joined by " | "), HTML and DOCX; others are empty, NONE.

    HTML is decoded and stripped by column expressions; the other formats are read in Python, a batch at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text, method = [], []
            for kind, data in zip(frame["format"], frame["content"], strict=True):
                how, out = "NONE", ""
                try:
                    if kind == "TXT":
                        how, out = "PLAIN_TEXT", data.decode("utf-8", "replace")
                    elif kind == "CSV":
                        how, out = "SPREADSHEET", "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(data.decode("utf-8", "replace"))))
                    elif kind == "HTML":
                        how, out = "HTML_PARSE", data.decode("utf-8", "replace")
                    elif kind == "DOCX":
                        how, out = "PLAIN_TEXT", _docx(data)
                except (csv.Error, zipfile.BadZipFile, KeyError):
                    how, out = "NONE", ""
                text.append(out)
                method.append(how)
            yield frame[list(keep)].assign(text=text, method=method)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema if f.name in keep)
    out = documents.select(*keep, "format", "content").mapInPandas(run, f"{schema}, text string, method string")
    text = F.substring(F.when(F.col("method") == "HTML_PARSE", visible_text(F.col("text"))).otherwise(F.col("text")), 1, MOST_CHARS)
    return out.withColumn("text", text).withColumn("char_count", F.length("text")).withColumn("confidence", F.when(F.col("char_count") > 0, 1.0).otherwise(0.0))
