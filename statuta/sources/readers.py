"""Sources: document JSON, text files joined to their JSON, binary files, saved HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.schema import DOCUMENT_JSON


def json_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """One row per document file; the tree stays a JSON string; unreadable files have _corrupt_record."""
    schema = DOCUMENT_JSON.add("_corrupt_record", "string") if "_corrupt_record" not in DOCUMENT_JSON.fieldNames() else DOCUMENT_JSON
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", glob).json(path).withColumn("file_stem", file_stem())


def file_stem():
    return F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1), r"\.[^.]*$", "")


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """file_stem and whole text of each file."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(file_stem().alias("file_stem"), F.col("value").alias("text"))


def with_texts(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents that have a text file of the same stem, with that text as content; other texts are dropped."""
    return documents.drop("doc_content").join(texts.withColumnRenamed("text", "doc_content"), "file_stem")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of PDF files, with is_pdf: whether they begin with the PDF mark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).withColumn("is_pdf", F.substring("content", 1, 4) == F.lit(b"%PDF"))
