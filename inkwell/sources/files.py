"""Files and configurations as tables, and report output."""

from __future__ import annotations

import zipfile
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

#: Fixed values
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "epub": "epub", "txt": "txt", "md": "md", "html": "html", "htm": "html"}
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


#: What a ZIP container with this part is.
PARTS = {"word/document.xml": "docx", "ppt/presentation.xml": "pptx", "xl/workbook.xml": "xlsx", "mimetype": "epub"}


def container_type(source: BinaryIO) -> str:
    """What a file holds by its first bytes; of a ZIP container only the directory at its end is read."""
    head = source.read(4)
    if head == b"%PDF":
        return "pdf"
    if head != b"PK\x03\x04":
        return "unknown"
    try:
        names = set(zipfile.ZipFile(source).namelist())
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return "unknown"
    return next((kind for part, kind in PARTS.items() if part in names), "zip")


def _by_content(paths: pd.Series) -> pd.Series:
    """Types of files by ranged reads: a few bytes at the begin and, for containers, at the end."""

    def kind(path: str) -> str:
        scheme = path.partition(":")[0]
        store, inner = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if scheme == "s3a" else path)
        with store.open_input_file(inner) as source:
            return container_type(source)

    return paths.map(kind)


def file_types(spark: SparkSession, path: str) -> DataFrame:
    """path, length, file_type: by extension, else by content.

    Listing takes names and lengths only. A file without a known extension is opened by an executor where it lies (file, hdfs, s3,
    gs or abfs), and only its header and a container's directory are read, so that files of any size take little memory.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.coalesce(*[F.when(ext == e, t) for e, t in EXTENSIONS.items()])
    rows = listed.withColumn("known", known)
    read = rows.where("known is null").select("path", "length", F.pandas_udf(_by_content, "string")("path").alias("file_type"))
    return rows.where("known is not null").select("path", "length", F.col("known").alias("file_type")).unionByName(read)


def file_census(spark: SparkSession, path: str) -> DataFrame:
    return file_types(spark, path).groupBy("file_type").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def load_rule_catalog(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, analyzer, category, severity, title, enabled, weight of a JSON catalogue; an unknown severity fails the read."""
    schema = "scoring struct<severity_weights: map<string,int>>, rules array<struct<rule_id:string,analyzer:string,category:string,severity:string,title:string,enabled:boolean>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    rows = raw.select(F.explode("rules").alias("r"), F.col("scoring.severity_weights").alias("w"))
    checked = F.when(F.col("r.severity").isin(SEVERITIES), F.col("r.severity")).otherwise(F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce("r.severity", F.lit("null")))))
    return rows.select("r.rule_id", "r.analyzer", "r.category", checked.cast("string").alias("severity"), "r.title", F.coalesce("r.enabled", F.lit(True)).alias("enabled"), F.col("w")[F.col("r.severity")].alias("weight"))


def load_policy_config(spark: SparkSession, path: str) -> list[dict]:
    """Policy entries of a small JSON configuration."""
    return [r.asDict(recursive=True) for r in spark.read.option("multiLine", "true").json(path).select(F.explode("policies").alias("p")).select("p.*").collect()]


def read_review_sheet(rows: DataFrame) -> DataFrame:
    """Typed chapters of review rows: blank and TOTAL rows go, kept unless N, the corrected title wins, the weight is cast."""
    chapter, corrected = strip(F.coalesce("chapter", F.lit(""))), strip(F.coalesce("corrected", F.lit("")))
    title: Column = F.coalesce(F.nullif(corrected, F.lit("")), chapter)
    return rows.where((title != "") & (F.upper(chapter) != "TOTAL")).select(
        "project_id", "section", "unit_number", "unit", "chapter_number", title.alias("chapter"), ((corrected != "") & (corrected != chapter)).alias("retitled"),
        (F.upper(strip(F.coalesce("keep", F.lit("")))) != "N").alias("kept"), "pyq_hits", F.expr("try_cast(trim(sme_weight) as int)").alias("weight"),
    )


def write_report(findings: DataFrame, path: str, key: str = "doc_id") -> None:
    """Findings and a summary per document as JSON lines."""
    findings.write.mode("overwrite").json(f"{path}/findings")
    findings.groupBy(key).agg(F.count("*").alias("total"), F.countDistinct("rule_id").alias("rules")).write.mode("overwrite").json(f"{path}/summary")
