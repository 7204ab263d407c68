"""Readers and writers: CSV with explicit null tokens, hashes, JSON results, cached embeddings, models."""

from __future__ import annotations

import json
import math
import platform
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# fixed values: what a CSV cell that means "missing" may hold
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Quoted, multi-line CSV with a header, which must be there; the null tokens are null in every column."""
    require_path(spark, path)
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    strings = StructType([type(f)(f.name, StringType(), True) for f in schema])
    rows = spark.read.schema(strings).csv(path, header=True, multiLine=True, escape='"', quote='"', nullValue=None, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.select([F.when(F.col(f.name).isin(*NULL_TOKENS), None).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def require_path(spark: SparkSession, path: str) -> str:
    """The path, if there is something there: checked before a read, in whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return path


def file_hashes(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, sha256) of each file under a path; recursive: in folders below, too."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def file_counts(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(suffix, files) under a path, parts of which are excluded; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split("path", "/")
    if excluded:
        files = files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, excluded))))
    return files.groupBy(F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("suffix")).agg(F.count("*").alias("files"))


def require_hash(spark: SparkSession, path: str, expected: str) -> None:
    found = [r["sha256"] for r in file_hashes(spark, path).limit(2).collect()]
    if found != [expected]:
        raise ValueError(f"{path} does not have the expected checksum")


def write_json(path: str | Path, value: dict) -> None:
    """Sorted keys, indented, no NaN or infinity."""
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, allow_nan=False, ensure_ascii=False) + "\n", encoding="utf-8")


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def provenance(spark: SparkSession, source: str = "fresh_reproduction", **more) -> dict:
    return {"source": source, "spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), **more}


def cached_embeddings(spark: SparkSession, path: str, manifest: dict, compute) -> DataFrame:
    """The embeddings table at path if its manifest equals the one given, else compute() written there.

    A manifest that differs raises; embeddings that are not of the manifest's size,
    or not finite, raise as well.
    """
    told = Path(path + ".json")
    if told.exists():
        if read_json(told) != manifest:
            raise ValueError("the cached embeddings belong to another input")
    else:
        compute().write.parquet(path)
        write_json(told, manifest)
    df = spark.read.parquet(path)
    v = F.col("embedding")
    bad = df.where((F.size(v) != manifest["dimension"]) | F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == math.inf)))
    if df.count() != manifest["rows"] or not bad.isEmpty():
        raise ValueError("cached embeddings are incomplete")
    return df
