"""Scans with explicit contracts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_scan(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header under a declared schema; malformed rows raise.  Only the columns asked for are parsed."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def csv_tolerant(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text; those that the file lacks, and empty cells, are empty strings."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def require_columns(df: DataFrame, wanted: set[str], forbidden: set[str] = frozenset(), exact: bool = False) -> DataFrame:
    """df, or an error that names the columns that are missing, unexpected or forbidden."""
    have = set(df.columns)
    problems = {"missing": wanted - have, "forbidden": have & forbidden, "unexpected": have - wanted if exact else set()}
    if any(problems.values()):
        raise ValueError("; ".join(f"{k}: {sorted(v)}" for k, v in problems.items() if v))
    return df


def id_column(spark: SparkSession, path: str, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """The distinct filled ids of one CSV column, or those of them that wanted (the same column) has."""
    ids = spark.read.option("header", True).csv(path).select(key).where(F.col(key).isNotNull() & (F.trim(key) != "")).distinct()
    return ids if wanted is None else ids.join(wanted.select(key), key, "left_semi")


def lines_with(spark: SparkSession, path: str, text: str) -> DataFrame:
    """file, hits: lines that contain a text in any case."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.lower("value").contains(text.lower()).alias("hit"))
    return lines.groupBy("file").agg(F.count_if("hit").alias("hits"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration() if hasattr(spark, "_jsc") else spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def first_of(spark: SparkSession, *paths: str) -> DataFrame:
    """The first Parquet table that exists."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(paths)


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, size, sha256 of each file of a folder, of any size: files are streamed where they are hashed, eight MB at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            digests = []
            for uri in part["path"]:
                system, name = pafs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with system.open_input_stream(name) as f:
                    while piece := f.read(8 << 20):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pd.DataFrame({"name": [p.rsplit("/", 1)[-1] for p in part["path"]], "size": part["length"], "sha256": digests})

    return files.mapInPandas(run, "name string, size long, sha256 string")


def strict_json(text: str) -> dict:
    """A small JSON document; repeated keys raise."""

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(keys) != len(set(keys)):
            raise ValueError(f"repeated key among {keys}")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=once)


def active_records(records: DataFrame, members: DataFrame, active: DataFrame) -> Iterator[dict]:
    """Records of the active communities, each once, in order of id, fetched partition by partition."""
    rows = records.join(members.join(active, "community_key", "left_semi").select("record_type", "canonical_id").distinct(), ["record_type", "canonical_id"], "left_semi")
    for r in rows.orderBy("record_type", "canonical_id").toLocalIterator():
        yield r.asDict()
