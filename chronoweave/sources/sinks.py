"""Sinks: small documents atomically, content-addressed objects, fixed-size chunks, bundles with the pointer last."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import json_safe
from ..functions.rank import value_positions
from .readers import strict_json
from .shared import hadoop_path


def _bytes(payload) -> bytes:
    return json.dumps(payload, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """Atomic on any Hadoop file system: written beside the target, then renamed over it."""
    target, system = hadoop_path(spark, path)
    beside, _ = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(beside, True)
    try:
        out.write(body)
        out.close()
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(beside, target, options)
    except BaseException:
        system.delete(beside, False)
        raise


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file through its Hadoop file system."""
    target, system = hadoop_path(spark, path)
    stream = system.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """Atomic: a reader sees the old document or the new one.  Keys are sorted; NaN is refused."""
    write_bytes(spark, path, _bytes(payload))


def write_built(spark: SparkSession, path: str, build: Callable[[], dict]) -> None:
    """What was there before stays unless the whole new payload could be built."""
    write_json(spark, path, build())


def write_both(spark: SparkSession, path: str, qualified: str, payload: dict) -> None:
    """The qualified name first, then the generic one."""
    for p in (qualified, path):
        write_json(spark, p, payload)


def dashboard(tables: dict[str, DataFrame], most: int = 100_000) -> dict:
    """One payload of small result tables, rows in the order of their values; a table beyond ``most`` rows raises."""
    out = {}
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = sorted((json_safe(r.asDict(recursive=True)) for r in rows), key=lambda r: json.dumps(r, sort_keys=True, default=str))
    return out


def objects(rows: DataFrame, columns: list[str]) -> DataFrame:
    """sha256, prefix, body: each distinct content once.  Columns are put in order of name, so equal content has one address."""
    body = F.to_json(F.struct(*sorted(columns)))
    return rows.select(body.alias("body")).distinct().withColumn("sha256", F.sha2("body", 256)).withColumn("prefix", F.substring("sha256", 1, 2))


def write_objects(rows: DataFrame, columns: list[str], path: str) -> None:
    objects(rows, columns).write.partitionBy("prefix").mode("append").parquet(path)


def chunks(rows: DataFrame, key: str, size: int = 250) -> DataFrame:
    """rows with chunk (from 0): so many keys each, in order of key."""
    places = value_positions(rows.select(key), key).select(key, F.floor(F.col("before") / size).alias("chunk"))
    return rows.join(places, key)


def chunk_index(chunked: DataFrame, key: str) -> DataFrame:
    return chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id", content: str = "sha256") -> DataFrame:
    """old and what new adds; a key that comes with two contents raises."""
    both = old.unionByName(new).groupBy(key).agg(F.min(content).alias(content), F.count_distinct(content).alias("kinds"))
    clash = F.raise_error(F.concat(F.lit("conflicting content: "), F.col(key).cast("string"))).cast("string")
    return both.select(key, F.when(F.col("kinds") > 1, clash).otherwise(F.col(content)).alias(content))


def table_hash(df: DataFrame) -> dict:
    """rows, and the sum and the exclusive or of a 64-bit hash of each row: the same for equal rows in any order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum"), F.expr("bit_xor(h)").alias("xor")).first()
    return {"rows": r["rows"], "sum": r["sum"] or "0", "xor": r["xor"] or 0}


def publish(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Writes all tables of a version, reads them back and compares them with what was to be written, and only then moves the pointer current.json."""
    spark, said = next(iter(tables.values())).sparkSession, {}
    for name, df in tables.items():
        path = f"{root}/{version}/{name}"
        wanted = table_hash(df)
        df.write.mode("errorifexists").parquet(path)
        said[name] = table_hash(spark.read.parquet(path))
        if said[name] != wanted:
            raise ValueError(f"{name} reads back as {said[name]}, not as {wanted}")
    write_json(spark, f"{root}/current.json", {"version": version, "tables": said})
    return version


def republish(spark: SparkSession, source: str, target: str, most_rows: dict[str, int] | None = None) -> str:
    """Copies the bundle that a pointer names, after checking it, and moves the target's pointer last; a table over its cap raises before anything is copied."""
    pointer = strict_json(read_bytes(spark, f"{source}/current.json").decode())
    for name, said in pointer["tables"].items():
        if most_rows and said["rows"] > most_rows.get(name, said["rows"]):
            raise ValueError(f"{name} has {said['rows']} rows, over its cap")
        if table_hash(spark.read.parquet(f"{source}/{pointer['version']}/{name}")) != said:
            raise ValueError(f"{name} is not what its pointer says")
    return publish({name: spark.read.parquet(f"{source}/{pointer['version']}/{name}") for name in pointer["tables"]}, target, pointer["version"])


def write_checkpoint(scores: DataFrame, models: dict[str, dict], metadata: dict, root: str) -> str:
    """Scores, model weights and metadata under an id that follows from their content alone; returns the id.

    models: name -> weights as nested lists.  Writing the same content twice gives the same id and leaves what is there.
    """
    spark = scores.sparkSession
    logical = {"scores": table_hash(scores), "models": {n: hashlib.sha256(_bytes(m)).hexdigest() for n, m in sorted(models.items())}, "metadata": metadata}
    name = hashlib.sha256(_bytes(logical)).hexdigest()
    at = f"{root}/{name}"
    found, system = hadoop_path(spark, f"{at}/checkpoint.json")
    if not system.exists(found):
        scores.write.mode("overwrite").parquet(f"{at}/scores")
        for model, weights in models.items():
            write_json(spark, f"{at}/models/{model}.json", weights)
        write_json(spark, f"{at}/checkpoint.json", logical)  # last: a checkpoint without it is none
    return name


def read_checkpoint(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, dict[str, dict], dict]:
    """(scores, models, metadata), each compared with its hash; anything else than what was written raises."""
    at = f"{root}/{name}"
    logical = strict_json(read_bytes(spark, f"{at}/checkpoint.json").decode())
    if hashlib.sha256(_bytes(logical)).hexdigest() != name:
        raise ValueError("the checkpoint's description is not the one that its id names")
    models = {}
    for model, digest in logical["models"].items():
        body = read_bytes(spark, f"{at}/models/{model}.json")
        if hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"model {model} is not what the checkpoint says")
        models[model] = strict_json(body.decode())
    scores = spark.read.parquet(f"{at}/scores")
    if table_hash(scores) != logical["scores"]:
        raise ValueError("the scores are not what the checkpoint says")
    return scores, models, logical["metadata"]
