"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: What tasks keep in their Python worker for later ones; workers outlive their operator, so others let it go.
KEPT: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where that is unset, a temporary one of our own in local mode, and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as the JVM has them."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with what it holds when the driver ends (results may read it until then)."""
    path = f"{shared_dir(spark)}/chronoweave/{name}-{uuid.uuid4().hex}"
    found, system = _hadoop_path(spark, path)
    system.mkdirs(found)
    system.deleteOnExit(found)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage at files that survive the loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, dropped as soon as nothing needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def table(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """narrow: df is small beside what it is made of, so it goes into a file for each core and not one for each partition (a file costs
        a task, three new processes on a local file system, and a task again when it is read)."""
        path = fresh_path(self.spark, name)
        df = df.repartition(max(4, self.spark.sparkContext.defaultParallelism)) if narrow else df
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no result still reads, and let Spark's cleaner remove the shuffle files of finished jobs.

        The cleaner acts when the driver's JVM finds the shuffles unreachable; without a collection that is left to
        chance, and the files of all rounds would lie on the executors' disks together.
        """
        for table in tables:
            path, system = _hadoop_path(self.spark, self.tables.pop(id(table))[0])
            system.delete(path, True)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*[t for _, t in list(self.tables.values()) if not any(t is k for k in kept)])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have (names are compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most so many rows, so that a worker holds few Python objects at a time."""
    batch = None
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    del batch
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers wait for their next task, and beside them the executor needs it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # not glibc


def let_go() -> None:
    """Drop what other operators keep in this worker."""
    if any(KEPT):
        for kept in KEPT:
            kept.clear()
        give_back()


def batch_rows(spark: SparkSession, rows: int) -> None:
    """At most so many rows in an Arrow batch of this session from here on; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key, "10000"))
    spark.conf.set(key, str(min(rows, before) if before > 0 else rows))


def literal_rows(spark: SparkSession, rows_json: str, schema: str) -> DataFrame:
    """Rows of a small driver-side table out of one JSON literal; stays inside Spark's JVM."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows_json), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def keep_rows(df: DataFrame, text_col: str, decide: Callable[[list[str]], list[bool]], rows: int = 128) -> DataFrame:
    """The rows of df, with all their columns, for whose texts (null as empty) decide is true.  A map over Arrow batches, without a shuffle."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches, rows):
            yield batch.filter(pa.array(decide([t or "" for t in batch.column(place).to_pylist()]), pa.bool_()))

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names with dots, or that clash, never meet the mapper
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
