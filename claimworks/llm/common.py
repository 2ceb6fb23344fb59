"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Separators of words in every contract: space and \x09-\x0D.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Shuffle files go with the write that made them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}
_shipped: set[str] = set()
_written: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str, buckets: int) -> Column:
    """crc32 of the key as text, modulo `buckets`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % buckets


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, through Spark's own file server.

    Batches to Python workers are kept small, since a row may hold a long text.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(), "claimworks_ship.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set: a temporary folder if driver and executors are one process (tests), an error on a cluster.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="claimworks-")
    return _own_dir[app]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever it lies."""
    if path in _written:
        _written.remove(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_table(df: DataFrame, tag: str) -> str:
    """Write `df` as Parquet into the shared folder; return the path. It goes with `cleanup` or when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimworks-{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_last_cleanup, spark)
    _written.append(path)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # a table that is written needs its shuffle files no more
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return path


def cleanup(spark: SparkSession) -> None:
    """Delete every table that operators have written so far: call it once the results built on them have been read."""
    while _written:
        drop_path(spark, _written.pop())


def _last_cleanup(spark: SparkSession) -> None:
    try:
        cleanup(spark)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder belongs to the cluster
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it again."""
    return read_table(df.sparkSession, write_table(df, tag), df.schema)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A written table, which `drop_table` can delete before `cleanup` does."""
    df = spark.read.schema(schema).parquet(path)
    df.written_at = path
    return df


def drop_table(*tables: DataFrame) -> None:
    """Delete tables that nothing will read again."""
    for df in tables:
        drop_path(df.sparkSession, df.written_at)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `df` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns that an operator is about to add: the operator's own win over clashing ones."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])
