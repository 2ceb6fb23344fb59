"""Batches that count only once they are committed.

A batch writes its rows under `<table>/batch=<number>`, in as many tables as it likes, and then creates the marker
`_commits/<number>`, which the file system creates once. Readers take the batches that have a marker. So a batch that dies on
the way leaves nothing that anyone reads, and run again it overwrites what it left; one that was committed is not run
again. `compact` folds the batches so far into one snapshot, which a marker of its own puts in their place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._at("_commits"))] if self._fs.exists(self._at("_commits")) else []

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self._names() if n.isdigit())

    def snapshot(self) -> int | None:
        """The last batch that the newest snapshot holds."""
        return max((int(n[5:]) for n in self._names() if n.startswith("upto-")), default=None)

    def done(self, number: int) -> bool:
        return number in self.batches() or number <= (self.snapshot() if self.snapshot() is not None else -1)

    def write(self, df: DataFrame, table: str, number: int) -> None:
        if self.done(number):
            raise ValueError(f"batch {number} is committed")
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={number}")

    def commit(self, number: int) -> None:
        """From here on the batch counts. Of two that run the same batch, one commits; the other gets an error."""
        self._fs.create(self._at(f"_commits/{number}"), False).close()

    def read(self, table: str, schema: str) -> DataFrame:
        """The committed rows of a table and `batch`, the number that each was written by (a snapshot's rows keep theirs)."""
        upto = self.snapshot()
        parts = [] if upto is None else [(f"{self.path}/{table}/upto={upto}", None)]
        parts += [(f"{self.path}/{table}/batch={n}", n) for n in self.batches() if upto is None or n > upto]
        parts = [(p, n) for p, n in parts if self._fs.exists(self._at(p.removeprefix(self.path + "/")))]
        empty = self.spark.createDataFrame([], schema)
        fields = empty.columns
        if not parts:
            return empty.withColumn("batch", F.lit(None).cast("long"))
        snap = [p for p, n in parts if n is None]
        live = [p for p, n in parts if n is not None]
        out = None
        if live:
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long")
            out = self.spark.read.schema(empty.schema).parquet(*live).select(*fields, number.alias("batch"))
        if snap:
            old = self.spark.read.schema(empty.schema.add("batch", "long")).parquet(*snap).select(*fields, "batch")
            out = old if out is None else old.unionByName(out)
        return out

    def latest(self, table: str, schema: str, key: str) -> DataFrame:
        """The row of each key that the last batch wrote."""
        rows = self.read(table, schema)
        fields = [c for c in rows.columns if c not in (key, "batch")]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("r"), F.max("batch").alias("batch"))
        return last.select(key, *[f"r.{c}" for c in fields], "batch")

    def compact(self, tables: dict[str, tuple[str, str]]) -> int | None:
        """Fold all committed batches into a snapshot of the latest rows; `tables`: name -> (schema, key). Then delete what it holds."""
        live = [n for n in self.batches() if n > (self.snapshot() if self.snapshot() is not None else -1)]
        if not live:
            return self.snapshot()
        for name, (schema, key) in tables.items():
            self.latest(name, schema, key).write.mode("overwrite").parquet(f"{self.path}/{name}/upto={live[-1]}")
        before = self.snapshot()
        self._fs.create(self._at(f"_commits/upto-{live[-1]}"), False).close()
        for n in [b for b in self.batches() if b <= live[-1]]:
            for name in tables:
                self._fs.delete(self._at(f"{name}/batch={n}"), True)
            self._fs.delete(self._at(f"_commits/{n}"), False)
        if before is not None:
            for name in tables:
                self._fs.delete(self._at(f"{name}/upto={before}"), True)
            self._fs.delete(self._at(f"_commits/upto-{before}"), False)
        return live[-1]


def once(log: Commits, number: int, work: Callable[[], dict[str, DataFrame]]) -> bool:
    """Run a batch, write the tables it gives, in their order, and commit; nothing if it was committed before. True if it ran."""
    if log.done(number):
        return False
    for table, df in work().items():
        log.write(df, table, number)
    log.commit(number)
    return True
