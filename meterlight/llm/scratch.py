"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset in a local
    run (tests) a fresh temporary folder is made the checkpoint folder. A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="meterlight-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Held while a table is written: shuffle files go when a query ends, not when the driver collects
#: its garbage, and a batch of rows for Python has a bounded size, however large its sets and texts are.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage
    ends there, a lost executor costs only its own tasks. Its shuffle files are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meterlight-{uuid.uuid4().hex}/{name}"
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``save`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/meterlight-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows up to which tables of keys, some 40 bytes a row, are broadcast; rows of a task in them.
BROADCAST_ROWS, TASK_ROWS = 250_000, 20_000


class Near:
    """How to handle tables that have no more rows than ``table``, one made by ``save``:
    few rows are broadcast in joins and take few tasks, others are left as they are."""

    def __init__(self, table: DataFrame) -> None:
        self.rows = table.count()
        self.few, self.tasks = self.rows <= BROADCAST_ROWS, 4 + self.rows // TASK_ROWS

    def __call__(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return save(df.coalesce(self.tasks) if self.few else df, name)


def renamed(docs: DataFrame, *wanted: str) -> tuple:
    """``docs`` with columns named c0, c1, ..., and those names of the wanted columns,
    so that no name of a caller's column meets one of ours. ``restored`` undoes it."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip((c.lower() for c in docs.columns), names))
    return docs.toDF(*names), *(of[w.lower()] for w in wanted)


def restored(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns that ``renamed`` had, and ``more``, which replace columns of their names."""
    replaced = {m.lower() for m in more}
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in replaced], *more)
