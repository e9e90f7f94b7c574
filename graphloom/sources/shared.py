"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task takes where tables are dealt by key: its memory stays the same on larger tables.
TASK_ROWS, LEAST_ROWS = 250_000, 25_000

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's own checkpoint folder; a local one only in a local session without either."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


class Written:
    """A table written once and read back; ``drop`` removes it early, the rest goes when the driver ends."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/graphloom-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _WRITTEN.append((self.spark, self.path))

    def drop(self) -> None:
        remove(self.spark, self.path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != self.path]


def written(df: DataFrame) -> DataFrame:
    return Written(df).df


def tasks_of(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks for a stored table, by its number of rows (read from the footers); small tables keep the session's number at most."""
    n, most = df.select().count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // rows), min(most, -(-n // LEAST_ROWS)))
