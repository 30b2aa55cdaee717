"""Tables in the folder that driver and executors share.

Operators with several passes write each intermediate result there and read it again.  That cuts lineage in a
way that survives lost executors, fixes the rows that later passes see, and lets finished shuffles be deleted.  What an
operator returns reads its last tables, so they stay until the driver ends or ``clear`` is called.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship

_roots: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@atexit.register
def clear() -> None:
    """Delete the folders of all runs: when the driver ends, or earlier if no frame that an operator returned is needed."""
    while _roots:
        try:
            _delete(*_roots.pop())
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and Spark runs locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="kindred-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Named tables of one run of one operator, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _roots.append((spark, self.root))

    @contextmanager
    def set_while(self, settings: dict[str, str]):
        """Settings of the session that hold inside only."""
        before = {name: self.spark.conf.get(name, None) for name in settings}
        for name, value in settings.items():
            self.spark.conf.set(name, value)
        try:
            yield
        finally:
            for name, value in before.items():
                self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)

    def shuffles_deleted(self):
        """What a plan has shuffled is deleted as soon as its rows are written."""
        return self.set_while({CLEANUP: "true"})

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Run the plan once, keep its rows as Parquet and return a frame that reads them."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        with self.shuffles_deleted():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            _delete(self.spark, table._scratch_path)
