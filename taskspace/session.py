"""The session that the library expects: ANSI arithmetic, UTC, adaptive execution."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "taskspace", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; master and partitions are left to the cluster where they aren't given."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def require_ansi(spark: SparkSession) -> None:
    """The expression compiler's errors rely on ANSI mode; without it overflow would wrap silently."""
    if spark.conf.get("spark.sql.ansi.enabled", "true") != "true":
        raise RuntimeError("spark.sql.ansi.enabled must be true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a
    temporary one; on a cluster that is an error, as each machine would write to its own disk."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="taskspace-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


class Tables:
    """Frames of one computation, written to the shared folder: lineage ends there and survives lost executors.

    ``close()`` deletes them all; those of an unfinished computation go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        atexit.register(self.close)

    def place(self) -> str:
        """A new path in the shared folder, deleted with the tables."""
        self.paths.append(f"{shared_dir(self.spark)}/taskspace-{uuid.uuid4().hex}")
        return self.paths[-1]

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.place()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        for path in self.paths:
            try:
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # noqa: BLE001  the session may have ended
                pass
        self.paths = []
