"""Sessions, table access and cutting of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "evigrid", memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, on one machine, a folder of our own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="evigrid-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


class Scratch:
    """Tables written to the shared folder in order to cut lineage.

    A written table survives the loss of any executor, and its size is known to the planner. A table
    cut in a role replaces the one before it in that role, which is deleted, so that rounds of a
    fixpoint do not fill the folder; the folder itself goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count, self.roles = spark, f"{shared_dir(spark)}/evigrid-{uuid.uuid4().hex}", 0, {}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def cut(self, df: DataFrame, role: str | None = None) -> DataFrame:
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        if not self.count:
            fs, p = self._fs(self.root)
            fs.deleteOnExit(p)
        self.count += 1
        if role is not None:
            if (old := self.roles.get(role)) is not None:
                fs, p = self._fs(old)
                fs.delete(p, True)
            self.roles[role] = path
        return self.spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit_bytes: int) -> bool:
    """Whether the planner's own estimate, exact for written tables, is below the limit."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit_bytes
