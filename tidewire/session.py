"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Text timestamps are read as UTC, whatever the machine's zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


#: Bytes of the largest method the JVM compiles.
METHOD_BYTES = 8000


def compiled_plans(spark: SparkSession) -> SparkSession:
    """Wide plans run as several compiled methods; fused into one above `METHOD_BYTES` the JVM would interpret every row of it."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > METHOD_BYTES:
        spark.conf.set(name, str(METHOD_BYTES))
    return spark


_temporary_root: str | None = None


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path for a written table, under the cluster's shared `spark.checkpoint.dir`.

    Only where the session has no such setting and runs on one machine (tests) is a temporary folder used instead, which
    goes when the process ends; a cluster without the setting is refused, as its executors share no temporary folder.
    """
    global _temporary_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _temporary_root is None:
            _temporary_root = tempfile.mkdtemp(prefix="tidewire-")
            atexit.register(shutil.rmtree, _temporary_root, ignore_errors=True)
        root = _temporary_root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Exchanges of a finished execution are removed at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def written_once(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The table as files under the scratch folder, for as long as the block lasts. What was exchanged to make it goes at once."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tidewire") -> SparkSession:
    """A one-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))                         # see `compiled_plans`
        # no call-site capture per Column call: building wide plans gets several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """Even partitions for work that costs far more per row than moving the row (tree training, attributions)."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n)
