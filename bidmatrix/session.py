"""Session settings for tests and local runs, and the shared scratch folder."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A cluster brings its own session; nothing in the package depends on these values."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bidmatrix")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared spark.checkpoint.dir.

    Only a session whose executors live in the driver's own process may go without that setting:
    it gets one of its own. On a cluster a driver-local folder would lose rows, so that raises.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="bidmatrix-")
        context.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark's switch for removing the shuffle files of a run when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files. They would otherwise stay until the driver's memory is collected,
    so that a run of several steps holds the shuffles of all of them; nothing reads them once the step is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written once and read back.

    For a result several steps share: the steps then scan the small table with only the columns
    they need, instead of each repeating the work behind it, and a lost executor costs no more
    than a re-read. Spark also knows the table's real size when it picks join strategies.
    """
    folder = folder or work_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession, folder: str) -> None:
    """Remove a folder of stored() that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
