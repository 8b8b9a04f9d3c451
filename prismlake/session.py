"""Session and storage helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
#: Tables that durable() wrote and nobody has deleted.
_written: dict[str, DataFrame] = {}


def session(app: str = "prismlake", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that results rely on (UTC, adaptive plans)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the session's own checkpoint folder.

    Where neither is set, a local session, as in tests, gets a folder of this machine;
    on a cluster that is an error, as each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # The setting is fixed once a session runs, so our own folder is kept here.
        found = _own.setdefault("folder", "") or "file://" + tempfile.mkdtemp(prefix="prismlake-")
        _own["folder"] = found
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, keeps
    columns prunable, and fixes what a non-deterministic plan has decided. The shuffle
    files of the write are deleted with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.durable_path = path
    _written[path] = table
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that durable() wrote, once nothing that is still to be computed reads them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.pop(table.durable_path, None)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """durable(build()); the tables that build wrote on its way are deleted, as only its result read them."""
    before = set(_written)
    table = durable(build())
    discard(*[t for path, t in list(_written.items()) if path not in before and path != table.durable_path])
    return table


def sweep() -> None:
    """Delete all tables that durable() has written in this process and nobody has deleted; for when results have been written elsewhere."""
    discard(*list(_written.values()))


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle has by default."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
