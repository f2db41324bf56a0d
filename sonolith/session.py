"""Session settings and the shared folder in which long plans are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the deployment's own session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only where it is unset (local tests) a
    temporary folder is chosen and remembered for the session."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sonolith.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="sonolith-")
        spark.conf.set("sonolith.shared.dir", at)
    return at.rstrip("/")


_written: dict[int, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: a cut of the lineage that survives the loss
    of executors, for results that several later jobs read. `discard` deletes it once nothing reads it any more,
    `release` deletes all that is left."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_sonolith_path"] = path
    _written[id(path)] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what `materialize` wrote for these tables; nothing may read them any more."""
    for df in tables:
        path = None if df is None else df.__dict__.pop("_sonolith_path", None)
        if path is not None:
            _delete(df.sparkSession, path)
            _written.pop(id(path), None)


def release(spark: SparkSession) -> None:
    """Deletes all that `materialize` wrote in this process: to be called when the results of queries are stored."""
    for path in list(_written.values()):
        _delete(spark, path)
    _written.clear()
