"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Session settings the operators rely on; all can be changed at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "talefold", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the engine's settings; `master` is only for local use."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply RUNTIME_CONF to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests, a single machine) a temporary folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="talefold-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _own_scratch(spark: SparkSession) -> str:
    """This application's part of the scratch folder."""
    return f"{scratch_dir(spark)}/talefold-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage as checkpoint() does, but computes the plan one time
    only and keeps the columns prunable; lost executors reread the files. They
    stay until unstage() or clear_scratch().
    """
    spark = df.sparkSession
    path = f"{_own_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unstage(df: DataFrame | None) -> None:
    """Delete the files of a staged table that nothing will read again."""
    if path := getattr(df, "_staged", None):
        _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all staged files of this application: once its results are written, nothing reads them."""
    _delete(spark, _own_scratch(spark))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, wherever it lies on the driver."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="talefold-code-"))
    shutil.copytree(package, folder / "code" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    # Spark's own file server hands the archive out; it is code, not data
    context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "code"))
