"""Session helpers: test session, shared scratch folder, schema checks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "tidebars") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per context, so that they need not start in its folder.

    The archive is built where the driver runs; Spark serves it to the executors.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidebars_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidebars-")) / "tidebars.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._tidebars_shipped = True


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver
    and executors are one process, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives losing executors, so that several consumers
    do not each repeat the work upstream.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fan_out(spark: SparkSession) -> int:
    """Partitions for steps that multiply rows: the configured number, which must not be merged by the size rows have before."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail at plan time when an input lacks a column an operator needs."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
