"""Session settings the library expects, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Everything here is a default for sessions we create; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "ludograph", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it; a local one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="ludograph-")
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage is cut, and every later branch
    reads only the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of few partitions (one small file) a task per core; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, whatever folder they start in."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if getattr(context, "_ludograph_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="ludograph-code-")) / "ludograph_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._ludograph_shipped = True
