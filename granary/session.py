"""Sessions, table loading and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: UTC and adaptive execution."""
    builder = SparkSession.builder.master(master).appName("granary")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per context, so that their Python can import it."""
    context = spark.sparkContext
    if getattr(context, "_granary_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="granary")
    archive = os.path.join(folder, "granary.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent).as_posix())
    context.addPyFile(archive)
    context._granary_shipped = True
    return spark


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and every executor reach.

    Where that setting is absent, a local master gets a temporary folder of this machine; any other master is an error,
    because its executors could not see such a folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="granary-shared")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data through the store that holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
