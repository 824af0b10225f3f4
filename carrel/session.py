"""Session defaults and table access shared by all queries."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "carrel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; ``conf`` overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark from any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input for each core up to which ``spread`` moves rows.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, for work that costs much for each row: a small input in fewer files than there are cores (a file of one row group is one task) is dealt over all of them.

    A larger input, or one in more files, is left as it is, so nothing is shuffled that scans in parallel anyway.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, as the planner knows it
    return df if size > cores * SPREAD_BYTES or len(df.inputFiles()) >= cores else df.repartition(cores)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that spark.checkpoint.dir names; a temporary one only where none is set (tests, one machine)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="carrel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        at = sc.getCheckpointDir()
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package and the modules beside it to the executors, once for each application, so that their Python workers can import them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="carrel-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/carrel-code.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted([*root.glob("*.py"), *root.glob("carrel/**/*.py")]):
            z.write(f, str(f.relative_to(root)))
    sc.addPyFile(f"{folder}/carrel-code.zip")
    _shipped.add(sc.applicationId)
