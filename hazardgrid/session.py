"""Session settings and the two places where a driver-side setting matters."""

from __future__ import annotations

import io
import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "hazardgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; explicit ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that run in Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_hazardgrid_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    path = os.path.join(tempfile.mkdtemp(prefix="hazardgrid-code-"), "hazardgrid.zip")
    pathlib.Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)  # served by the driver; nothing else reads the local copy
    sc._hazardgrid_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a folder of its own. With executors on other
    machines (or standing in for them) the setting is required, since a local folder would be lost.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="hazardgrid-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; used between the rounds of iterative operators."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a written intermediate table."""
    import uuid

    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex[:12]}")
