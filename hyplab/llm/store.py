"""What tasks need from outside their plan: the shared checkpoint folder and this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; only a local session may fall back to its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hyplab-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    A lost executor costs nothing that came before. The files go when the returned
    frame and all frames built on it are no longer referenced.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def snug(df: DataFrame, rows: int) -> DataFrame:
    """A cut frame in partitions of about ``rows`` rows, never more of them than before.

    Counting a cut frame is cheap, and a small table in hundreds of partitions costs every
    later shuffle hundreds of files. The number of partitions grows with the table.
    """
    return df.coalesce(max(1, -(-df.count() // rows)))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, so that its functions can be loaded there."""
    context = spark.sparkContext
    if getattr(context, "_hyplab_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="hyplab-package-")) / "hyplab.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, Path(top.name) / f.relative_to(top))
    context.addPyFile(str(target))
    context._hyplab_shipped = True
