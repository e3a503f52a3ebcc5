"""Session defaults, and the package's way to the executors."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import uuid
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", app: str = "auditgrid", **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` overrides them (dots as ``__``)."""
    own = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(master).appName(app).config(map=own).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package's code, once for each context.

    Needed where the executors don't have the package on their path. Only code
    goes this way; the driver serves it, so a new executor gets it as well.
    """
    context = spark.sparkContext
    if getattr(context, "_auditgrid_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    mark = hashlib.sha256(b"".join(str(p).encode() + p.read_bytes() for p in files)).hexdigest()[:16]
    # a folder of its own, which only this driver reads: the name can't be taken by others
    target = Path(tempfile.mkdtemp(prefix="auditgrid-")) / f"auditgrid-{mark}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in files:
            z.write(p, Path(root.name) / p.relative_to(root))
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    context.addPyFile(str(target))
    context._auditgrid_shipped = True
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset, the
    warehouse folder serves on one machine; a cluster without one is an error, as
    its executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(root or shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
