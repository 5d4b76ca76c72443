"""The folder that all executors share, for checkpoints and intermediate tables.

The place comes from ``spark.checkpoint.dir``, or else from the checkpoint folder the session's context already has. Only
where both are unset and Spark runs on this machine alone (tests) a temporary folder is used, which is right there because
driver and executors see the same disk; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, set as the checkpoint directory as well."""
    context = spark.sparkContext
    present = context._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or (present.get() if present.isDefined() else None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
        configured = "file://" + _LOCAL["dir"]
    if present.isEmpty():
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """URI of a fresh folder below the shared one, removed when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return system.makeQualified(path).toString()
