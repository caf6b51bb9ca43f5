"""Session for local work, and the shared folder that stage tables are written to."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.adaptive.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "cohortspark") -> SparkSession:
    """A local session; on a cluster the submitter's own settings are used instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    for key, value in LOCAL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SCAN_TASKS = "spark.sql.files.minPartitionNum"
SHUFFLE_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SCAN_BYTES = 16 << 20  # stored bytes of the inputs for each scan task
_SCANS: dict[str, int] = {}


def bound_tasks(spark: SparkSession, input_bytes: int) -> None:
    """Keeps tasks small enough for their hash tables, unless the session has bounds of its own.

    A task counts copies and distinct values of its rows before it shuffles them. By default it reads up to 128
    megabytes, which are millions of lines, and its table then spills. So scans get a task for each 16 megabytes of the
    inputs, and partitions that were shuffled are put together to 16 megabytes instead of 64.
    """
    app = spark.sparkContext.applicationId
    tasks = max(-(-input_bytes // SCAN_BYTES), spark.sparkContext.defaultParallelism, _SCANS.get(app, 0))
    if spark.conf.get(SCAN_TASKS, None) in (None, str(_SCANS.get(app))):
        spark.conf.set(SCAN_TASKS, str(tasks))
        _SCANS[app] = tasks
    if spark.conf.get(SHUFFLE_BYTES) in ("64MB", "67108864b"):
        spark.conf.set(SHUFFLE_BYTES, "16m")


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session may fall back to a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="cohortspark-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again."""
    path = f"{shared_dir(frame.sparkSession)}/stored/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
