"""Session-level helpers: reliable checkpoints and shared scratch folders.

Operators that loop, or that must see the very same intermediate rows in two
jobs, cut lineage with a *reliable* checkpoint (``DataFrame.checkpoint``), so a
lost executor never takes an intermediate result with it.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SCRATCH: dict[str, list[str]] = {}  # folders by application


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the session names it.

    ``spark.checkpoint.dir`` (or an earlier ``setCheckpointDir``) always wins.
    Only a local master may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="vecgrid-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the checkpoint folder and cut its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared checkpoint folder; ``clear_scratch`` deletes it."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete every scratch folder that this session has named so far; returns how many there were.

    For the end of a job: tables that operators returned read these folders lazily, so write results first. Checkpoints
    go by themselves under ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    n = 0
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True))
    return n


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Deal the rows of a table that is read as a few splits to ``partitions`` tasks, or to four for each core if those are more."""
    wanted = max(partitions, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, for sessions whose cluster has not got it installed.

    Does nothing if this session has it already.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vecgrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(sc._temp_dir) / f"vecgrid-{uuid.uuid4().hex[:8]}.zip"  # the session's own folder on the driver
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._vecgrid_shipped = True
