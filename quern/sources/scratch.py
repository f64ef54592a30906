"""Tables in the shared scratch folder, which cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []

#: Shuffle files of a query go when it ends; otherwise they stay until the driver collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one in local mode; elsewhere an error, as executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path there, whose files go when the session's process ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts lineage, so that what follows neither repeats the work nor loses it with an executor. What was shuffled for it is removed.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


class Scope:
    """Releases what was made inside it: tables held in memory, and scratch tables but for those that are kept."""

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []
        self._before: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scope:
        self._before = list(_made)
        return self

    def hold(self, df: DataFrame) -> DataFrame:
        self._frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._frames[-1]

    def __exit__(self, *_: object) -> None:
        for frame in self._frames:
            frame.unpersist()
        for made in [m for m in _made if m not in self._before]:
            _remove(*made)
            _made.remove(made)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """df, which plans over what the scope releases, as a scratch table that outlives it."""
        out = written(df, name)
        self._before.append(_made[-1])
        return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_scratch() -> None:
    for made in _made:
        try:
            _remove(*made)
        except Exception:  # noqa: BLE001  the session may have ended already
            return
