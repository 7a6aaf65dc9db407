"""Session construction and the shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import paceframe

_LOCAL_DIRS: dict[str, str] = {}


def shuffle_bound(input_bytes: int, partition_bytes: int = 128 * 1024**2) -> int:
    """Shuffle partitions that keep one partition of the whole input near ``partition_bytes``."""
    return max(200, -(-input_bytes // partition_bytes))


def build_session(
    app_name: str = "paceframe", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, skew-join handling.

    ``input_bytes``, the size of the largest input, sets the upper bound of shuffle
    partitions; AQE merges small partitions at run time, so a generous bound is cheap while
    the default of 200 would make partitions of hundreds of GB out of 100 TB. Other settings
    are keyword arguments with ``__`` for dots.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if input_bytes:
        bound = str(shuffle_bound(input_bytes))
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", bound)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder would not survive
    the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="paceframe-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/paceframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Set session settings for a while and put the old ones back."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def send_by_value() -> None:
    """Let Python workers receive this package's functions themselves, so it need not be installed there."""
    cloudpickle.register_pickle_by_value(paceframe)
