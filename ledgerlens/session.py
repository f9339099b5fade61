"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# What a written table was shuffled by goes when it is written, not when the driver happens to collect its garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; cluster-provided settings always win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder, read back.

    It survives lost executors, is read by column, and the planner knows its
    size. What Parquet can't hold (columns of no type or of one name) becomes a
    reliable checkpoint instead.
    """
    names = [c.lower() for c in df.columns]
    if "void" in df.schema.simpleString() or len(set(names)) < len(names) or not names:
        return _checkpoint(df)
    path = shared_folder(df.sparkSession, "ledgerlens")
    with _setting(df.sparkSession, FREES_SHUFFLES, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` of the session at ``value`` for a while."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def _checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names, or in one of our own where a local session has none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "ledgerlens-ckpt"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A fresh folder all executors can reach: below ``spark.checkpoint.dir``, local only for local sessions."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix=f"{prefix}-")
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
