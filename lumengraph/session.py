"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lumengraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    Shuffle parallelism is left to adaptive execution: the initial number of
    partitions is high and small ones are merged at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="lumengraph-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Tables written by ``cut`` since the innermost ``scratch`` began.
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)
Result = TypeVar("Result")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``cut`` writes inside the block when it ends.

    Results that are still wanted must be collected or written elsewhere by then.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def at_once(calls: Sequence[Callable[[], Result]], threads: int | None = None) -> list[Result]:
    """The results of calls that start Spark jobs of their own, run side by side in this ``scratch``."""
    owned = [(copy_context(), call) for call in calls]
    with ThreadPool(threads or len(owned)) as pool:
        return pool.map(lambda own: own[0].run(own[1]), owned, chunksize=1)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    Used between the rounds of an iterative operator and where a result is read several
    times, so that neither the plan nor the recomputation after a lost executor grows
    with what came before. A written table also tells the planner its true size, so
    small sides are broadcast and large ones are not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumengraph/{uuid.uuid4().hex}"
    if (paths := _written.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
