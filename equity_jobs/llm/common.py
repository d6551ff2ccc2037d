"""What the training-data operators share: the cluster's shared folder and lineage cuts."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equity_jobs.sources.shared import shared_dir


def written(df: DataFrame, name: str, **options: int) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and safe when an executor is lost. options: the writer's."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint; its partitions stay as they are."""
    shared_dir(df.sparkSession, "checkpoint")
    return df.checkpoint()


def relieve(spark: SparkSession) -> None:
    """Lets the driver drop what earlier steps left: plans and their compiled classes, and with
    them, by Spark's cleaner, shuffles and broadcasts that have no reader any more.

    Spark cleans up after the driver's JVM has collected; a driver whose heap is large enough
    seldom does so by itself, and keeps its heap at its largest.
    """
    spark.sparkContext._jvm.System.gc()


EVERY = 2.0  # seconds between collections


@contextmanager
def relieved(spark: SparkSession) -> Iterator[None]:
    """relieve() again and again while the body runs, for many small jobs within one call, such as the rounds of a fit.

    Each job broadcasts its task, and rounds their vectors: buffers of some MB, for which the JVM
    rather enlarges its heap than collects.
    """
    over = threading.Event()

    def run() -> None:
        while not over.wait(EVERY):
            relieve(spark)

    worker = InheritableThread(target=run, daemon=True)
    worker.start()
    try:
        yield
    finally:
        over.set()
        worker.join()


def ascii_lower(text: Column) -> Column:
    """A-Z only, as the contracts ask; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
