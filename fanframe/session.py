"""Configuration: one call sets the session defaults that the operators rely on."""

from __future__ import annotations

import dataclasses
import logging
import warnings

from pyspark.sql import SparkSession

log = logging.getLogger("fanframe")


@dataclasses.dataclass
class Config:
    nb_workers: int | None = None  # partitions of Python stages; None: the session's parallelism
    progress_bar: bool = False
    verbose: int = 2


_config = Config()


def config() -> Config:
    return _config


def initialize(spark: SparkSession | None = None, nb_workers: int | None = None, progress_bar: bool = False, verbose: int = 2, use_memory_fs: bool | None = None, shm_size_mb: int | None = None) -> SparkSession:
    """Set up a session. use_memory_fs has no effect, since data always travels as Arrow; shm_size_mb is deprecated."""
    if nb_workers is not None and nb_workers < 1:
        raise ValueError("nb_workers must be positive")
    if shm_size_mb is not None:
        warnings.warn("shm_size_mb is deprecated and has no effect", DeprecationWarning, stacklevel=2)
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.adaptive.enabled": "true"}.items():
        spark.conf.set(key, value)
    _config.nb_workers, _config.progress_bar, _config.verbose = nb_workers, progress_bar, verbose
    log.setLevel({0: logging.ERROR, 1: logging.WARNING}.get(verbose, logging.INFO))
    log.info("Python stages run in %s partitions, Arrow transport", nb_workers or spark.sparkContext.defaultParallelism)
    return spark
