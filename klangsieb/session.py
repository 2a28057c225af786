"""Session factory and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, Arrow.

    On a cluster the master and sizes come from spark-submit; only tests and
    the bench pass ``master``.
    """
    b = SparkSession.builder.appName("klangsieb")
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        _BATCH_SETTING: str(BATCH_BYTES),
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Bytes that one Arrow batch on its way to Python may have.
BATCH_BYTES = 32 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> DataFrame:
    """Make long texts come to Python in batches of bounded size.

    By default only the rows of a batch are limited, so that ten thousand
    texts of a megabyte would be one batch. A limit that the session has set
    itself stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _UNBOUNDED:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


_UNBOUNDED = str(2**31 - 1)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the session's own, or a temporary one if unset.

    ``spark.checkpoint.dir`` names the shared folder on a cluster. The
    temporary folder is only reached where nothing is configured (tests).
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = os.path.join(tempfile.gettempdir(), f"klangsieb-checkpoint-{os.getpid()}")
    sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    Used where two later branches must see the very same rows (partition
    numbers, islands of a search) or where recomputing would cost a second
    pass. Survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
