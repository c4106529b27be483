"""Session helpers: the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    On a cluster this is the shared folder named in ``spark.checkpoint.dir``;
    it is read from the session, never invented. Raises when none is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if not conf:
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set: iterative operators cut lineage with "
            "reliable checkpoints and need a shared folder")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master, one of its own if unset.

    A cluster names its shared folder in ``spark.checkpoint.dir``: without it
    this raises, since executors would write tables to folders that the others
    cannot see.
    """
    try:
        return checkpoint_dir(spark)
    except RuntimeError:
        if not is_local(spark):
            raise
        local = tempfile.mkdtemp(prefix="trafficgraph-ckpt-")
        spark.sparkContext.setCheckpointDir(local)
        return spark.sparkContext.getCheckpointDir()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (``local``, ``local[n]``)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")
