"""The shared folder that the cluster names for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir. Without one there is an error: a folder of one machine would be lost with it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = os.path.join(tempfile.gettempdir(), "quillstream-checkpoints")  # one machine, as in tests
        sc.setCheckpointDir(where)


def spread(frame: DataFrame) -> DataFrame:
    """A scan or checkpoint of fewer parts than there are cores, dealt out before costly work in Python. Larger input stays as it is.

    Only for frames that are read as they are: asking others for their parts would run them.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def written(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder and read from there: a checkpoint in columns and compressed, which keeps texts that recur
    from language to language about once. Its files stay until the folder is cleared."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    where = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(frame.schema).parquet(where)
