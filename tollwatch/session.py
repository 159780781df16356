"""Session settings and the shared folder for checkpoints and written tables."""

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app="tollwatch", cpus="*", partitions=8, memory="8g", **conf):
    """Session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark):
    """Folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own; elsewhere a machine-local folder would not be seen by all executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = os.path.join(tempfile.mkdtemp(prefix="tollwatch-"), "shared")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark, name):
    """New, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Cut lineage through the shared folder, so that lost executors cost nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def released(spark):
    """Have shuffle files deleted of frames that are gone.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df, name):
    """Keep ``df`` as a table in the shared folder; readers get only the columns they use."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
