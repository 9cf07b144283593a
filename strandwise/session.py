"""Session settings and the shared folder that survives the loss of executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "strandwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and a UTC clock.

    Partition counts are left to the cluster: adaptive execution coalesces small shuffles and
    splits skewed ones, so only overrides given in ``conf`` are set here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Let adaptive execution split a hot join key even where that costs one more shuffle."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


#: Folders made for local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a folder of its own, which goes when Python ends; a
    cluster raises, since its executors do not see each other's disks. No setting is changed.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _LOCAL[context.applicationId]


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a cut in the lineage.

    Used where a later step must see one fixed version of an expensive or sampled result.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """As :func:`durable`, and the shuffle files of the write go when it ends, not when the driver next collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return durable(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables that ``durable`` wrote, once all that reads them has been written."""
    for df in tables:
        files = df.inputFiles()
        if files:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``keys`` in the shared folder: later groups and joins on the keys stay in place.

    One file for each bucket, as many buckets as the session has shuffle partitions. For keys whose groups fit a task.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
    dealt.option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
