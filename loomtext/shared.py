"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: what a writing task holds.
ROW_GROUP = 16 << 20
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a fresh local one only where it is unset and
    all of Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _LOCAL.get("dir")
        if not base:
            base = _LOCAL["dir"] = tempfile.mkdtemp(prefix="loomtext-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.  Tables
    of an application share a folder of its name, so that what a broken run leaves is easy to find."""
    path = os.path.join(shared_dir(spark), f"loomtext-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _file(spark: SparkSession, name: str) -> tuple:
    """The file system and the path of a name, in any store that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def there(spark: SparkSession, name: str) -> bool:
    fs, path = _file(spark, name)
    return fs.exists(path)


def remove(spark: SparkSession, name: str) -> None:
    fs, path = _file(spark, name)
    fs.delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more (what came from them is itself stored)."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, unreferenced plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
