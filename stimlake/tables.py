"""Reading tables, cutting lineage and sizing work.

Every helper takes the session it is given; nothing here creates one.
"""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a side that may be broadcast; anything above is joined by shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of our own serves a
    session within one process; on a cluster that would be an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    Unlike a cached or locally checkpointed frame, the copy survives the loss of executors, and later
    reads prune columns and push filters down. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stimlake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def parts(rows: int, per: int, least: int = 1) -> int:
    """Number of groups of about ``per`` rows."""
    return max(least, math.ceil(rows / per))


def bucket(n: int, *keys: str | Column) -> Column:
    """Hash bucket 0..n-1 of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcasting if its checked size allows it, else as it is (a shuffle join)."""
    return F.broadcast(df) if small(df, limit) else df


def usable(c: str) -> Column:
    """Neither null nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(c)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Few rows with much work each, over all shuffle partitions: adaptive execution would merge them into one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
