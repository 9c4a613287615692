"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and Spark runs in this process (tests), a temporary folder."""
    name = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if name:
        return name
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="dependra-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage and computes ``df`` once; the files survive lost
    executors and go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` for several readers: written if it is made of more than one table, else as it is.

    Each reader would make the joins again, and all that is below them.  What
    comes from one table is left to Spark, which then reads and adds up only
    the columns that a reader asks for; so are types that Parquet doesn't have.
    """
    one = df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    return df if one or any(t in df.schema.simpleString() for t in ("void", "interval")) else staged(df, name)
