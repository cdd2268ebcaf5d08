"""Tables in the shared folder that are done with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table this session wrote under the shared folder; nothing may read it any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
