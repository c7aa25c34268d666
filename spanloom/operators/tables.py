"""Tables in the folder that executors share: made once, used often, and there still when an executor is lost."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: While a table is written: the job's shuffle files go with its end, and rows dealt out by one of a join's keys stay where they are.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_table(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write ``df`` and read it from there, which cuts the lineage. ``by``: in buckets of that column, as many as there are
    shuffle partitions, so that rows that are dealt out by it already are one file a bucket."""
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    writer = df.write.option("compression", "zstd")
    try:
        if by is None:
            writer.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        name = f"written_{uuid.uuid4().hex}"
        writer.bucketBy(buckets(df), by).sortBy(by).option("path", path).saveAsTable(name)
        table = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay
        return table
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def delete(df: DataFrame) -> None:
    """Delete the files of tables that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
