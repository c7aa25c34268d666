"""Helpers that several training-data operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything between words: ASCII other than digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    It is set here only for a local master that names none (tests, one machine); a cluster must
    name it, since a machine-local folder would not survive the loss of an executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table: cuts the lineage, and
    the rows outlive the executors that made them. The shuffle files of the job go with its end."""
    spark = df.sparkSession
    path = new_path(spark, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, once what was made of them is written."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null. Pure ASCII takes the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """Array of the words of ``text``, A-Z lower-cased; null gives an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def shingle_hashes(w: str, k: int) -> Column:
    """Array with a 64-bit hash of the ``k`` words from each position of array column ``w``.

    An array of fewer than ``k`` words gives one hash of what there is; who uses the hashes
    compares the words afterwards.
    """
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)]))


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, as ``(node, component)`` with the least node as label.

    ``edges`` has non-null columns ``a`` and ``b`` of one type. Alternates large-star and
    small-star steps until nothing changes: each node hands its neighbours to the least of them, so that
    a path halves in a round and no node's edges outgrow the graph. Every round is written to the shared
    folder; the driver sees a count and two sums of hashes only, by which it knows a round that changed
    nothing. Nodes without an edge to another node are not in the result.
    """

    def seen(table: DataFrame) -> tuple:
        x = [F.bit_xor(F.xxhash64("a", "b", F.lit(k))) for k in (0, 1)]
        return tuple(table.agg(F.count("*"), *x).first())

    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "cc-edges",
    )
    now, was = seen(e), None
    while now[0] and now != was:
        before, was = e, now
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large-star: each neighbour above the node is tied to the least of the neighbourhood.
        # Written before the join, so that it is one of plain shuffles and a frequent node is split.
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "cc-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small-star: each node and its smaller neighbours are tied to the least of them.
        large = materialize(large, "cc-large")
        lower = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-lower")
        joined = large.join(lower, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            lower.select("a", F.col("m").alias("b"))
        )
        e = materialize(small.where("a <> b").distinct(), "cc-edges")
        now = seen(e)
        discard(before, least, large, lower)
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def join_same(left: DataFrame, right: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """Join on equal ``key``, nulls equal to nulls; the columns of ``left``, then the others of ``right``."""
    for c in key:
        right = right.withColumnRenamed(c, f"__{c}")
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(right, on, how).drop(*[f"__{c}" for c in key])
