"""Readers and writers of JSON documents and captured files. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import mime_type

DEFINITION = "definition_id long, name string, version int, skills array<struct<skill_id: long, policy: string>>"
SKILL = "skill_id long, name string, version string, description string, max_iterations int"
REPORT = "case_id long, run int, category string, a long, b long"


def read_definitions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DEFINITION).json(folder)


def read_skills(spark: SparkSession, folder: str) -> DataFrame:
    """Only ``.json`` files; missing versions, descriptions and limits take their defaults."""
    s = spark.read.schema(SKILL).option("pathGlobFilter", "*.json").json(folder)
    return s.select(
        "skill_id", "name", F.coalesce("version", F.lit("1.0")).alias("version"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("max_iterations", F.lit(10)).alias("max_iterations"),
    )


def read_reports(spark: SparkSession, folder: str, modified: bool = False) -> DataFrame:
    """Rows that parse and have their required fields; others are left out, as the file's own reader does.
    With ``modified`` also the name of each row's file and when it was written."""
    r = spark.read.schema(f"{REPORT}, _corrupt_record string").option("mode", "PERMISSIVE").json(folder)
    more = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified")] if modified else []
    r = r.select("*", *more)
    return r.where("_corrupt_record is null and case_id is not null and run is not null and category is not null").drop("_corrupt_record")


def select_reports(reports: DataFrame, name: str, newest: list[Column], last: int | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Of ``reports``, ``newest`` first: for each of ``prefixes`` the first whose ``name`` begins with it, which
    fails if none does; else the ``last`` ones; else all. Adds ``rank``, from 1 on."""
    if prefixes:
        wanted = reports.sparkSession.createDataFrame([(k, p) for k, p in enumerate(prefixes)], "k int, prefix string")
        fits = F.filter(F.array(*[F.when(F.col(name).startswith(p), F.lit(k)) for k, p in enumerate(prefixes)]), lambda x: x.isNotNull())
        rows = F.struct(*[F.col(c) for c in reports.columns])
        first = reports.select(F.explode(fits).alias("k"), F.struct(*[x.alias(f"o{i}") for i, x in enumerate(newest)]).alias("o"), rows.alias("row"))
        first = first.groupBy("k").agg(F.min_by("row", "o").alias("row"))
        found = F.broadcast(wanted).join(first, "k", "left")
        lost = F.raise_error(F.concat(F.lit("no report's name begins with "), F.col("prefix")))
        return found.select(F.when(F.col("row").isNull(), lost.cast(first.schema["row"].dataType)).otherwise(F.col("row")).alias("row"), (F.col("k") + 1).alias("rank")).select("row.*", "rank")
    ordered = reports.orderBy(*newest)
    ordered = ordered.limit(last) if last is not None else ordered
    return ordered.withColumn("rank", F.row_number().over(Window.orderBy(*newest))) if last is not None else ordered


def write_json(df: DataFrame, folder: str) -> str:
    df.write.mode("overwrite").json(folder)
    return folder


def capture_files(spark: SparkSession, folder: str, patterns: list[str], promoted: list[str] = ()) -> DataFrame:
    """``name, mime, size, promoted`` of the files below ``folder``: first those ``promoted`` by name, then what
    matches a glob of ``patterns``, each once. A file that is written in parts is a folder of its name."""
    found = None
    for pattern in patterns:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/{pattern}").select("path", "length")
        found = f if found is None else found.union(f)
    parts = found.distinct().select(F.regexp_extract("path", r"/([^/]*)/[^/]*$", 1).alias("name"), "length")
    parts = parts.withColumn("name", F.regexp_replace("name", "^[^=]*=", ""))
    first = F.col("name").isin(list(promoted)) if promoted else F.lit(False)
    return parts.groupBy("name").agg(F.sum("length").alias("size")).select("name", mime_type(F.col("name")).alias("mime"), "size", first.alias("promoted"))


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``errors``: the names of all rules that a row breaks; a rule that is null is broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return rows.withColumn("errors", F.array_compact(F.array(*broken)))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], backfill: list[str], refresh: list[str]) -> DataFrame:
    """By ``key``: ``backfill`` columns change only where blank, ``refresh`` columns wherever given."""
    j = existing.alias("e").join(incoming.alias("i"), key, "full_outer")
    keep = [F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit("")), F.col(f"i.{c}")).alias(c) for c in backfill]
    return j.select(*key, *keep, *[F.coalesce(F.col(f"i.{c}"), F.col(f"e.{c}")).alias(c) for c in refresh])


def append_batches(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Append ``rows`` below ``folder``, partitioned by the columns ``by``, which name a batch among them: a batch that is
    written again replaces itself, and others stay. A job that fails leaves no partition half written, as Spark moves
    finished files in at its end."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def append_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, folder: str, by: list[str]) -> None:
    """Append ``edges(src, dst, ...)`` both ends of which exist to ``folder/kept=true``, and the skipped ones, in the same
    job, to the side table ``folder/kept=false``. ``sources`` and ``targets`` have an ``id``."""
    here = lambda nodes, c: nodes.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}")).dropDuplicates([c])
    found = edges.join(here(sources, "src"), "src", "left").join(here(targets, "dst"), "dst", "left")
    kept = F.coalesce(F.col("has_src") & F.col("has_dst"), F.lit(False))
    append_batches(found.withColumn("kept", kept).drop("has_src", "has_dst"), folder, ["kept", *by])
