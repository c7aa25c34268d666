"""Line dedup by overlapping windows of three lines.

Each run of three consecutive lines is hashed; of equal windows anywhere in the corpus the first,
by doc_id and place, stays. A line goes if any later occurrence covers it: overlapping windows
merge into runs of covered lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_same, materialize, text_key


def later_windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, tk, starts)``: for each document, sorted, the first lines of its windows that
    repeat an earlier one."""
    d = docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.split("text", "\n").alias("lines"))
    d = d.where(F.size("lines") >= size)
    at = F.sequence(F.lit(1), F.size("lines") - (size - 1))
    hashed = d.select(
        "doc_id",
        "tk",
        F.transform(at, lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, size), "\n")))).alias("hs"),
    )
    win = hashed.select("doc_id", "tk", F.posexplode_outer("hs").alias("p", "h")).distinct()
    # The first occurrence, combined before the shuffle; only repeated windows are joined.
    place = F.struct("doc_id", "tk", "p")
    first = win.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that the join is one of plain shuffles, in which a frequent window is split.
    first = materialize(first.select("h", "first"), "op7-first")
    later = win.join(first, "h").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_list("p")).alias("starts"))


RESULTS = ("clean_text", "n_lines", "n_removed", "n_spans")


def cleaned(docs: DataFrame, size: int = 3) -> DataFrame:
    """``row``, the given row as a struct, in which no name can clash, with ``clean_text, n_lines, n_removed``
    and ``n_spans`` of its text."""
    d = docs.select(F.struct("*").alias("row"), "doc_id", text_key(F.col("text")).alias("tk"))
    d = join_same(d, later_windows(docs, size), ["doc_id", "tk"]).withColumn("text", F.col("row")["text"])
    d = d.withColumn("starts", F.coalesce("starts", F.array().cast("array<int>")))
    # Several uses of a column below keep it from being inlined into a lambda and made anew for each element.
    d = d.withColumn("lines", F.split("text", "\n")).withColumn(
        "gone", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1)))))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    # Windows touch or overlap, and their runs merge, up to a distance of their size.
    heads = F.filter(
        F.sequence(F.lit(0), F.size("starts") - 1),
        lambda i: (i == 0) | (F.get("starts", i) - F.get("starts", i - 1) > size),
    )
    n_removed = F.size("gone")
    return d.select(
        "row",
        F.when(n_removed == 0, F.col("text"))
        .otherwise(F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n"))
        .alias("clean_text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        n_removed.cast("long").alias("n_removed"),
        F.when(n_removed == 0, 0).otherwise(F.size(heads)).cast("long").alias("n_spans"),
    )


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` with ``clean_text`` (the lines that stay, newline-joined), ``n_lines, n_removed``
    and ``n_spans`` (maximal runs of removed lines).

    Lines are split at newlines and compared exactly. Texts of fewer than three lines are left
    alone; so is null, which has no lines. Rows of one doc_id with one text are one document: they
    keep or lose the same lines. Columns besides doc_id and text pass through, but those named
    like the results, in whatever case, are replaced. No rows give no rows.
    """
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in RESULTS]
    return cleaned(docs, size).select(*own, *RESULTS)
