"""Exact dedup over an extendible-hash index on shared files.

A text's key is a 64-bit hash of its characters without blanks. Equal texts combine within parts of the
input, so that a text that a third of the rows share reaches its bucket as a few entries. The
directory begins as one slot and doubles while a bucket holds more than ``capacity`` keys: the
bucket splits on its next leading bit, a range of keys becomes two. It is a table, as is the
index, so neither is bounded by one machine. The task that owns a bucket puts its entries into the chain of
their key, comparing bytes along it; which document stays, and how many there are, comes from there. Documents
find their entry through directory slot, bucket and key; where a chain has several entries, the bytes decide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANK, discard, materialize

#: Leading bits that a directory can look at.
MOST_BITS = 60
#: A text comes to its bucket as so many entries at most, besides those of missing ids.
PARTS = 16


def _prefix(h: Column, bits: int) -> Column:
    """The leading bits of a signed 64-bit hash, 0 to 2**bits - 1."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def hash_key(norm: Column, bits: int = 64) -> Column:
    """Key of a text; fewer ``bits`` make keys collide, which tests use."""
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def directory(entries: DataFrame, capacity: int) -> tuple[int, DataFrame]:
    """Global depth, and the table ``(slot, bucket, local_depth)``: which bucket the keys with a slot's
    leading bits are in. Slots that no entry of ``entries(h)`` falls into are left out; a bucket is
    named by its range: local depth and leading bits.

    It begins as one bucket. While buckets hold more than ``capacity`` entries, each of them splits on its
    next bit, and the directory doubles with the first that gets deeper than it. Entries are counted once,
    by more bits than will be needed; splitting deals out these counts. A split that more bits can't
    bring about, of one key, ends.
    """
    total = entries.count()
    deepest = 0 if total <= capacity else min(MOST_BITS, (total // capacity).bit_length() + 2)
    while True:
        cells = materialize(entries.groupBy(_prefix(F.col("h"), deepest).alias("p")).agg(F.count("*").alias("n")), "op4-cells")
        fullest = cells.agg(F.max("n").alias("n")).first()["n"] or 0
        if fullest <= capacity or deepest == MOST_BITS:
            break
        discard(cells)
        deepest = min(MOST_BITS, deepest + max(2, deepest // 2))
    depth, unsettled, settled, used = 0, cells, [], []
    while True:
        bucket = F.shiftright("p", deepest - depth)
        load = materialize(unsettled.groupBy(bucket.alias("r")).agg(F.sum("n").alias("load")), "op4-buckets")
        over = load.where(F.col("load") > capacity) if depth < deepest else load.limit(0)
        settled.append(load.join(over, "r", "left_anti").select(F.lit(depth).alias("local_depth"), "r"))
        used += [load]
        if over.isEmpty():
            break
        # The full buckets split: their entries go by one more bit.
        unsettled = materialize(unsettled.withColumn("r", bucket).join(over.select("r"), "r", "left_semi").select("p", "n"), "op4-split")
        used += [unsettled]
        depth += 1
    name = F.concat_ws(":", F.col("local_depth").cast("string"), F.col("r").cast("string"))
    # A bucket that is shallower than the directory has several slots: those that its entries fall into.
    owned = [cells.join(b, F.shiftright("p", deepest - d) == F.col("r")).select("p", name.alias("bucket"), "local_depth") for d, b in enumerate(settled)]
    slots = reduce(DataFrame.union, owned).select(F.shiftright("p", deepest - depth).alias("slot"), "bucket", "local_depth").distinct()
    slots = materialize(slots, "op4-directory")
    discard(cells, *used)
    return depth, slots


def _same(a: Column, b: Column) -> Column:
    """Whether two texts of one key are the same text: by their bytes."""
    return a == b


def _link(chain: Column, x: Column) -> Column:
    """A bucket's chain of one key with entry ``x`` put in: added to the entry of the same text, which then keeps the
    better of both documents, or hung on at the end."""

    def merged(e: Column) -> Column:
        better = F.when(x["ord"] > e["ord"], x).otherwise(e)
        one = F.struct(e["norm"].alias("norm"), (e["group_size"] + x["group_size"]).alias("group_size"), *[better[c].alias(c) for c in ("ord", "keep_id", "keep_n")])
        return F.when(_same(e["norm"], x["norm"]), one).otherwise(e)

    there = F.exists(chain, lambda e: _same(e["norm"], x["norm"]))
    return F.when(there, F.transform(chain, merged)).otherwise(F.array_append(chain, x))


def build_index(docs: DataFrame, capacity: int = 1_024, key_bits: int = 64) -> tuple[DataFrame, DataFrame, int]:
    """Write directory and index of ``docs``; returns the index, the directory and its depth.

    Each part of the input brings a text as one entry, however often it has it; what is one text over all
    parts is for the owner of its bucket to find. The index has one row per distinct normalised text:
    ``bucket, h, chain`` (place among the texts of one key), ``chained`` (how many there are), ``norm`` (only if
    several), ``text_sha256, keep_id, keep_n`` and ``group_size``; a bucket's entries are together in one file.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    norm = F.regexp_replace("text", BLANK, "")
    # More code points first, then the smaller id; a missing id comes last.
    order = F.length("text").cast("decimal(10,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") - F.coalesce(
        F.col("doc_id").cast("decimal(20,0)"), F.lit("9223372036854775807").cast("decimal(20,0)")
    )
    d = d.select("doc_id", norm.alias("norm"), order.cast("decimal(38,0)").alias("ord"), F.length("text").alias("n"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    entries = d.groupBy(hash_key(F.col("norm"), key_bits).alias("h"), part, "norm").agg(
        F.count("*").alias("group_size"), F.max("ord").alias("ord"), F.max_by("doc_id", "ord").alias("keep_id"), F.max("n").alias("keep_n")
    )
    entries = materialize(entries.drop("part"), "op4-entries")
    depth, slots = directory(entries.select("h").distinct(), capacity)
    placed = entries.withColumn("slot", _prefix(F.col("h"), depth)).join(slots.select("slot", "bucket"), "slot").drop("slot")
    # The owner of a bucket puts its entries into the chains of their keys.
    entry = F.struct("norm", "group_size", "ord", "keep_id", "keep_n")
    owned = placed.repartition("bucket").groupBy("bucket", "h").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    none = F.filter("x", lambda _: F.lit(False))
    owned = owned.select("bucket", "h", F.aggregate("x", none, _link).alias("chain"))
    index = owned.select("bucket", "h", F.size("chain").alias("chained"), F.posexplode("chain").alias("chain", "e"))
    index = index.select(
        "bucket", "h", "chain", "chained", F.when(F.col("chained") > 1, F.col("e.norm")).alias("norm"),
        F.sha2("e.norm", 256).alias("text_sha256"), "e.keep_id", "e.keep_n", "e.group_size",
    )
    index = materialize(index.sortWithinPartitions("bucket", "h", "chain"), "op4-index")
    discard(entries)
    return index, slots, depth


def exact_dedup(docs: DataFrame, capacity: int = 1_024, key_bits: int = 64) -> DataFrame:
    """Per document: ``doc_id, keep_id`` (of the row that stays), ``group_size, kept, text_sha256``.

    Texts are equal when identical without blanks (space, tab to carriage return); null counts as
    empty, and all empty texts are equal. The row with the most code points in the original text
    stays, then the smallest doc_id; a missing doc_id comes last. Rows that repeat a doc_id with
    the text of the row that stays are that document again and share its verdict. Other columns
    are ignored; no rows give no rows.
    """
    index, slots, depth = build_index(docs, capacity, key_bits)
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", F.length(text).alias("n"), F.regexp_replace(text, BLANK, "").alias("norm"))
    keys = keys.withColumn("h", hash_key(F.col("norm"), key_bits)).withColumn("slot", _prefix(F.col("h"), depth))
    several = index.where("chained > 1")

    def found(d: DataFrame, entries: DataFrame) -> DataFrame:
        return d.join(slots.select("slot", "bucket"), "slot").join(entries, ["bucket", "h"])

    # A key with one entry needs no look at bytes: every document with that key is in it.
    out = found(keys.drop("norm"), index.where("chained = 1").drop("norm"))
    columns = ["doc_id", "n", "keep_id", "keep_n", "group_size", "text_sha256"]
    out = out.select(columns)
    if not several.isEmpty():
        entries = several.withColumnRenamed("norm", "entry")
        out = out.union(found(keys, entries).where(F.col("norm") == F.col("entry")).select(columns))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("kept"),
        "text_sha256",
    )
