"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

Every benchmark item is cut into windows of consecutive words; a window occurs in a document only
if each of its shingles does, so one of them is necessary and enough to find it (for containment the
prefix has length one). Shingles are ordered by rarity: in how many windows, then how often the
words occur, counted over all items. Only each window's rarest meets the corpus. The
shingle's offset in the window bounds where the window can lie, the lengths bound whether it fits,
and a hash of the whole stretch ends what doesn't match; the words are compared afterwards.

The corpus is read once. Its shingles explode and meet the prefixes in one fused stage, and only
stretches that match leave it. The prefixes go to the executors in blocks of at most
``block_shingles``, so a larger benchmark costs more passes, not more memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import join_same, materialize, text_key, words

#: Hash that stands for "this document exists": each document has it once, after its shingles.
HERE = -6148914691236517206


def windows_of(items: DataFrame, window: int = 13) -> DataFrame:
    """``(item_id, win)`` for each window of ``window`` consecutive words; an item of fewer words,
    but not none, is one window."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = w.select("item_id", F.transform(starts, lambda i: F.slice("w", i, window)).alias("wins"))
    return cut.select("item_id", F.explode_outer("wins").alias("win")).distinct()


def prefixes_of(windows: DataFrame, k: int) -> DataFrame:
    """``(h, kk, o, len, stretch)`` for each distinct window: hash and offset of its rarest shingle of
    ``kk = min(k, len)`` words, and a hash of all its words."""
    own = windows.select("win").distinct()
    # Counts are written before they are joined: a join of two plain shuffles splits a frequent word.
    often = materialize(own.select(F.explode("win").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "op1-words")
    size = F.size("win")
    at = own.select("win", F.explode(F.sequence(F.lit(0), F.greatest(size - k, F.lit(0)))).alias("o"))
    at = at.select("win", "o", F.slice("win", F.col("o") + 1, k).alias("shingle"))
    # Rarity: windows with the shingle; of equal ones that whose most frequent word is the rarest, then the text.
    shared = materialize(at.groupBy("shingle").agg(F.countDistinct("win").alias("df")), "op1-shared")
    words_of = at.select("shingle").distinct().select("shingle", F.explode("shingle").alias("word"))
    weight = words_of.join(often, "word").groupBy("shingle").agg(F.min("n").alias("rarest"), F.sum("n").alias("all"))
    ranked = at.join(shared, "shingle").join(materialize(weight, "op1-weights"), "shingle")
    first = ranked.groupBy("win").agg(F.min(F.struct("df", "rarest", "all", "shingle", "o")).alias("x"))
    kk = F.least(size, F.lit(k))
    return first.select(
        F.xxhash64("x.shingle").alias("h"), kk.alias("kk"), F.col("x.o").alias("o"), size.alias("len"), F.xxhash64("win").alias("stretch")
    ).distinct()


def _matches(docs: DataFrame, prefixes: DataFrame, k: int, lengths: list[int]) -> DataFrame:
    """Stretches of documents that hold a prefix and hash like its window, ``(doc_id, tk, n_words, s, cand)``;
    with a prefix ``HERE`` also one row without stretch for each document."""
    d = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("tk"), words(F.col("text")).alias("w"))
    # Place -1 stands for the document. Hashes are made of the exploded places, which stays in generated code.
    last = F.greatest(F.size("w") - min(lengths), F.lit(-1))
    at = d.select("doc_id", "tk", "w", F.explode(F.sequence(F.lit(-1), last)).alias("p"))

    def shingle(n: int) -> Column:
        return F.when(F.col("p") < 0, F.lit(HERE)).otherwise(F.xxhash64(*[F.get("w", F.col("p") + j) for j in range(n)]))

    if lengths == [k]:
        at = at.select("*", F.lit(k).alias("kk"), shingle(k).alias("h"))
    else:
        each = [F.struct(F.lit(n).alias("kk"), shingle(n).alias("h")) for n in lengths]
        at = at.select("*", F.inline(F.array(*each)))
    s = F.col("p") - F.col("o")
    here = F.col("p") < 0
    fits = (s >= 0) & (s + F.col("len") <= F.size("w"))
    same = F.when(fits, F.xxhash64(F.slice("w", s + 1, F.col("len")))) == F.col("stretch")
    return at.join(F.broadcast(prefixes), ["h", "kk"]).where(here | same).select(
        "doc_id",
        "tk",
        F.size("w").cast("long").alias("n_words"),
        F.when(~here, s).alias("s"),
        F.when(~here, F.slice("w", s + 1, F.col("len"))).alias("cand"),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, block_shingles: int = 250_000,
    with_key: bool = False,
) -> DataFrame:
    """Per document, how much of it stands in benchmark windows.

    Returns ``doc_id, n_words, n_hit`` (words inside any occurrence of a window), ``n_items``,
    ``items_sha256`` (of the item ids, sorted as strings and comma-joined) and ``contaminated``
    (a hit, and at least a twentieth of the words hit); with ``with_key`` also ``tk``, the key of
    the text.

    Null or wordless texts have no words and are clean; wordless items match nothing; an item
    without id hits but is not listed. Rows of one doc_id with different texts are judged apart,
    identical rows all come back. An empty benchmark leaves all clean. Other columns are ignored.
    """
    spark = docs.sparkSession
    wins = materialize(windows_of(benchmark, window), "op1-windows")
    prefixes = materialize(prefixes_of(wins, k), "op1-prefixes")
    lengths = sorted({r.kk for r in prefixes.select("kk").distinct().collect()} | {k})
    blocks = max(1, -(-prefixes.count() // block_shingles))
    here = spark.range(1).select(F.lit(HERE).alias("h"), F.lit(k).alias("kk"), F.lit(0).alias("o"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("stretch"))
    found = None
    for b in range(blocks):
        own = prefixes.where(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else prefixes
        part = _matches(docs, own.union(here) if b == 0 else own, k, lengths)
        found = part if found is None else found.union(part)
    found = materialize(found, "op1-found")
    key = ["doc_id", "tk"]
    # The words themselves decide; items that share a window are all told.
    items = wins.withColumnRenamed("win", "cand")
    at = found.where("cand is not null").join(items, "cand")
    at = at.select(*key, F.col("s"), (F.col("s") + F.size("cand")).alias("e"), "item_id")
    before = Window.partitionBy(*key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    spans = at.select(*key, "s", "e").distinct()
    hit = (
        spans.withColumn("upto", F.coalesce(F.max("e").over(before), F.lit(0)))
        .groupBy(*key)
        .agg(F.sum(F.greatest(F.col("e") - F.greatest("s", "upto"), F.lit(0))).alias("n_hit"))
    )
    of_items = at.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    everyone = found.where("cand is null").groupBy(*key).agg(F.first("n_words").alias("n_words"), F.count("*").alias("copies"))
    out = join_same(join_same(everyone, hit, key), of_items, key)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        *(["tk"] if with_key else []),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
