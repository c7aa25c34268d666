"""Mixing sources to target weights, block by block.

Each source's documents are laid end to end and cut into blocks of ``block`` words. Output slots
are dealt to shards; every shard draws how many of its slots each source gets from a multinomial
over the targets. A source's slots, in shard order, walk through its blocks along a pseudorandom
permutation of their indexes, again and again until its target is reached; draws beyond that go to
sources that are short. Blocks, with their words, join their slots by index: that is the mix, in
rows of shards. Nothing depends on the order in which tasks run, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BLANK, discard, materialize, text_key

WEIGHTS = (3, 1, 2)
ROUNDS = 20
#: Passes in which the shards are written.
PASSES = 4
#: Shards whose draws are summed in one window.
SHARD_GROUP = 4096
#: Sources in a range whose sums one task runs through.
RANGE_ROWS = 100_000
#: A word: a run of non-blanks.
RUN = "[^" + BLANK[1:] + "+"
#: More sources than this are joined by shuffling instead of broadcasting.
BROADCAST_SOURCES = 10_000


def _words(more: int | str) -> str:
    """Pattern of a word and at most ``more`` others after it."""
    return f"{RUN}+(?:{BLANK}++{RUN}+){{0,{more}}}+"


def swap_or_not(i: Column, back: bool = False) -> Column:
    """Place of index ``i`` below ``n_blocks`` in the permutation that columns ``seed`` and ``shifts``
    (a number below ``n_blocks`` for each round) give. A round pairs the indexes by reflection and
    swaps a pair or not, so any number of blocks works without retries, and the rounds in reverse
    order undo it."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.get("shifts", r) - x, F.col("n_blocks"))
        swap = F.xxhash64("seed", r, F.greatest(x, mirror)).bitwiseAND(1) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(rounds, i, step)


def running(df: DataFrame, rows: int, order: list, name: str, **sums: Column) -> DataFrame:
    """``df``, of ``rows`` rows, with a column for each of ``sums``: its sum over all rows before in ``order``, which
    leaves no ties. Ranges of rows are summed each in its own task, what comes before a range from one row for each."""
    own, base = {k: f"{k}__own" for k in sums}, {k: f"{k}__base" for k in sums}
    ranges = df.withColumns({own[k]: c for k, c in sums.items()}).repartitionByRange(max(1, -(-rows // RANGE_ROWS)), *order)
    ranges = materialize(ranges.withColumn("range", F.spark_partition_id()), name)
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.groupBy("range").agg(*[F.sum(c).alias(c) for c in own.values()])
    bases = bases.select("range", *[F.coalesce(F.sum(own[k]).over(across), F.lit(0)).alias(base[k]) for k in sums])
    out = ranges.join(F.broadcast(bases), "range")
    out = out.withColumns({k: F.coalesce(F.sum(own[k]).over(inside), F.lit(0)) + F.col(base[k]) for k in sums})
    return out.drop("range", *own.values(), *base.values())


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """``source, source_size, target, sid`` for each source of ``sizes(source, size)``; ``sid`` numbers them.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` times all
    words; a target stops at ``cap`` times its source's size and the excess goes to the others by
    weight until none is above. That levels at one number L with target = min(cap * size,
    L * weight): sources are capped in the order of cap * size / weight.
    """
    s = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "op10-sizes")
    rows, words = s.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    by_name = [F.col("source").isNull(), F.col("source")]
    s = running(s, rows, by_name, "op10-named", sid=F.lit(1).cast("long"))
    s = s.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights)).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("w"))
    s = running(s, rows, ["ratio", *by_name], "op10-levels", most_before=F.col("most"), w_before=F.col("w"))
    # L if exactly the sources before this one are capped. The first at or below its ratio is right;
    # from there on levels fall, so it is the largest.
    all_w = s.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    level = (F.lit(words * share) - F.col("most_before")) / (F.lit(all_w) - F.col("w_before"))
    top = s.agg(F.max(F.when(level <= F.col("ratio"), level))).first()[0]
    target = F.least("most", F.coalesce(F.lit(top).cast("double") * F.col("w"), F.col("most")))
    return s.select("source", "source_size", target.alias("target"), "sid")


def mix(docs: DataFrame, **how) -> DataFrame:
    """Per document: ``doc_id, source, size`` (runs of non-blanks in the text; null has none),
    ``source_size, target`` (of its source) and ``taken``: how many words the mix takes from it, as
    counted in the shards that ``mix_shards`` writes.

    The words taken from a source equal its target to the word; no document gives more than
    ``cap`` times its size. Sources without words have target 0. Repeated rows are documents of
    their own; a null doc_id or source is a value like others. No rows give no rows.
    """
    d, shards = mix_shards(docs, **how)
    spans = shards.select("sid", F.explode("spans").alias("x")).select("sid", "x.off", "x.n")
    taken = spans.groupBy("sid", "off").agg(F.sum("n").alias("got"))
    got = F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(F.lit(0).cast("long"))
    return d.join(taken, ["sid", "off"], "left").select("doc_id", "source", "size", "source_size", "target", got.alias("taken"))


def mix_shards(
    docs: DataFrame,
    share: float = 1.5,
    cap: int = 2,
    weights=WEIGHTS,
    block: int = 64,
    shard_slots: int = 4096,
    chunk_docs: int = 5_000,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The documents, as ``doc_id, source, size, source_size, target, sid, off``, and the mix, written
    to the shared folder: ``shard, place, source, sid, b, use, text, spans``.

    ``off`` is where a document's words begin among those of its source (number ``sid``). A row of the
    mix holds the first ``use`` words of block ``b``, with the blanks between them and a new line
    between documents; ``spans`` lists the documents (by ``off`` and ``doc_id``) and their numbers of words. The rows of a
    shard are in one file, by ``place``.
    """
    # Documents of a source are laid end to end in chunks, in which their offsets are summed; a frequent source
    # spans many chunks. Written with their words, so that all else reads numbers only.
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(RUN)).cast("long")
    chunks = max(1, -(-docs.count() // chunk_docs))
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("key")
    chunk = F.pmod(F.xxhash64("doc_id", "tk", F.lit(seed)), F.lit(chunks)).alias("chunk")
    whole = docs.select("doc_id", "source", size.alias("size"), text_key(F.col("text")).alias("tk"), "text").select("*", key, chunk)
    upto = Window.partitionBy("key", "chunk").orderBy("doc_id", "tk").rowsBetween(Window.unboundedPreceding, 0)
    placed = whole.select("doc_id", "source", "size", "key", "chunk", (F.sum("size").over(upto) - F.col("size")).alias("within"), "text")
    placed = materialize(placed, "op10-placed")
    targets = source_targets(placed, share, cap, weights)
    src = materialize(
        targets.withColumn("seed", F.xxhash64("source", F.col("source").isNull(), F.lit(seed)))
        .withColumn("want", F.floor("target").cast("long"))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long")),
        "op10-sources",
    )
    n_sources = src.count()
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("key", "chunk").agg(F.sum("size").alias("s"))
    bases = bases.select("key", "chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    bases = materialize(bases, "op10-bases")
    d = placed.join(bases, ["key", "chunk"]).join(small(src.select(key, "sid", "source_size", "target")), "key")
    d = d.withColumn("off", F.col("base") + F.col("within"))
    laid = materialize(d.select("doc_id", "source", "size", "source_size", "target", "sid", "off"), "op10-laid")
    d = d.where("size > 0")

    # A document's words are cut where blocks end: made-up words in front fill its first block.
    pad = F.pmod(F.col("off"), F.lit(block)).cast("int")
    padded = F.concat(F.repeat(F.lit("x "), pad), F.col("text"))
    cut = F.regexp_extract_all(padded, F.lit(_words(block - 1)), F.lit(0))
    pieces = d.select("sid", "off", "doc_id", "size", pad.alias("pad"), F.posexplode(cut).alias("i", "piece"))
    b = F.floor(F.col("off") / block) + F.col("i")
    lo, hi = F.greatest("off", b * block), F.least(F.col("off") + F.col("size"), (b + 1) * block)
    piece = F.when(F.col("i") == 0, F.regexp_replace(F.substr("piece", 2 * F.col("pad") + 1), "^" + BLANK + "+", "")).otherwise(F.col("piece"))
    pieces = pieces.select("sid", b.alias("b"), F.struct("off", "doc_id", (hi - lo).alias("n"), piece.alias("piece")).alias("x"))
    blocks = pieces.groupBy("sid", "b").agg(F.array_sort(F.collect_list("x")).alias("x"))
    span = lambda x: F.struct(x["off"].alias("off"), x["doc_id"].alias("doc_id"), x["n"].alias("n"))
    blocks = blocks.select("sid", "b", F.array_join(F.col("x.piece"), "\n").alias("text"), F.transform("x", span).alias("spans"))
    slots, used = _slots(src, n_sources, block, cap, shard_slots, seed, small)
    slots = slots.groupBy("sid", "b").agg(F.max("length").alias("length"), F.collect_list(F.struct("shard", "place", "use")).alias("slots"))
    # A block's slots come to where the block is made, so that its text is not dealt out again for the join.
    blocks = materialize(blocks.join(slots.hint("shuffle_hash"), ["sid", "b"]), "op10-blocks")
    discard(placed, *used)

    def shards_of(turn: int) -> DataFrame:
        mine = F.filter("slots", lambda x: F.pmod(x["shard"], F.lit(PASSES)) == turn)
        rows = blocks.select("sid", "b", "length", "text", "spans", F.explode(mine).alias("x"))
        rows = rows.select("sid", "b", "length", "text", "spans", "x.*").join(small(src.select("sid", "source")), "sid")
        return _cut(rows, block).repartition("shard").sortWithinPartitions("shard", "place")

    # In passes, as the shuffle of one is dropped before the next.
    shards = reduce(DataFrame.union, [materialize(shards_of(i), "op10-shards") for i in range(PASSES)])
    discard(blocks)
    return laid, shards


def _cut(rows: DataFrame, block: int) -> DataFrame:
    """Rows of the mix with the words they use."""
    # Only a source's last slot takes part of a block.
    part = F.col("use") < F.col("length")
    first = F.regexp_substr("text", F.concat(F.lit(_words("")[:-2]), (F.col("use") - 1).cast("string"), F.lit("}+")))
    rows = rows.withColumn("text", F.when(part, first).otherwise(F.col("text")))
    at = lambda x: F.greatest(x["off"] - F.col("b") * block, F.lit(0))
    kept = F.transform("spans", lambda x: F.struct(x["off"].alias("off"), x["doc_id"].alias("doc_id"), F.least(x["n"], F.col("use") - at(x)).alias("n")))
    rows = rows.withColumn("spans", F.when(part, F.filter(kept, lambda x: x["n"] > 0)).otherwise(F.col("spans")))
    return rows.select("shard", "place", "source", "sid", "b", "use", "text", "spans")


def _slots(src: DataFrame, n_sources: int, block: int, cap: int, shard_slots: int, seed: int, small) -> tuple[DataFrame, list[DataFrame]]:
    """The tables that it reads, and ``(shard, place, sid, b, length, use)``: every slot that takes words, the block that comes there, its
    number of words, and how many of its first words are used (all, but in a source's last slot)."""
    # All blocks of a source are full but the last, whose turn in each round of the permutation is
    # where the permutation puts it. So many slots reach the target in any case:
    quota = F.ceil((F.col("want") + cap * F.col("short")) / block).cast("long")
    plan = src.where("want > 0").withColumn("short", F.col("n_blocks") * block - F.col("source_size"))
    plan = plan.select("sid", "seed", "n_blocks", "want", "short", quota.alias("quota"))
    plan = running(plan, n_sources, ["sid"], "op10-quotas", begin=F.col("quota"))
    plan = plan.withColumn("end", F.col("begin") + F.col("quota"))
    shift = lambda r: F.pmod(F.xxhash64("seed", r, F.lit("shift")), F.col("n_blocks"))
    plan = plan.withColumn("shifts", F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), shift))
    plan = materialize(plan.withColumn("short_at", swap_or_not(F.col("n_blocks") - 1, back=True)), "op10-plan")
    total = int(plan.agg(F.max("end").alias("n")).first()["n"] or 0)

    # Every slot draws a place among all quotas: a multinomial for each shard. Quotas are looked up
    # by cell, an equal part of the places.
    cell = max(1, total // 4096)
    cells = plan.select(
        "sid", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / cell), F.floor((F.col("end") - 1) / cell))).alias("cell")
    )
    slots = src.sparkSession.range(total).select(
        F.col("id").alias("place"),
        F.floor(F.col("id") / shard_slots).alias("shard"),
        F.pmod(F.xxhash64("id", F.lit(seed), F.lit("slot")), F.lit(max(1, total))).alias("u"),
    )
    drawn = slots.withColumn("cell", F.floor(F.col("u") / cell)).join(small(cells), "cell").where("u >= begin and u < end")
    # Written, so that counts and slots come from one draw.
    drawn = materialize(drawn.select("shard", "place", "sid"), "op10-draws")
    per_shard = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))

    # A source's slots are numbered along the shards and in them by place.
    # Summed in two levels, as a source has slots in all shards.
    per_shard = materialize(per_shard.withColumn("g", F.floor(F.col("shard") / SHARD_GROUP)), "op10-drawn")
    earlier = Window.partitionBy("sid").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = per_shard.groupBy("sid", "g").agg(F.sum("n").alias("n"))
    groups = groups.select("sid", "g", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = per_shard.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(groups, ["sid", "g"])
    per_shard = materialize(per_shard.select("shard", "sid", (F.col("start") + F.col("base")).alias("start"), "n"), "op10-starts")
    rank = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("place")) - 1
    numbers = drawn.withColumn("r", rank).join(per_shard, ["shard", "sid"])
    numbers = numbers.select("shard", "place", "sid", (F.col("start") + F.col("r")).alias("k"))

    # Slots drawn beyond a source's quota are dealt to the sources that are short, one for one, so that
    # each ends with its quota: numbers 0 to quota - 1.
    firsts = per_shard
    drawn_n = per_shard.groupBy("sid").agg(F.sum("n").alias("drawn"))
    lack = plan.join(drawn_n, "sid", "left").select("sid", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    over, short = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    lack = running(lack, n_sources, ["sid"], "op10-lack", over_base=over, short_base=short)
    numbers = materialize(numbers.join(small(lack), "sid"), "op10-numbers")
    spare = numbers.where("k >= quota").select("shard", "place", (F.col("over_base") + F.col("k") - F.col("quota")).alias("j"))
    extra = lack.where("drawn < quota").select("sid", "drawn", "short_base", F.explode(F.sequence(F.col("drawn"), F.col("quota") - 1)).alias("k"))
    extra = extra.select("sid", "k", (F.col("short_base") + F.col("k") - F.col("drawn")).alias("j")).join(spare, "j")
    columns = ["shard", "place", "sid", "k"]
    k = numbers.where("k < quota").select(columns).union(extra.select(columns)).join(small(plan), "sid")

    k = k.withColumn("turn", F.floor(F.col("k") / F.col("n_blocks"))).withColumn("i", F.pmod("k", "n_blocks"))
    k = k.withColumn("b", swap_or_not(F.col("i")))
    # Written, so that what follows uses the places and doesn't work them out again for each use.
    slots = k.select("shard", "place", "sid", "k", "turn", F.col("i") > F.col("short_at"), F.col("b") == F.col("n_blocks") - 1, "b", "want", "short")
    k = table = materialize(slots.toDF("shard", "place", "sid", "k", "turn", "passed", "last", "b", "want", "short"), "op10-slots")
    discard(drawn, numbers, firsts)
    short_gone = F.col("turn") + F.col("passed").cast("int")
    start = F.col("k") * block - short_gone * F.col("short")
    length = F.when(F.col("last"), block - F.col("short")).otherwise(F.lit(block))
    k = k.withColumn("length", length).withColumn("use", F.least(F.col("want") - start, F.col("length"))).where("use > 0")
    return k.select("shard", "place", "sid", "b", "length", "use"), [table]
