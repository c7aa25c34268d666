"""Near copies of documents by min-max hashing.

A document is its set of distinct three-word shingles. Under each of ``PERMS`` permutations of the
shingles' hashes both ends are kept, the least value and the greatest: two values of the signature for
one pass over the hashes. Each agrees between two documents with the chance of their similarity, and
the two ends of a permutation agree together a little more seldom than two independent values would,
so the share of agreements is unbiased and spreads less than that of as many separate minima.

Bands hold four values of one end, each of another permutation, so a band agrees with a chance of
``J ** 4`` exactly, and a pair at ``J = 0.85`` shares none of the 20 with a chance of 4 in 10 million at
most. A pair is looked at in the first band that it shares; it is dropped there only if so few values
agree that the chance of this at the threshold is below ``tolerance``; what is left is compared on the
full sets.

What is wanted is which documents hang together, not each link, so a pair that hangs together already
is passed over. A large bucket is cut into blocks. First each block is searched by itself, with one text
of the bucket put into all of its blocks; that joins the blocks of a real cluster. Only buckets that
still hold several components are searched across blocks, and there only texts outside the bucket's
largest component travel to all blocks. After that every pair of texts in a bucket has been compared or
is known to hang together, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, discard, join_same, materialize, text_key

PERMS, ROWS = 40, 4
VALUES = 2 * PERMS
BANDS = VALUES // ROWS
_RNG = np.random.default_rng(40)
_XOR = _RNG.integers(0, 2**32, PERMS, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, PERMS, dtype=np.uint32) | np.uint32(1)
_WEIGHTS = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """Sorted distinct hashes of the n-word shingles of a text in UTF-8; keeps hashes of words it has seen."""

    def __init__(self, n: int):
        self.n, self.seen = n, {}

    def of(self, text: bytes | None) -> np.ndarray:
        """A text of fewer than n words, but not none, has one shingle of them all."""
        found = (text or b"").lower().split()  # of bytes: A-Z, and ASCII blanks only
        if not found:
            return np.empty(0, np.uint64)
        if len(self.seen) > 400_000:
            self.seen.clear()
        seen = self.seen
        for w in set(found).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))
        n = min(self.n, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out += h[j : j + len(out)] * _WEIGHTS[j]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    """The least and the greatest value under each permutation, cut to 16 bits: first all the least."""
    h = (grams >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMS, 2**32 - 1, np.uint32), np.zeros(PERMS, np.uint32)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        for j in range(0, PERMS, 10):
            v = (part[None, :] ^ _XOR[j : j + 10, None]) * _MUL[j : j + 10, None]
            np.minimum(low[j : j + 10], v.min(axis=1), out=low[j : j + 10])
            np.maximum(high[j : j + 10], v.max(axis=1), out=high[j : j + 10])
    out = np.concatenate([low, high])
    # The ends are near 0 and near the top: mix before cutting.
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(16)).astype(np.uint16)


def least_agreements(threshold: float, tolerance: float) -> int:
    """The least number of agreeing values with which a pair goes on: fewer come at the threshold with a
    chance below ``tolerance``, by the binomial bound."""
    chance = 0.0
    for m in range(VALUES + 1):
        chance += math.comb(VALUES, m) * threshold**m * (1 - threshold) ** (VALUES - m)
        if chance >= tolerance:
            return m
    return VALUES


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Columns, as lists, of the rows with one ``g``, from batches sorted by it."""
    held: dict[str, list] | None = None
    for batch in batches:
        g = batch.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        cols = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held["g"][-1] != g[a]:
                yield held
                held = None
            if held:
                for name, c in cols.items():
                    held[name] += c[a:b]
            else:
                held = {name: c[a:b] for name, c in cols.items()}
    if held:
        yield held


class Group:
    """Texts of one block, or of two that are compared with each other, and which of them hang together."""

    def __init__(self, rows: dict[str, list], least: int):
        self.node = np.array(rows["node"])
        self.sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, VALUES)
        self.bands = self.sig.view(np.uint64)
        self.band, self.least = rows["band"][0], least
        self.side = np.array(rows["side"])
        self.crossed = rows["crossed"][0]
        self.label = np.unique(rows["comp"], return_inverse=True)[1]

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """(i, js): for each text the others that this group has to compare it with. Those that hang
        together by the time i comes are left out."""
        n = len(self.node)
        right = np.flatnonzero(self.side == 1) if self.crossed else None
        for i in np.flatnonzero(self.side == 0) if self.crossed else range(n - 1):
            js = right if self.crossed else np.arange(i + 1, n)
            js = js[self.label[js] != self.label[i]]
            if not len(js):
                continue
            same = self.bands[js, : self.band + 1] == self.bands[i, : self.band + 1]
            js = js[same[:, self.band] & ~same[:, : self.band].any(axis=1)]
            if len(js):
                js = js[(self.sig[js] == self.sig[i]).sum(axis=1) >= self.least]
            if len(js):
                yield int(i), js

    def join(self, i: int, js: np.ndarray) -> None:
        self.label[np.isin(self.label, self.label[js])] = self.label[i]


class Overlaps:
    """Sizes of intersections in a group: bits for the shingles that several of its texts have."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.rows = sets, None
        if len(sets) > 16:
            every, counts = np.unique(np.concatenate(sets), return_counts=True)
            common = every[counts > 1]
            self.rows = np.zeros((len(sets), -(-len(common) // 64)), np.uint64)
            for row, s in zip(self.rows, sets):
                at = np.flatnonzero(np.isin(common, s, assume_unique=True))
                np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

    def of(self, i: int, js: np.ndarray) -> np.ndarray:
        if self.rows is None:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in js])
        return np.bitwise_count(self.rows[js] & self.rows[i]).sum(axis=1, dtype=np.int64)


def _prune(batches, least: int) -> Iterator[pa.RecordBatch]:
    """Of each group, the texts of pairs that have to be compared on their sets."""
    names = ("g", "node", "band", "side", "crossed", "comp")
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
    out: list[list] = [[] for _ in names]

    def made() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], list(names))
        for c in out:
            c.clear()
        return b

    for rows in _grouped(batches):
        group = Group(rows, least)
        keep = np.zeros(len(group.node), bool)
        for i, js in group.candidates():
            keep[i] = True
            keep[js] = True
        for k in np.flatnonzero(keep).tolist():
            for c, name in zip(out, names):
                c.append(rows[name][k])
        if len(out[0]) > 5000:
            yield made()
    if out[0]:
        yield made()


def _verify(batches, least: int, n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of each group, links that hold on the full sets, as many as tell what hangs together."""
    shingles = Shingles(n)
    for rows in _grouped(batches):
        group = Group(rows, least)
        of_node: dict[int, np.ndarray] = {}
        for node, text in zip(rows["node"], rows["text"]):
            if node not in of_node:
                of_node[node] = shingles.of(text)
        sets = [of_node[x] for x in rows["node"]]
        size = np.array([len(s) for s in sets])
        overlaps = Overlaps(sets)
        a, b = [], []
        for i, js in group.candidates():
            both = overlaps.of(i, js)
            js = js[100 * both >= percent * (size[i] + size[js] - both)]
            if len(js):
                # One link to each component that joins.
                js = js[np.unique(group.label[js], return_index=True)[1]]
                a += [group.node[i]] * len(js)
                b += group.node[js].tolist()
                group.join(i, js)
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, tk, size`` (number of shingles), ``s1, s2`` (hash of their set), ``sig, bytes``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        types = {"size": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "sig": pa.binary(), "bytes": pa.int64()}
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in types}
            for text in batch.column("text").cast(pa.binary()):
                text = text.as_py()
                grams = shingles.of(text)
                s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)
                for k, v in zip(cols, (len(grams), s1, s2, signature(grams).tobytes() if len(grams) else None, len(text or b""))):
                    cols[k].append(v)
            arrays = [pa.array(v, types[k]) for k, v in cols.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), *arrays], ["doc_id", "tk", *cols])

    return d.mapInArrow(of, f"doc_id {id_type}, tk long, size long, s1 long, s2 long, sig binary, bytes long")


def _blocks(n, held, block_texts: int, block_bytes: int):
    return F.ceil(F.greatest(n / block_texts, held / block_bytes)).cast("int")


def near_copies(
    docs: DataFrame, n: int = 3, percent: int = 85, tolerance: float = 1e-9, block_texts: int = 2048, block_bytes: int = 24_000_000
) -> DataFrame:
    """Per document: ``doc_id, n_shingles`` (size of its set), ``component_id`` (the smallest doc_id of the
    documents it hangs together with, over links of ``100 * intersection >= percent * union``; itself
    included) and ``kept`` (its doc_id is that one).

    Words stand between ASCII blanks, A-Z lower-cased. A text of one to ``n - 1`` words is one shingle;
    null and blank texts have an empty set and are their own component. Identical rows are copies of
    each other, and come back with the same result. A missing doc_id comes after all others. Other
    columns are ignored; no rows give no rows.
    """
    every = materialize(shingle_sets(docs, n), "op12-sets")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("one")
    texts = every.where("size > 0").groupBy("s1", "s2").agg(one, F.first("sig").alias("sig"), F.first("bytes").alias("bytes"))
    texts = materialize(texts.select("s1", "s2", "one", "sig", "bytes", F.monotonically_increasing_id().alias("node")), "op12-texts")

    value = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (2 * ROWS) + 1, 2 * ROWS)))
    banded = texts.select("node", "bytes", F.posexplode(value).alias("band", "v"))
    buckets = banded.groupBy("band", "v").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("held"), F.min("node").alias("pivot"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")
    )
    # Of buckets with the same texts the first band's will do.
    buckets = buckets.where("n > 1").groupBy("n", "held", "pivot", "x1", "x2").agg(F.min(F.struct("band", "v")).alias("b"))
    buckets = buckets.select("b.band", "b.v", "pivot", _blocks(F.col("n"), F.col("held"), block_texts, block_bytes).alias("blocks"))
    members = materialize(banded.join(buckets, ["band", "v"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")), "op12-members")

    least = least_agreements(percent / 100, tolerance)
    keys = texts.select("node", "sig", "one.doc_id", "one.tk")
    plain = docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.col("text").cast("binary").alias("text"))

    def links(rows: DataFrame, name: str) -> DataFrame:
        """Links found in the groups ``g`` of ``rows``: ``node, band, side, crossed, comp, g``."""
        schema = "g long, node long, band int, side int, crossed boolean, comp long"
        candidates = rows.join(keys.select("node", "sig"), "node").repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: _prune(b, least), schema)
        candidates = materialize(candidates, f"op12-candidates-{name}")
        # A text that several rows repeat is fetched once.
        wanted = materialize(candidates.select("node").distinct().join(keys, "node"), f"op12-wanted-{name}")
        fetched = join_same(wanted, plain, ["doc_id", "tk"], "inner").groupBy("node", "sig").agg(F.first("text").alias("text"))
        found = candidates.join(fetched, "node").repartition("g").sortWithinPartitions("g")
        found = materialize(found.mapInArrow(lambda b: _verify(b, least, n, percent), "a long, b long"), f"op12-links-{name}")
        discard(candidates, wanted)
        return found

    at = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = members.select("node", "band", F.lit(0).alias("side"), F.lit(False).alias("crossed"), F.col("node").alias("comp"), "v", F.explode(at).alias("block"))
    found = links(first.withColumn("g", F.xxhash64("band", "v", "block")).drop("v", "block"), "within")

    large = members.where("blocks > 1")
    if not large.isEmpty():
        comps = materialize(connected_components(found), "op12-comps")
        large = materialize(large.join(comps.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "op12-large")
        counts = large.groupBy("band", "v", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("held"))
        counts = counts.groupBy("band", "v").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("held").alias("held"), F.max_by("held", F.struct("n", "comp")).alias("own"))
        counts = counts.where("comps > 1").select("band", "v", "main", _blocks(F.col("n") - F.col("most"), F.col("held") - F.col("own"), block_texts, block_bytes).alias("others"))
        open_ = large.join(counts, ["band", "v"])
        span = F.sequence(F.lit(0), F.col("others") - 1)
        stay = open_.withColumn("side", F.lit(0)).withColumn("other", F.explode(span))
        go = open_.where("comp <> main").withColumn("side", F.lit(1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        go = go.withColumn("other", F.pmod(F.xxhash64("node", F.lit(3)), F.col("others")).cast("int"))
        across = stay.unionByName(go).select("node", "band", "side", F.lit(True).alias("crossed"), "comp", F.xxhash64("band", "v", "block", "other").alias("g"))
        more = links(across, "across")
        both = materialize(found.union(more), "op12-links")
        discard(found, more, comps, large)
        found = both

    comps = connected_components(found)
    of_node = texts.select("s1", "s2", "node", "one").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_of = of_node.groupBy("component").agg(F.min("one").alias("least"))
    of_node = of_node.join(least_of, "component").select("s1", "s2", F.col("least.doc_id").alias("least"))
    out = every.select("doc_id", "size", "s1", "s2").join(of_node, ["s1", "s2"], "left")
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("least"))
    out = out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    discard(members)
    return out
