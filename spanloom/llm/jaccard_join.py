"""Jaccard self-join of documents on word n-grams, with Bayesian pruning of candidates.

Documents with the same set of n-grams are one text from the start. Each text has a MinHash
signature; texts that agree on all values of a band meet in a bucket, and a pair is looked at only
in the first bucket it shares. There the signatures are compared a few values at a time: after m
agreements in n, with all similarities alike beforehand, the chance that the true one reaches the
threshold t is that of at most m successes in n + 1 draws of t, and the pair is dropped once that
falls below ``tolerance``. Pairs that come through are verified exactly on the n-grams of the whole
texts. The bands are chosen so that a pair at the threshold shares none with a chance of 3 in a
million.

A bucket of any size is cut into blocks and each pair of blocks is a group of its own, so no task
holds more than two blocks. Pairs never become rows: a group gives each text its number of links
and one edge to a text it is connected with, which is enough for the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import UPPER, WORD, connected_components, join_same, materialize, text_key

BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
STEP = 16
_WORD = regex.compile(WORD)
_LOWER = str.maketrans(UPPER, UPPER.lower())
_RNG = np.random.default_rng(96)
_XOR = _RNG.integers(0, 2**32, SIZE, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, SIZE, dtype=np.uint32) | np.uint32(1)
_WEIGHTS = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sorted distinct hashes of a text's word n-grams; keeps the hashes of words it has seen."""

    def __init__(self, n: int):
        self.n, self.seen = n, {}

    def of(self, text: str | None) -> np.ndarray:
        """A text of fewer than n words, but not none, has one n-gram of them all."""
        found = _WORD.findall((text or "").translate(_LOWER))
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
    """MinHash values, cut to 16 bits each."""
    h = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIZE, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        for j in range(0, SIZE, STEP):
            v = (part[None, :] ^ _XOR[j : j + STEP, None]) * _MUL[j : j + STEP, None]
            np.minimum(out[j : j + STEP], v.min(axis=1), out=out[j : j + STEP])
    # The least values are near 0: mix before cutting.
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(16)).astype(np.uint16)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For each number n of values compared, the least agreements with which a pair goes on."""
    out = np.zeros(SIZE + 1, np.int64)
    for n in range(1, SIZE + 1):
        chance, m = 0.0, -1
        while chance < tolerance and m < n:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def candidate_pairs(sig: np.ndarray, band: int, side: np.ndarray, cross: bool, least: np.ndarray):
    """Yields (i, js): for each row the later rows, in the other block if ``cross``, that share no
    earlier band with it and come through the pruning."""
    bands = sig.view(np.uint64)
    for i in range(len(sig) - 1):
        js = np.arange(i + 1, len(sig))
        if cross:
            js = js[side[js] != side[i]]
        same = bands[js, : band + 1] == bands[i, : band + 1]
        js = js[same[:, band] & ~same[:, :band].any(axis=1)]
        hits = np.zeros(len(js), np.int64)
        for at in range(0, SIZE, STEP):
            if not len(js):
                break
            hits += (sig[js, at : at + STEP] == sig[i, at : at + STEP]).sum(axis=1)
            go = hits >= least[at + STEP]
            js, hits = js[go], hits[go]
        if len(js):
            yield i, js


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Frames of the rows with one ``g``, from batches sorted by it."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        pdf = batch.to_pandas()
        g = pdf["g"].to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1]["g"].iloc[-1] != g[a]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _sigs(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), SIZE)


def _overlaps(sets: list[np.ndarray], i: int, js: np.ndarray) -> np.ndarray:
    return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in js])


class Bitmaps:
    """Which n-grams, of those that several texts of a group have, each text has."""

    def __init__(self, sets: list[np.ndarray]):
        every, counts = np.unique(np.concatenate(sets), return_counts=True)
        common = every[counts > 1]
        self.rows = np.zeros((len(sets), -(-len(common) // 64)), np.uint64)
        for row, s in zip(self.rows, sets):
            at = np.flatnonzero(np.isin(common, s, assume_unique=True))
            np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

    def overlaps(self, i: int, js: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.rows[js] & self.rows[i]).sum(axis=1, dtype=np.int64)


def _prune(batches, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each group, the texts that are in a pair that comes through."""
    for pdf in _groups(batches):
        band, cross = int(pdf["band"].iloc[0]), bool(pdf["crossed"].iloc[0])
        keep = np.zeros(len(pdf), bool)
        for i, js in candidate_pairs(_sigs(pdf), band, pdf["side"].to_numpy(), cross, least):
            keep[i] = True
            keep[js] = True
        if keep.any():
            out = pdf.loc[keep, ["g", "node", "band", "side", "crossed"]]
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)


def _verify(batches, least: np.ndarray, n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each group, for texts with verified links: how many, and a text of the same cluster."""
    shingler = Shingler(n)
    for pdf in _groups(batches):
        pdf = pdf.drop_duplicates("node")
        band, cross = int(pdf["band"].iloc[0]), bool(pdf["crossed"].iloc[0])
        sets = [shingler.of(t) for t in pdf["text"]]
        size = np.array([len(s) for s in sets])
        bits = Bitmaps(sets) if len(sets) > 16 else None
        links, parent = np.zeros(len(sets), np.int64), np.arange(len(sets))

        def root(i: int, parent=parent) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, js in candidate_pairs(_sigs(pdf), band, pdf["side"].to_numpy(), cross, least):
            both = bits.overlaps(i, js) if bits else _overlaps(sets, i, js)
            js = js[both >= threshold * (size[i] + size[js] - both) - 1e-9]
            links[i] += len(js)
            links[js] += 1
            for j in js:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        at = np.flatnonzero(links)
        if len(at):
            node = pdf["node"].to_numpy()
            out = {"node": node[at], "links": links[at], "peer": node[[root(i) for i in at]]}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})


def text_sets(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, tk, size`` (number of n-grams), ``s1, s2`` (hash of their set), ``sig, bytes``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            cols = {k: [] for k in ("size", "s1", "s2", "sig", "bytes")}
            for text in batch.column("text"):
                text = text.as_py()
                grams = shingler.of(text)
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                s1, s2 = np.frombuffer(digest, np.int64)
                for k, v in zip(cols, (len(grams), s1, s2, signature(grams).tobytes() if len(grams) else None, len(text or ""))):
                    cols[k].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(v, t) for v, t in zip(cols.values(), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), *arrays], ["doc_id", "tk", *cols])

    return d.mapInArrow(of, f"doc_id {id_type}, tk long, size long, s1 long, s2 long, sig binary, bytes long")


def similar_documents(
    docs: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-6,
    block_texts: int = 2048,
    block_bytes: int = 24_000_000,
    with_key: bool = False,
) -> DataFrame:
    """Per document: ``doc_id, class_id`` (smallest doc_id of its class: documents connected by
    Jaccard similarities of at least ``threshold``), ``n_links`` (different texts that reach it
    with this one) and ``n_copies`` (documents with the same n-grams, itself included). With
    ``with_key`` also ``tk`` (the key of its text) and ``first``: it is the one of its class with the
    smallest doc_id, of several rows with that id the one with the smallest key.

    Words are as in the shared word rule, A-Z lower-cased. A text of one to ``n - 1`` words is one
    n-gram; null and wordless texts are alone in their class, without links or copies. Identical
    rows are copies of each other and all come back. A missing doc_id comes after all others.
    Other columns are ignored; no rows give no rows.
    """
    every = materialize(text_sets(docs, n), "op6-sets")
    some = every.where("size > 0")
    texts = some.groupBy("s1", "s2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("one"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes")
    )
    texts = texts.select("s1", "s2", "one", "one.doc_id", "one.tk", "n_copies", "sig", "bytes", F.monotonically_increasing_id().alias("node"))
    texts = materialize(texts, "op6-texts")

    value = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (2 * ROWS) + 1, 2 * ROWS)))
    banded = texts.select("node", "bytes", value.alias("values")).select("node", "bytes", F.posexplode_outer("values").alias("band", "v"))
    buckets = banded.groupBy("band", "v").agg(
        F.count("*").alias("n"),
        F.sum("bytes").alias("held"),
        F.bit_xor(F.xxhash64("node")).alias("x1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"),
    )
    # Buckets with the same texts: the first band's will do.
    buckets = buckets.where("n > 1").groupBy("n", "held", "x1", "x2").agg(F.min(F.struct("band", "v")).alias("b"))
    blocks = F.ceil(F.greatest(F.col("n") / block_texts, F.col("held") / block_bytes)).cast("int")
    buckets = buckets.select("b.band", "b.v", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    members = banded.select("node", "band", "v").join(buckets, ["band", "v"]).withColumn("side", own)
    members = members.withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("band", "v", F.least("side", "other"), F.greatest("side", "other"))
    members = members.select("node", "band", "side", (F.col("side") != F.col("other")).alias("crossed"), pair.alias("g"))
    # A text alone in a block still meets the others of its bucket in the crossed groups.
    least = least_matches(threshold, tolerance)
    with_sig = members.join(texts.select("node", "sig"), "node")
    group_schema = "g long, node long, band int, side int, crossed boolean"
    pruned = with_sig.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: _prune(b, least), group_schema)
    pruned = materialize(pruned, "op6-candidates")
    with_text = join_same(
        pruned.join(texts.select("node", "sig", "doc_id", "tk"), "node"),
        docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text"),
        ["doc_id", "tk"],
        "inner",
    ).select("g", "node", "band", "side", "crossed", "sig", "text")
    found = with_text.repartition("g").sortWithinPartitions("g").mapInArrow(
        lambda b: _verify(b, least, n, threshold), "node long, links long, peer long"
    )
    found = materialize(found, "op6-links")

    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    members = connected_components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")).distinct())
    of_node = texts.select("s1", "s2", "node", "one", "n_copies").join(members, "node", "left").join(links, "node", "left")
    of_node = of_node.withColumn("component", F.coalesce("component", "node"))
    least_of = of_node.groupBy("component").agg(F.min("one").alias("least"))
    of_node = of_node.join(least_of, "component").select("s1", "s2", "least", "n_links", "n_copies")
    out = every.select("doc_id", "tk", "size", "s1", "s2").join(of_node, ["s1", "s2"], "left")
    alone = F.col("size") == 0
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tk") == F.col("least.tk"))
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, 1).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        *(["tk", (alone | first).alias("first")] if with_key else []),
    )
