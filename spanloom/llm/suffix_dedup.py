"""Removal of long strings that repeat: a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``length`` bytes, the most significant digit first;
a group that shrinks to one suffix is settled and drops out, and groups that still hold several
after the last digit are exactly the repeated strings. Three things keep the passes small.

* Suffixes travel in runs. The digit that is looked at first is the ``gram`` bytes at the least
  hashed place of the string (its anchor), which equal strings share; consecutive suffixes mostly
  share it too, and make one row.
* The second digit is the run's whole reach. Runs that equal others in it repeat throughout, all
  their suffixes at once; they are settled without looking at any of them alone.
* Only runs that share the first digit but not the second, that is, around edits and ends of
  copies, are opened, one run for each distinct reach. They fall into pieces of ``PIECE`` suffixes at
  fixed offsets from the anchor, and the same two passes settle most pieces: by the bytes that all
  strings of a piece have, then by its reach. The suffixes of the few pieces that remain are
  ordered by all ``length`` bytes.
* Where a text goes on repeating itself with a short period, all suffixes but those of one period
  are settled on the spot: each equals the one a period before it.

Digits are compared as hashes. Those that decide, of reaches and whole strings, are 128-bit BLAKE2b
digests of the bytes themselves.

Groups are counted before they are shuffled, so a string that a third of the corpus shares is a
number by then, never a list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_same, materialize, text_key

#: Suffixes looked at in one go, which bounds memory for very long texts.
SEGMENT = 2_000_000
PIECE = 16
#: A stretch with a short period is settled on the spot from so many runs on.
PERIODS = 8
_TABLE = np.random.default_rng(400).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(17, n.bit_length())
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS


class Hasher:
    """Polynomial hashes of any stretches of one byte string. They deal suffixes out; they never decide
    that two strings are equal."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, self.down = _powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[:n], out=self.sums[1:])

    def of(self, start, end):
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digests of the bytes from each ``start`` to its ``end``."""
    view = memoryview(np.ascontiguousarray(data))
    made = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist()))
    both = np.frombuffer(made, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive elements, from running minima forward and back in blocks."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[w - 1 : w - 1 + n])


def _periodic(part: np.ndarray, lo, hi, place, digit, length: int):
    """Which runs can be left out, and the stretches (first and last suffix) that repeat within themselves.

    Neighbouring runs with one digit at one distance p, again and again, lie in a stretch with period
    p. All its suffixes but the first p equal earlier ones of it, and those have later ones.
    """
    out, stretches = np.zeros(len(lo), bool), []
    step = np.where(digit[1:] == digit[:-1], np.diff(place), 0)
    heads = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else step
    for a, b in zip(heads, np.r_[heads[1:], len(step)]):
        p = int(step[a])
        if p <= 0 or b - a < PERIODS:
            continue
        start, end = int(lo[a]), int(hi[b]) + length
        breaks = np.flatnonzero(part[start : end - p] != part[start + p : end])
        middle = (end - start - p) // 2
        first = start + int(breaks[breaks < middle].max(initial=-1)) + 1
        after = breaks[breaks >= middle]
        last = (start + int(after[0]) + p if len(after) else end) - length
        if last - first >= 2 * p:
            out |= (lo >= first + p) & (hi <= last)
            stretches.append((first, last))
    return out, stretches


def anchors(data: np.ndarray, length: int, gram: int):
    """Runs of suffixes with one anchor: arrays lo, hi (first and last suffix), place of the anchor,
    digit, both halves of the reach's digest, and whether the run is no run but a stretch that repeats
    within itself."""
    parts = []
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        i = np.arange(len(part) - gram + 1)
        g = Hasher(part).of(i, i + gram)
        # The leftmost of equal ones: the place breaks ties.
        key = (g & ~np.uint64((1 << 22) - 1)) | i.astype(np.uint64)
        place = (_sliding_min(key, length - gram + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        hi = np.r_[lo[1:] - 1, len(place) - 1]
        place = place[lo]
        digit = g[place]
        gone, stretches = _periodic(part, lo, hi, place, digit, length)
        lo, hi, place, digit = (x[~gone] for x in (lo, hi, place, digit))
        r1, r2 = digests(part, lo, hi + length)
        parts.append((lo + at, hi + at, place + at, digit, r1, r2, np.zeros(len(lo), bool)))
        if stretches:
            s, e = np.array(stretches).T
            none = np.zeros(len(s), np.int64)
            parts.append((s + at, e + at, none, none.astype(np.uint64), none, none, np.ones(len(s), bool)))
    return [np.concatenate(x) for x in zip(*parts)]


def _bytes_of(column: pa.Array, i: int) -> np.ndarray:
    buf = column[i].as_buffer()
    return np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)


def _rows(keys: pa.RecordBatch, index: list[int], counts: list[int], more: dict[str, np.ndarray]) -> pa.RecordBatch:
    take = pa.array(np.repeat(index, counts).astype(np.int64))
    names = ["doc_id", "tk", *more]
    cols = [keys.column("doc_id").take(take), keys.column("tk").take(take), *(pa.array(x) for x in more.values())]
    return pa.RecordBatch.from_arrays(cols, names)


def _opened(batches: Iterator[pa.RecordBatch], length: int):
    """For each text of the batches and segment of it with opened runs: the batch, the text's index, where
    the segment starts, its bytes and the runs."""
    for batch in batches:
        text = batch.column("text")
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            data = _bytes_of(text, i)
            for at in range(0, len(data) - length + 1, SEGMENT):
                here = [r for r in runs if at <= r["lo"] < at + SEGMENT]
                if here:
                    part = data[at : at + SEGMENT + length - 1]
                    yield batch, i, at, part, here


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch, i, at, part, runs in _opened(batches, length):
        lo, hi, place, is_open = (np.array([r[k] for r in runs]) for k in ("lo", "hi", "place", "open"))
        first, last = (place - hi) // PIECE, (place - lo) // PIECE
        n = last - first + 1
        run = np.repeat(np.arange(len(runs)), n)
        piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
        start = place[run] - PIECE * piece  # of the string furthest to the right that the piece may have
        s = np.maximum(lo[run], start - (PIECE - 1))
        e = np.minimum(hi[run], start)
        core = Hasher(part).of(start - at, start - (PIECE - 1) + length - at) + piece.astype(np.uint64)
        more = {"lo": s.astype(np.int32), "hi": e.astype(np.int32), "place": np.zeros(len(s), np.int32), "open": is_open[run]}
        more["digit"] = core.view(np.int64)
        more["r1"], more["r2"] = digests(part, s - at, e + length - at)
        more["sure"] = np.zeros(len(s), bool)
        yield _rows(batch, [i], [len(s)], more)


def _suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch, i, at, part, runs in _opened(batches, length):
        s = np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in runs])
        is_open = np.concatenate([np.full(r["hi"] - r["lo"] + 1, r["open"]) for r in runs])
        more = {"s": s.astype(np.int32), "open": is_open}
        more["h0"], more["h1"] = digests(part, s - at, s - at + length)
        yield _rows(batch, [i], [len(s)], more)


KEY = ["doc_id", "tk"]


def _settle(runs: DataFrame, length: int, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Two digits for runs of suffixes. Returns the stretches of runs that repeat throughout, and by
    document the runs that need opening: in groups of one first digit with different reaches, one
    for each reach; ``open`` are those whose reach is unique, the others only show what repeats. Last come
    the tables that both read."""
    of_digit = runs.groupBy("digit").agg(
        F.count("*").alias("n"), F.max("open").alias("any"), F.min(F.struct("r1", "r2")).alias("a"), F.max(F.struct("r1", "r2")).alias("b")
    )
    # Counts are written before they are joined: a join of two plain shuffles splits a frequent digit.
    of_digit = materialize(of_digit.where("n > 1 and any").select("digit", (F.col("a") == F.col("b")).alias("alike")), "op3-digits")
    left = materialize(runs.join(of_digit, "digit"), name)
    stretch = [*KEY, F.col("lo").alias("s"), (F.col("hi") + length).alias("e")]
    mixed = left.where("not alike")
    of_reach = mixed.groupBy("digit", "r1", "r2").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "lo")).alias("one"))
    of_reach = materialize(of_reach, "op3-reaches")
    mixed = mixed.join(of_reach, ["digit", "r1", "r2"])
    whole = left.where("alike").select(*stretch).union(mixed.where("n > 1").select(*stretch))
    opened = mixed.where(F.struct(*KEY, "lo").eqNullSafe(F.col("one")))
    run = F.struct("lo", "hi", "place", (F.col("open") & (F.col("n") == 1)).alias("open"))
    discard(of_digit)
    return whole, opened.groupBy(*KEY).agg(F.collect_list(run).alias("runs")), [left, of_reach]


def repeated_stretches(docs: DataFrame, length: int = 400, gram: int = 64) -> DataFrame:
    """``(doc_id, tk, spans)``: for documents with repeated strings of ``length`` bytes, the
    stretches ``(s, e)`` that those cover, unmerged."""
    if not PIECE <= gram < length:
        raise ValueError("the first digit must be shorter than the strings, and not shorter than a piece")
    d = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text").where(F.octet_length("text") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(_bytes_of(batch.column("text"), i), length, gram) for i in range(batch.num_rows)]
            if found:
                lo, hi, place, digit, r1, r2, sure = (np.concatenate(x) for x in zip(*found))
                more = {"lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "place": place.astype(np.int32)}
                more["open"] = np.ones(len(lo), bool)
                more |= {"digit": digit.view(np.int64), "r1": r1, "r2": r2, "sure": sure}
                yield _rows(batch, list(range(batch.num_rows)), [len(x[0]) for x in found], more)

    own = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tk long"
    schema = f"{own}, lo int, hi int, place int, open boolean, digit long, r1 long, r2 long, sure boolean"
    runs = materialize(d.mapInArrow(find, schema), "op3-runs")
    sure = runs.where("sure").select(*KEY, F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    whole, opened, read = _settle(runs.where("not sure"), length, "op3-left")
    # Rows of one key are the same document here: one is enough.
    texts = whole_texts = materialize(join_same(d, opened, KEY, "inner").dropDuplicates(KEY), "op3-open-texts")
    pieces = materialize(texts.select(*KEY, "text", "runs").mapInArrow(lambda b: _pieces(b, length), schema), "op3-pieces")
    also, opened, read_pieces = _settle(pieces, length, "op3-left-pieces")
    texts = join_same(texts.select(*KEY, "text"), opened, KEY, "inner")
    single = materialize(
        texts.mapInArrow(lambda b: _suffixes(b, length), f"{own}, s int, open boolean, h0 long, h1 long"), "op3-suffixes"
    )
    twice = single.groupBy("h0", "h1").agg(F.count("*").alias("n")).where("n > 1").select("h0", "h1")
    twice = materialize(twice, "op3-twice")
    found = single.where("open").join(twice, ["h0", "h1"]).select(*KEY, "s", (F.col("s") + length).alias("e"))
    spans = sure.union(whole).union(also).union(found).groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = materialize(spans, "op3-spans")
    discard(runs, whole_texts, pieces, single, twice, *read, *read_pieces)
    return spans


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 64, with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept_sha256``
    and, if wanted, ``kept``: the bytes that stay.

    Texts are UTF-8 bytes, null being empty. A byte goes if it is in a string of ``length`` bytes
    that starts at another place too, of the same document or another; matches never cross
    documents and are judged on the input. Shorter texts stay whole. Identical rows count as two
    documents and remove each other; rows of one doc_id with different texts are told apart.
    Other columns are ignored; no rows give no rows.
    """
    d = docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    d = join_same(d, repeated_stretches(docs, length, gram), KEY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, removed, runs, kept = batch.column("text"), [], [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                data = _bytes_of(text, i)
                if spans:
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, [x["s"] for x in spans], 1)
                    np.add.at(edge, [x["e"] for x in spans], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    runs.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                    data = data[~gone]
                else:
                    removed.append(0)
                    runs.append(0)
                kept.append(data.tobytes())
            cols = [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text", "spans").mapInArrow(cut, schema)
