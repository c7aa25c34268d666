"""Periodic runs of words: stretches that repeat a block of q words three times or more.

Seed and extend on diagonals. A run of smallest period q and length ``max(24, 3 q)`` or more has at
least 16 consecutive words that equal those q words on, and for q > P at least ``2 P``. So periods are
taken in classes: 1 to 8 and 9 to 16 with 16-grams, then P + 1 to 2 P with 2 P-grams for P = 16, 32, ...
The k-grams of a document are indexed by hash, longer ones made of two halves, and a position is
paired with the next place of its gram if that is as far as a period of the class. The next place is
enough: in a run some gram has no period of P or less (else the run had one too), the places of such a
gram are over P apart, and so the one a period on is the next. That makes at most one seed for a word
and class, even where a document is one word over and over.

Seeds go by lag, then place. A table of how far each lag is covered passes over seeds inside a stretch
that is known; any other is extended both ways over equal words. A stretch whose length with the lag
is enough is a run, unless the same stretch is a run with a shorter period already.

Documents never meet, so nothing is shuffled: a document is a row, and its words are indexed in the
task that reads it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words that a run of any period repeats at least: 24 - 8 for a period of 8, more for others.
SEED = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _extent(w: np.ndarray, i: int, lag: int, least: int) -> tuple[int, int]:
    """The largest ``[a, b)`` with ``i`` in it where each word equals that ``lag`` on; words before
    ``least`` are known to belong to other stretches of this lag."""
    a, step = i, 64
    while a > least:
        n = min(step, a - least)
        differ = np.flatnonzero(w[a - n : a] != w[a - n + lag : a + lag])
        if len(differ):
            a += int(differ[-1]) + 1 - n
            break
        a, step = a - n, step * 2
    b, step, end = i, 64, len(w) - lag
    while b < end:
        n = min(step, end - b)
        differ = np.flatnonzero(w[b : b + n] != w[b + lag : b + lag + n])
        if len(differ):
            b += int(differ[0])
            break
        b, step = b + n, step * 2
    return a, b


def _seeds(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``at`` with a later place of the same gram, how far the next is, and all places of grams
    that occur again; ``grams`` has the grams' hashes at ``at``, which ascends."""
    order = np.argsort(grams, kind="stable")
    g, p = grams[order], at[order]
    same = g[1:] == g[:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return p[:-1][same], (p[1:] - p[:-1])[same], at[again]


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run in an array of word numbers, by start, then period."""
    n = len(w)
    if n < LEAST_WORDS:
        return []
    h, size = _mixed(w.astype(np.uint64) + np.uint64(1)), 1
    found: dict[tuple[int, int], int] = {}
    at = np.arange(n - SEED + 1)
    covered: dict[int, int] = {}
    low, high = 0, SEED
    while low * LEAST_TIMES < n and len(at):
        gram = max(SEED, low * 2)
        while size < gram:
            h, size = _mixed(h[:-size] * np.uint64(3) + _mixed(h[size:])), size * 2
        at = at[at < len(h)]
        places, lags, at = _seeds(h[at], at)
        fits = (lags > low) & (lags <= high)
        places, lags = places[fits], lags[fits]
        by_lag = np.lexsort((places, lags))
        for lag, i in zip(lags[by_lag].tolist(), places[by_lag].tolist()):
            if i < covered.get(lag, 0):
                continue
            a, b = _extent(w, i, lag, covered.get(lag, 0))
            covered[lag] = b
            if b + lag - a >= max(LEAST_WORDS, LEAST_TIMES * lag):
                found.setdefault((a, b + lag), lag)
        low, high = high, high * 2
    return sorted((a, b - a, q) for (a, b), q in found.items())


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document of ten, by the CRC-32 of its id, repeats a block from some word on; the others, and
    those without an id, are as they were."""
    h, n = (1, 0) if doc_id is None else (zlib.crc32(str(doc_id).encode()), len(words))
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def _described(words: list[bytes]) -> tuple:
    """Number of runs, the one of the greatest exponent (start, length, period, thousandths), digest of
    all runs, digest of the words that stay."""
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words)) if len(words) >= LEAST_WORDS else np.empty(0, np.int64)
    runs = runs_of(w)
    best = None
    for start, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (start, length, q)
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, q in runs:
            gone[start + q : start + length] = True
        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
    listed = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    kept = hashlib.sha256(b" ".join(words)).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), kept


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_runs, start, length, period, exponent_milli`` (of the run with the greatest
    length over period; ties: the smallest start, then period; all null without a run), ``runs_sha256``
    (of all runs as lines of start,length,period) and ``collapsed_sha256`` (of the words left once each
    run keeps its first period only, joined by one space). With ``plant`` documents are damaged first.

    Words are what stands between ASCII blanks, compared byte by byte. A run is a stretch with smallest
    period q of ``max(24, 3 q)`` words or more that no neighbouring word extends. Null and blank texts have
    no words and no run. Identical rows give identical rows; a missing doc_id stays missing and is never
    damaged. Other columns are ignored; no rows give no rows. Texts of any length are searched whole.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    types = (pa.int64(),) * 5 + (pa.string(),) * 2

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            texts = batch.column("text").cast(pa.binary())
            rows = []
            for doc_id, text in zip(ids, texts):
                words = (text.as_py() or b"").split()
                rows.append(_described(planted(words, doc_id.as_py()) if plant else words))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(
        of, f"doc_id {id_type}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    )
