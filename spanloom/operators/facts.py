"""Facts in outputs: phrases and patterns found in a whole corpus, matching by case, scores."""

from __future__ import annotations

import re
import uuid
import warnings
from collections import defaultdict
from collections.abc import Callable
from re import _constants as c

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NARROW_BLANK, narrow_blanks

#: A list of hashes and numbers of up to so many bytes is broadcast.
BROADCAST_BYTES = 10_000_000
#: Trigrams are told apart by so many bits when those that no pattern asks for are sorted out.
SIEVE_BITS = 16
#: So many sets of literals at most are looked up in the tasks that read the texts.
IN_TASKS = 50_000
#: Alternatives of a literal are spelled out up to so many, and texts are looked at in pieces of so many bytes.
SPELLED, PIECE = 64, 1 << 22
#: Patterns that no text can be spared go to the texts in blocks of so many.
BLOCK = 64


def tokens(text: Column) -> Column:
    """Lower-cased words of a text, between blanks."""
    return F.array_remove(F.split(narrow_blanks(F.lower(text)), NARROW_BLANK + "+"), "")


def quoting(outputs: DataFrame, phrases: DataFrame, k: int = 5, write: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """``(output_id, phrase_id)`` for each output whose words hold all words of a phrase in a row.

    ``outputs(output_id, text)``, ``phrases(phrase_id, words)``. A phrase is found by its rarest ``k`` words in
    a row, counted over all phrases. Only hashes and numbers of places meet; where they do, the words of the output
    and of the phrase are fetched and compared. So neither side is looked at pair by pair. Phrases of fewer than
    ``k`` words are found by what they have; empty ones by nothing. ``write`` keeps what is used several times.
    """
    p = phrases.where(F.size("words") > 0).select("phrase_id", "words", F.least(F.size("words"), F.lit(k)).alias("n"))
    at = p.select("phrase_id", "n", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("o"))
    at = at.select("phrase_id", "n", "o", F.slice("words", F.col("o") + 1, F.col("n")).alias("gram"))
    often = at.groupBy("gram").agg(F.count("*").alias("df"))
    first = at.join(often, "gram").groupBy("phrase_id").agg(F.min_by(F.struct("n", "o", F.xxhash64("gram").alias("h")), F.struct("df", "gram", "o")).alias("x"))
    first = write(first.select("phrase_id", "x.*"))
    counts = {r.n: r["count"] for r in first.groupBy("n").count().collect()}
    w = outputs.select("output_id", tokens(F.col("text")).alias("w"))
    hits = None
    for n in sorted(counts):
        gram = F.xxhash64(*[F.get("w", F.col("p") + j) for j in range(n)])
        places = w.where(F.size("w") >= n).select("output_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("p"))
        places = places.select("output_id", "p", gram.alias("h"))
        own = first.where(F.col("n") == n).select("h", "o", "phrase_id")
        # Few phrases go to the texts; of many, both sides are shuffled. The texts' places never are the small side.
        own = F.broadcast(own) if 32 * counts[n] <= BROADCAST_BYTES else own.hint("merge")
        met = places.join(own, "h").select("output_id", "phrase_id", (F.col("p") - F.col("o")).alias("begin")).where("begin >= 0")
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        return outputs.select("output_id").limit(0).join(phrases.select("phrase_id").limit(0), F.lit(True))
    # The output's words, the long side, are joined last: they are shuffled once for each output.
    met = hits.join(phrases.select("phrase_id", "words"), "phrase_id").join(w, "output_id")
    return met.where(F.slice("w", F.col("begin") + 1, F.size("words")) == F.col("words")).select("output_id", "phrase_id").distinct()


def needed_literals(pattern: str | None) -> list[str] | None:
    """Literals of three characters or more of which any text that the pattern matches, in any case, has one; null if
    that can't be told. The best such set of a sequence will do; alternatives need one each."""
    from re import _constants as c
    from re import _parser as parser

    def of(items) -> list[str] | None:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is c.LITERAL:
                run += chr(arg)
                continue
            if len(run) >= 3:
                found.append([run])
            run = ""
            if op is c.SUBPATTERN:
                found.append(of(arg[3]))
            elif op is c.ATOMIC_GROUP:
                found.append(of(arg))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] > 0:
                found.append(of(arg[2]))
            elif op is c.BRANCH:
                each = [of(x) for x in arg[1]]
                found.append(None if None in each else [x for e in each for x in e])
        return max((f for f in found if f), key=lambda f: (min(map(len, f)), -len(f)), default=None)

    if pattern is None or r"\Q" in pattern or "&&" in pattern:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # what Python may read otherwise than Java
            tree = parser.parse(pattern)
    except Exception:  # not a pattern to Python: every text is tried
        return None
    return None if tree.state.flags & 64 else of(tree)  # with (?x) blanks are none


def _parsed(pattern: str | None):
    """What Python reads in a Java pattern; nothing where the two may differ."""
    from re import _parser as parser

    if pattern is None or r"\Q" in pattern or "&&" in pattern:
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # what Python may read otherwise than Java
            # Java writes a character by its number in braces.
            tree = parser.parse(re.sub(r"(?<!\\)((?:\\\\)*)\\x\{([0-9a-fA-F]{1,6})\}", lambda m: f"{m[1]}\\U{int(m[2], 16):08x}", pattern))
    except Exception:  # not a pattern to Python: every text is tried
        return []
    return [] if tree.state.flags & 64 else tree  # with (?x) blanks are none


def _spelled(op, arg) -> list[str] | None:
    """All that an item of a pattern can be, if that is little; of a repetition, nothing."""
    if op is c.LITERAL:
        return [chr(arg)]
    if op is c.IN and all(k in (c.LITERAL, c.RANGE) for k, _ in arg):
        ranges = [(x, x) if k is c.LITERAL else x for k, x in arg]
        return [chr(i) for x, y in ranges for i in range(x, y + 1)] if sum(y - x + 1 for x, y in ranges) <= SPELLED else None
    if op is c.SUBPATTERN and not arg[1] and not arg[2]:
        return _word(arg[3])
    if op is c.BRANCH:
        each = [_word(x) for x in arg[1]]
        return None if None in each or sum(map(len, each)) > SPELLED else [x for e in each for x in e]
    return None


def _word(items) -> list[str] | None:
    out = [""]
    for op, arg in items:
        x = _spelled(op, arg)
        if x is None or len(x) * len(out) > SPELLED:
            return None
        out = [a + b for a in out for b in x]
    return out


def needed_sets(pattern: str | None) -> list[list[str]]:
    """Sets of literals: a text that the pattern matches, in any case, has one of each. Small classes of characters and
    alternatives are spelled out beside what stands next to them; none if nothing can be told."""

    def best(items) -> list[str] | None:
        return max(of(items), key=lambda f: (min(map(len, f)), -len(f)), default=None)

    def of(items) -> list[list[str]]:
        found, run = [], [""]

        def end(begin):
            nonlocal run
            if all(len(x) >= 3 for x in run):
                found.append(list(dict.fromkeys(run)))
            run = begin

        for op, arg in items:
            again = op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT)
            x = _spelled(*arg[2][0]) if again and arg[0] > 0 and len(arg[2]) == 1 else None if again else _spelled(op, arg)
            if x is not None:
                if len(x) * len(run) > SPELLED:
                    end([""])
                run = [a + b for a in run for b in x]
                if again:  # the first of the repetition goes with what was before, the last with what comes
                    end(x)
                continue
            end([""])
            if op is c.SUBPATTERN:
                found += of(arg[3]) if not arg[1] and not arg[2] else []
            elif op is c.ATOMIC_GROUP:
                found += of(arg)
            elif again and arg[0] > 0:
                found += of(arg[2])
            elif op is c.BRANCH:
                each = [best(y) for y in arg[1]]
                found += [] if None in each else [[y for e in each for y in e]]
        end([""])
        return found

    return of(_parsed(pattern))


def shape(pattern: str | None) -> list[list[tuple[list[str] | None, int, int | None]]]:
    """What a match holds, without regard to what else the pattern asks: stretches of items that follow each other, each one of
    some strings or, if null, any character, so many times at least and at most."""
    out = [[]]

    def walk(items) -> None:
        for op, arg in items:
            lo, hi = 1, 1
            if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and len(arg[2]) == 1:
                lo, hi, (op, arg) = arg[0], None if arg[1] is c.MAXREPEAT else arg[1], arg[2][0]
            x = _spelled(op, arg)
            if x is not None or op in (c.IN, c.ANY, c.NOT_LITERAL, c.CATEGORY) and hi is not None and hi <= SPELLED:
                out[-1].append((x, lo, hi))
            elif (lo, hi) == (1, 1) and op is c.SUBPATTERN and not arg[1] and not arg[2]:
                walk(arg[3])
            elif op is not c.AT or (lo, hi) != (1, 1):
                out.append([])

    walk(_parsed(pattern))
    return [x for x in out if any(y for y, lo, _ in x if lo)]


def _literals(canonical: str, pattern: str, several: str) -> Column:
    """For each condition, the sets of literals of which a text needs one each, if any can be told."""

    def of(canonical, pattern, several):
        if several is not None and len(several):
            return [x for p in several for x in needed_sets(p)] or None
        if pattern is not None:
            return needed_sets(pattern) or None
        return [[canonical]] if canonical and len(canonical) >= 3 else None

    def each(canonical: pd.Series, pattern: pd.Series, several: pd.Series) -> pd.Series:
        return pd.Series([of(*x) for x in zip(canonical, pattern, several)], dtype=object)

    return F.pandas_udf(each, "array<array<string>>")(canonical, pattern, several)


def _shapes(canonical: str, pattern: str, several: str) -> Column:
    """For each condition the stretches of its shapes: a row for each string of an item, which has none if it is any character."""

    def of(canonical, pattern, several):
        if several is not None and len(several):
            parts = [x for p in several for x in shape(p)]
        else:
            parts = shape(pattern) if pattern is not None else [[([canonical], 1, 1)]] if canonical else []
        return [{"part": k, "pos": i, "lo": lo, "hi": hi, "alt": a} for k, part in enumerate(parts) for i, (x, lo, hi) in enumerate(part) for a in (x if x is not None else [None])]

    def each(canonical: pd.Series, pattern: pd.Series, several: pd.Series) -> pd.Series:
        return pd.Series([of(*x) for x in zip(canonical, pattern, several)], dtype=object)

    return F.pandas_udf(each, "array<struct<part:int,pos:int,lo:int,hi:int,alt:string>>")(canonical, pattern, several)


def folded(text: Column) -> Column:
    """The text so that what a pattern takes as equal without regard to case is equal here. Spark would take one change of
    case right after another for that one alone."""
    as_is = lambda x: F.concat(x, F.lit(""))
    return F.replace(F.lower(as_is(F.upper(as_is(F.lower(text))))), F.lit("ς"), F.lit("σ"))


def _stretches(rows: list) -> dict[int, list[bytes]]:
    """Patterns of bytes by condition, all of which are in a folded text that meets it. A character is twelve bytes at most."""
    parts: dict[tuple[int, int], dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for r in rows:
        parts[r.cond, r.part][r.pos].append(r)
    out = defaultdict(list)
    for (cond, _), items in sorted(parts.items()):
        pattern = b""
        for _, each in sorted(items.items()):
            r, some = each[0], b"|".join(re.escape(x.alt.encode()) for x in each if x.alt is not None)
            if r.alt is None:
                pattern += b"[\\x00-\\xff]{%d,%d}" % (r.lo, 12 * r.hi)
            else:
                pattern += some if len(each) == 1 and r.lo == r.hi == 1 else b"(?:%s)" % some + (b"" if r.lo == r.hi == 1 else b"{%d,%s}" % (r.lo, b"" if r.hi is None else b"%d" % r.hi))
        out[cond].append(pattern)
    return out


#: The last one built in this process, by name: its tables are large, so tasks get what it is built of.
_BUILT: dict[str, Callable[[pa.Array], pa.Array]] = {}


def _built(name: str, rows: list[tuple], stretches: dict[int, list[bytes]]) -> Callable[[pa.Array], pa.Array]:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = _spotter(rows, stretches)
    return _BUILT[name]


def _spotter(rows: list[tuple], stretches: dict[int, list[bytes]]) -> Callable[[pa.Array], pa.Array]:
    """A function that tells for each folded text which conditions it may meet: for ``rows`` of condition, set and a folded
    literal, those of which each set has a literal whose first bytes, eight at most, are in the text, and all stretches."""
    key = lambda x: int.from_bytes(x[:8].ljust(8, b"\0"), "little")
    sets = {x: k for k, x in enumerate(sorted({x[:2] for x in rows}))}
    conds = np.array([x[0] for x in sets])
    begins = np.flatnonzero(np.r_[True, conds[1:] != conds[:-1]])
    conds = conds[begins]
    first, of = np.zeros(1 << 24, np.uint8), [defaultdict(set) for _ in range(9)]
    for cond, s, literal in rows:
        literal = literal.encode()
        n = min(len(literal), 8)
        first[int.from_bytes(literal[:3], "little")] |= 1 << n - 3
        of[n][key(literal)].add(sets[cond, s])
    codes = [np.array(sorted(x), np.uint64) for x in of]
    to = [[np.array(sorted(x[int(k)])) for k in at] for x, at in zip(of, codes)]
    sizes = [np.array([len(y) for y in x], np.int64) for x in to]
    starts, flat = [np.cumsum(x) - x for x in sizes], [np.concatenate(x) if x else np.zeros(0, np.int64) for x in to]

    def piece(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For texts of ``data`` up to ``ends``, by text and condition, whether it may be met."""
        has = np.zeros((len(ends), len(sets)), bool)
        if len(data) >= 3:
            wide = data.astype(np.uint32)
            lengths = first[wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16]
            at = np.flatnonzero(lengths)
            lengths = lengths[at]
            eight = np.ndarray((len(data),), "<u8", np.r_[data, np.zeros(8, np.uint8)].tobytes(), strides=(1,))[at]
            text = np.searchsorted(ends, at, "right")
            room = ends[text] - at
            for n in range(3, 9):
                some = np.flatnonzero((lengths >> (n - 3) & 1).astype(bool) & (room >= n))
                if len(some):
                    code = eight[some] & np.uint64((1 << 8 * n) - 1)
                    k = np.minimum(np.searchsorted(codes[n], code), len(codes[n]) - 1)
                    same = codes[n][k] == code
                    pairs = np.unique(text[some[same]].astype(np.int64) * len(codes[n]) + k[same])
                    rows_, k = pairs // len(codes[n]), pairs % len(codes[n])
                    many = sizes[n][k]
                    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    has[np.repeat(rows_, many), flat[n][np.repeat(starts[n][k], many) + within]] = True
        return np.logical_and.reduceat(has, begins, axis=1)

    compiled: dict[int, list] = {}

    def holds(k: int, text: bytes) -> bool:
        if k not in compiled:
            compiled[k] = [re.compile(x) for x in stretches.get(int(conds[k]), [])]
        return all(x.search(text) for x in compiled[k])

    def spot(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        counts, found, i = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
            rows_, k = np.nonzero(piece(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]))
            each = {r: data[offsets[i + r] : offsets[i + r + 1]].tobytes() for r in np.unique(rows_)}
            kept = np.array([holds(x, each[r]) for r, x in zip(rows_, k)], bool)
            rows_, k = rows_[kept], k[kept]
            counts[i:j] = np.bincount(rows_, minlength=j - i)
            found.append(conds[k])
            i = j
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(np.concatenate(found).astype(np.int64)))

    return spot


def _trigrams_of(text: Column) -> Column:
    """Hashes of the trigrams of a text, each once."""
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - 3, F.lit(0)))
    hashes = F.transform(F.array(chars), lambda c: F.transform(at, lambda i: F.xxhash64(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
    return F.when(F.length(text) >= 3, F.array_distinct(F.get(hashes, F.lit(0))))


def _found(text: Column) -> Column:
    """Whether the fact of the row is in ``text``: all of its patterns, or its one, or its canonical words."""
    every = F.forall("required_patterns", lambda p: F.rlike(text, F.concat(F.lit("(?iuU)"), p)))
    one = F.rlike(text, F.concat(F.lit("(?iuU)"), F.col("pattern")))
    plain = F.contains(F.lower(text), F.lower("canonical"))
    return F.coalesce(F.when(F.size("required_patterns") > 0, every).when(F.col("pattern").isNotNull(), one).otherwise(plain), F.lit(False))


def search(outputs: DataFrame, facts: DataFrame, write: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """``(output_id, fact_id)`` for each fact found in any output, whichever case either belongs to.

    ``outputs(output_id, text)``; ``facts(fact_id, canonical, pattern, required_patterns)`` as in ``match_facts``. Facts that ask
    the same are one condition, which is tried once. A condition is tried on texts that have what it needs: of each of its sets
    of literals one. These are looked up in the texts where they are read, so no text is shuffled; what is sent there are the
    literals, if they are few. Conditions beyond that wait at one trigram of each literal of one set, that which fewest share,
    and texts meet them there, through their own trigrams, of which a sieve of 8 KB has sorted out what nothing waits for.
    Conditions of which no literal is known are tried on every text, in blocks.
    """
    ask = ["canonical", "pattern", "required_patterns"]
    f = facts.select("fact_id", *ask)
    asked = write(f.select(*ask).distinct().withColumn("sets", _literals(*ask)).withColumn("cond", F.monotonically_increasing_id()))
    own = f.alias("f").join(asked.alias("c"), [F.col(f"f.{x}").eqNullSafe(F.col(f"c.{x}")) for x in ask]).select("fact_id", "cond")
    own = write(own)
    few = lambda x, n, size: F.broadcast(x) if size * n <= BROADCAST_BYTES else x
    at = asked.where("sets is not null").select("cond", F.posexplode("sets").alias("s", "literals")).select("cond", "s", F.explode("literals").alias("literal"))
    at = write(at.select("cond", "s", "literal", folded(F.col("literal")).alias("low")))
    texts = outputs.select("output_id", "text")
    strict, met = asked.where("sets is not null").select("cond", *ask), None
    if not at.isEmpty():
        if at.count() <= IN_TASKS:
            parts = strict.select("cond", F.inline(_shapes(*ask))).withColumn("alt", folded(F.col("alt"))).distinct()
            name, rows, stretches = uuid.uuid4().hex, [tuple(r) for r in at.select("cond", "s", "low").distinct().collect()], dict(_stretches(parts.collect()))
            spot = F.arrow_udf(lambda x: _built(name, rows, stretches)(x), "array<bigint>")
            # Of explode, Spark would ask once more beforehand whether there is anything.
            met = texts.where("text is not null").withColumn("conds", spot(folded(F.col("text")))).select("output_id", "text", F.explode_outer("conds").alias("cond"))
            met = met.join(F.broadcast(strict), "cond")
        else:
            met = _meeting(texts, at, write).withColumnRenamed("output_id", "of").join(texts, F.col("of").eqNullSafe(F.col("output_id"))).join(strict, "cond")
        met = met.where(_found(F.col("text"))).select("output_id", "cond")
    loose = asked.where("sets is null").select("cond", *ask)
    n = loose.count()
    if n:
        blocks = loose.groupBy(F.pmod(F.xxhash64("cond"), F.lit(-(-n // BLOCK))).alias("block")).agg(F.collect_list(F.struct("cond", *ask)).alias("conds"))
        tried = texts.join(blocks, F.lit(True)).select("output_id", "text", F.inline("conds")).where(_found(F.col("text"))).select("output_id", "cond")
        met = tried if met is None else met.union(tried)
    if met is None:
        return texts.select("output_id").limit(0).join(f.select("fact_id").limit(0), F.lit(True))
    return met.join(few(own, own.count(), 32), "cond").select("output_id", "fact_id")


def _meeting(texts: DataFrame, at: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``output_id, cond`` where a text has a trigram of one set of the condition's literals, for any number of conditions."""
    at = at.withColumn("l", F.xxhash64("literal")).select("cond", "s", "l", F.explode(_trigrams_of(folded(F.col("literal")))).alias("h"))
    often = at.groupBy("h").agg(F.countDistinct("cond").alias("df"))
    # Of each literal its rarest trigram, of each condition the set whose literals are rarest.
    one = at.join(often, "h").groupBy("cond", "s", "l").agg(F.min(F.struct("df", "h")).alias("x"))
    sets = one.groupBy("cond", "s").agg(F.sum("x.df").alias("df"), F.collect_set("x.h").alias("hs")).groupBy("cond").agg(F.min_by("hs", F.struct("df", "s")).alias("hs"))
    waits = write(sets.select("cond", F.explode("hs").alias("h")))
    bit = lambda h: F.pmod(h, F.lit(1 << SIEVE_BITS))
    word = lambda h: (bit(h) / 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit(F.col("h")), F.lit(64)).cast("int"))
    sieve = [0] * (1 << SIEVE_BITS >> 6)
    for r in waits.select(word(F.col("h")).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        sieve[r.w] = r.b
    words = F.array(*[F.lit(x).cast("long") for x in sieve])
    wanted = F.filter("hs", lambda h: F.call_function("shiftrightunsigned", F.get(words, word(h)), F.pmod(bit(h), F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    mine = texts.where("text is not null").select("output_id", _trigrams_of(folded(F.col("text"))).alias("hs"))
    return mine.select("output_id", F.explode(wanted).alias("h")).join(waits, "h").select("output_id", "cond").distinct()


def match_facts(outputs: DataFrame, facts: DataFrame) -> DataFrame:
    """Every fact of a case against every output of it, with ``matched``.

    A fact has a ``canonical`` text, found without regard to case, or a ``pattern``, or several
    ``required_patterns`` that must all be found; columns that ``facts`` lacks count as absent.
    Case is folded for all alphabets, and ``\\s`` takes any blank.
    """
    j = outputs.join(facts, "case_id")
    has = facts.columns.__contains__
    text = F.col("text")
    found = F.contains(F.lower(text), F.lower("canonical"))
    if has("pattern"):
        found = F.when(F.col("pattern").isNotNull(), F.rlike(text, F.concat(F.lit("(?iuU)"), F.col("pattern")))).otherwise(found)
    if has("required_patterns"):
        every = F.forall("required_patterns", lambda p: F.rlike(text, F.concat(F.lit("(?iuU)"), p)))
        found = F.when(F.size("required_patterns") > 0, every).otherwise(found)
    return j.withColumn("matched", F.coalesce(found, F.lit(False)))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.sum(part) / F.nullif(F.sum(whole), F.lit(0)), F.lit(0.0))


def both_scores() -> dict[str, Column]:
    """The factual and the per-fact score as aggregates, for one pass over matches."""
    w, p, m = F.col("weight"), F.col("present"), F.col("matched")
    return {
        "factual": _ratio(F.when(p & m, w).otherwise(0), F.when(p, w).otherwise(0)),
        "per_fact": _ratio(F.when(m == p, w).otherwise(0), w),
    }


def factual_score(matches: DataFrame, by: list[str]) -> DataFrame:
    """Weight of the facts found among those that should be present; 0 without any weight."""
    return matches.groupBy(*by).agg(both_scores()["factual"].alias("score"))


def per_fact_score(matches: DataFrame, by: list[str]) -> DataFrame:
    """Weight of all facts that are as they should be, present or absent."""
    return matches.groupBy(*by).agg(both_scores()["per_fact"].alias("score"))
