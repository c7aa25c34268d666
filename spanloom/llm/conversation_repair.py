"""Conversations repaired by their cheapest edits: a Viterbi search that forgets what is settled.

Rows of a conversation come by turn; the edits keep a row, give it another role, delete it, or insert one,
until the roles read ``(s?(ua)+)?``. The states of the search are the last role kept: none, system, user,
assistant. Each state has one survivor, the cheapest audit that ends in it, of equal costs the
ASCII-least. Audits of one cost over the same rows are never a prefix of each other: they have one letter
for each row besides inserts, so the longer one would end in inserts, which cost. So their first
difference decides for whatever follows.

Survivors are leaves of a tree of backpointers with reference counts: an edit that no survivor descends
from is freed at once, and as soon as all survivors descend from one edit, all up to it is settled: its
letter goes to the audit, its row to the digest, and it is cut off the tree. Ties compare the whole
suffixes above the root, however long. A task thus holds the rows on which survivors still disagree, not
the conversation.

A conversation's digest is one SHA-256 over its rows in order, so its rows pass through one task, one
after the other, sorted by Spark; nothing of them is gathered there. What a row has to know of far rows,
whether its role and text came before, is found beforehand by grouping with partial sums: the repeats come
as marks into the sorted stream, so that neither a set of seen texts nor a second shuffle of texts is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_same, materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_KEPT = 3
#: States: nothing kept, or the initial of the last role.
STATES = ("", "s", "u", "a")
#: From which states a role may follow.
BEFORE = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}
LEGAL = {"su", "ua", "au"}
ROLE = {"u": "user", "a": "assistant"}
_VISIBLE = r"[^\x20\x09-\x0D]"


class Edit:
    """An edit in the tree: its letter, the row that it leaves (or none), and how many edits and
    survivors point at it."""

    __slots__ = ("before", "letter", "row", "uses")

    def __init__(self, before: Edit | None, letter: str, row: tuple[str, str] | None):
        self.before, self.letter, self.row, self.uses = before, letter, row, 0
        if before:
            before.uses += 1


class Search:
    """One conversation: rows go in by ``row``, settled edits go to the audit and the digest."""

    def __init__(self):
        self.root = Edit(None, "", None)
        self.survivors: dict[str, tuple[int, Edit]] = {"": (0, self.root)}
        self.root.uses = 1
        self.letters: list[str] = []
        self.digest, self.any = hashlib.sha256(), False
        self.last: str | None = None
        self.counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.previous = None
        self.rows = self.turns = 0

    def _suffix(self, edit: Edit) -> str:
        out = []
        while edit is not self.root:
            out.append(edit.letter)
            edit = edit.before
        return "".join(reversed(out))

    def _better(self, new: tuple[int, Edit, str], old: tuple[int, Edit, str] | None) -> bool:
        """By cost, then by the audits; an edit not made yet is its predecessor and a letter."""
        if old is None or new[0] != old[0]:
            return old is None or new[0] < old[0]
        return self._suffix(new[1]) + new[2] < self._suffix(old[1]) + old[2]

    def _follow(self, options: dict[str, list[tuple[int, Edit, str, tuple[str, str] | None]]]) -> None:
        """Take the best option of each state, and free what has no survivor."""
        chosen = {}
        for state, choices in options.items():
            best = None
            for x in choices:
                if self._better(x, best):
                    best = x
            chosen[state] = best
        made = {}
        for state, (cost, before, letter, row) in chosen.items():
            edit = Edit(before, letter, row) if letter else before
            edit.uses += 1
            made[state] = (cost, edit)
        for _, edit in self.survivors.values():
            self._release(edit)
        self.survivors = made

    def _release(self, edit: Edit | None) -> None:
        edit.uses -= 1
        while not edit.uses and edit is not self.root:
            edit = edit.before
            edit.uses -= 1

    def _insert(self) -> None:
        """Rows put in before the next one: first those that lead to a user, then to an assistant."""
        for state in ("u", "a"):
            options = {s: [(c, e, "", None)] for s, (c, e) in self.survivors.items()}
            for s in BEFORE[state]:
                if s in self.survivors:
                    cost, edit = self.survivors[s]
                    options.setdefault(state, []).append((cost + COST[INSERT], edit, INSERT, (ROLE[state], "")))
            self._follow(options)

    def _drop_hopeless(self) -> None:
        """Survivors that can't win any more, or they would hold the first edit for ever. What may follow
        nothing may follow an assistant, but for keeping a system role, which deleting replaces for 4 at
        most; what may follow a system role may follow an assistant. Only what costs more goes, so ties stay."""
        if "a" not in self.survivors:
            return
        cost = self.survivors["a"][0]
        for state, more in (("", COST[DELETE]), ("s", 0)):
            if state in self.survivors and self.survivors[state][0] > cost + more:
                self._release(self.survivors.pop(state)[1])

    def _settle(self) -> None:
        """While the root has one edit only below it, that one is settled."""
        leaves = [e for _, e in self.survivors.values()]
        if self.root.uses != 1 or any(e is self.root for e in leaves):
            return
        # Walk from one survivor down to the root, then take the edits that all descend from.
        path, e = [], leaves[0]
        while e is not self.root:
            path.append(e)
            e = e.before
        ends = {id(x) for x in leaves}
        while path and self.root.uses == 1:
            self.root = path.pop()
            self.root.before = None
            self._write(self.root)
            if id(self.root) in ends:
                break

    def _write(self, edit: Edit) -> None:
        self.letters.append(edit.letter)
        if edit.row:
            self.digest.update(("\n" * self.any + f"{edit.row[0]}:{edit.row[1]}").encode("utf-8", "surrogatepass"))
            self.any = True
            edit.row = None

    def row(self, turn, role: str, text: str, blank: bool, truncated: bool, duplicate: bool) -> None:
        if not self.rows:
            self._insert()
        if turn is not None:
            if self.least is None:
                self.least = turn
            if self.most != turn:
                self.turns += 1
            self.most = turn
        initial = role[:1]
        if self.rows and self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.rows, self.last = self.rows + 1, initial
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            self.counts[fault] += 1
        options: dict[str, list] = {s: [(c + COST[DELETE], e, DELETE, None)] for s, (c, e) in self.survivors.items()}
        if fault in (None, "truncated"):
            more = TRUNCATED_KEPT if fault else 0
            for state, before in BEFORE.items():
                for s in before:
                    if s not in self.survivors:
                        continue
                    cost, edit = self.survivors[s]
                    if state == initial:
                        options.setdefault(state, []).append((cost + more + COST[KEEP], edit, KEEP, (role, text)))
                    if state in ROLE:
                        options.setdefault(state, []).append((cost + more + COST[REROLE], edit, REROLE, (ROLE[state], text)))
        self._follow(options)
        self._insert()
        self._drop_hopeless()
        self._settle()

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, digest; an end needs whole turns."""
        cost = 0
        if self.rows:
            ends = [(*self.survivors[s], "") for s in ("", "a") if s in self.survivors]
            best = ends[0]
            for x in ends[1:]:
                if self._better(x, best):
                    best = x
            cost, edit, path = best[0], best[1], []
            while edit is not self.root:
                path.append(edit)
                edit = edit.before
            for edit in reversed(path):
                self._write(edit)
            if self.least is not None:
                self.counts["gaps"] = int(self.most - self.least) + 1 - self.turns
        return *self.counts.values(), cost, "".join(self.letters), self.digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, there``: the rows with one of twenty dropped, emptied, cut short of its
    ends of sentences, repeated or given to the user, by the CRC-32 of its place. A dropped row stays
    as one with ``there`` false, by which its conversation is known."""
    blank = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    x = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.pmod(F.crc32(place.cast("binary")), F.lit(20)).alias("x"))
    text = F.when(F.col("x") == 1, "").when(F.col("x") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("x") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("x") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("x") != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def whole(conversations: DataFrame) -> DataFrame:
    """The rows as they are, nulls as one space, in the form of ``damaged``."""
    blank = F.lit(" ")
    return conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.lit(True).alias("there"))


def _order(turn: Column) -> Column:
    """Turns with nulls first, inside a struct."""
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (``conv_id, turn, role, text, there``): ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256``.

    Rows go by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text, and equal rows
    stand beside each other, the first of them being the original. The first fault of a row counts: no
    character but ASCII blanks; role and text as in an earlier row; a last such character other than . ! ?
    Roles are known by their first character; a row of a role other than s, u or a (null, which is one space, and an
    empty one among them) can't be kept as it is. A missing conv_id is a conversation of its own.
    Conversations without a row that is there have zeros, an empty audit and the digest of nothing. No rows give no rows.
    Other columns are ignored.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    key = F.unhex(F.sha2(F.col("text"), 256))
    d = rows.select("conv_id", "turn", "role", "text", "there", key.alias("h"))
    # Repeats at a later turn: (conv_id, role, h) that came before. Only digests are shuffled for this.
    seen = rows.where("there").select("conv_id", "role", key.alias("h"), _order(F.col("turn")).alias("at"))
    once = seen.groupBy("conv_id", "role", "h", "at").agg(F.count("*").alias("n"))
    once = materialize(once, "op11-places")
    first = materialize(once.groupBy("conv_id", "role", "h").agg(F.min("at").alias("first"), F.count("*").alias("places")).where("places > 1").drop("places"), "op11-first")
    later = join_same(once, first, ["conv_id", "role", "h"], "inner").where(F.col("at") > F.col("first"))
    marks = later.select("conv_id", F.col("at.turn").alias("turn"), "role", F.lit(None).cast("string").alias("text"), F.lit(True).alias("there"), "h", F.lit(0).alias("kind"))
    seen_char = F.regexp_extract("text", rf"(?s)({_VISIBLE})[\x20\x09-\x0D]*\z", 1)
    end = F.when(F.col("text").isNotNull(), seen_char).alias("end")
    stream = d.withColumn("kind", F.when(F.col("there"), 1).otherwise(2)).unionByName(marks)
    stream = stream.withColumn("end", end).withColumn("known", F.col("turn").isNotNull())
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "known", "turn", "role", "h", "kind")

    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    types = (pa.int64(),) * 6 + (pa.string(),) * 2

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, conv, mark, last = None, None, None, None
        ids, done = [], []

        def made(id_field) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            out = pa.RecordBatch.from_arrays([pa.array(ids, id_field), *columns], ["conv_id", *names])
            ids.clear()
            done.clear()
            return out

        id_field = None
        for batch in batches:
            id_field = batch.schema.field("conv_id").type
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "h", "kind", "end")]
            for conv_id, turn, role, text, h, kind, ended in zip(*cols):
                if search is None or conv_id != conv:
                    if search:
                        ids.append(conv)
                        done.append(search.result())
                    search, conv, mark, last = Search(), conv_id, None, None
                if kind == 0:
                    mark = (turn, role, h)
                elif kind == 1:
                    at = (turn, role, h)
                    search.row(turn, role, text, ended == "", ended not in ("", ".", "!", "?"), at in (mark, last))
                    last = at
            if len(ids) > 2000:
                yield made(id_field)
        if search:
            ids.append(conv)
            done.append(search.result())
        if ids:
            yield made(id_field)

    schema = f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return stream.select("conv_id", "turn", "role", "text", "h", "kind", "end").mapInArrow(of, schema)
