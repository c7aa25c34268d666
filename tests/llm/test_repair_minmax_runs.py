"""Conversation repair, min-max near copies and periodic runs against plain versions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.llm import conversation_repair as cr
from spanloom.llm import minmax_dedup as mm
from spanloom.llm import periodic_runs as pr
from spanloom.llm import queries as q

BLANK = " \t\n\x0b\f\r"
CLASH = ("kind", "h", "end", "at", "n", "first", "node", "band", "v", "comp", "g", "tk", "sig", "there", "known", "x", "copy", "start", "length")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# Conversation repair


def order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest()


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if x:
            text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
            own += [(turn, "user" if x == 4 else role, text)] * (1 + (x == 3))
    return {c: sorted(v, key=order) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        t = text.strip(BLANK)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by a search over whole audits, cheapest and least first; two inserts in a row at most."""
    found = faults(rows)
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, kept
        if not audit.endswith("II"):
            for s, name in (("u", "user"), ("a", "assistant")):
                if (state == "u") == (s == "a"):
                    heapq.heappush(heap, (cost + 3, audit + "I", at, s, kept + ((name, ""),)))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, kept))
        if found[at] in ("blank", "duplicate"):
            continue
        more = 3 if found[at] else 0
        s = role[:1]
        if s == "s" and state == "" or s == "u" and state != "u" or s == "a" and state == "u":
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, s, kept + ((role, text),)))
        s, name = ("a", "assistant") if state == "u" else ("u", "user")
        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, s, kept + ((name, text),)))
    raise AssertionError


def plain_repair(rows):
    f = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = cheapest(rows) if rows else (0, "", ())
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, sha


def test_repairs_of_made_conversations(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "no end", "", " \t", "Why?", "ends in mark. ", "one. ", "é", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    rows = [(c, rng.choice([None, *range(6)] if rng.random() < 0.3 else [k]), rng.choice(roles), rng.choice(texts)) for c in range(150) for k in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "A."), (None, 1, "assistant", "B."), (None, 1, "assistant", "B."), (7, 3, "user", "x" * 50_000 + ".")]
    rows += [(900, k, ("user", "assistant")[k % 2], f"Row {k % 13}.") for k in range(60)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r[0]: tuple(r)[1:] for r in cr.repair(cr.damaged(df)).collect()}
    want = {c: plain_repair(v) for c, v in plain_damage(rows).items() if c != 900}
    long = got.pop(900)
    assert got == want
    assert re.fullmatch("[KRDI]+", long[6]) and long[1:4] == tuple(faults(plain_damage(rows)[900]).count(x) for x in ("blank", "duplicate", "truncated"))
    assert cr.repair(cr.damaged(df.limit(0))).count() == 0


def test_repairs_of_given_conversations(spark, sf_dir):
    d = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    want = plain_damage(list(d[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)))
    got = {r[0]: tuple(r)[1:] for r in q.op11_conversation_repair(spark, sf_dir).collect()}
    assert got == {c: plain_repair(v) for c, v in want.items()}


def test_undamaged_conversations(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "assistant", "A."), (2, 5, "user", "Q?"), (3, None, "assistant", "A.")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: (r.gaps, r.illegal, r.cost, r.audit) for r in cr.repair(cr.whole(df)).collect()}
    assert got == {1: (0, 0, 0, "KKK"), 2: (0, 0, 3, "KI"), 3: (0, 0, 3, "IK")}


@pytest.mark.parametrize("seed", range(25))
def test_ties_over_long_suffixes(seed):
    """Every survivor's suffix is compared as a whole; memory holds only what is not settled."""
    rng = random.Random(seed)
    rows = [(k, rng.choice(["user", "user", "assistant", "assistant", "system", "tool"]), rng.choice(["A.", "open", ""]) + str(k) * (rng.random() < 0.7)) for k in range(rng.randint(1, 11))]
    s = cr.Search()
    for (turn, role, text), fault in zip(rows, faults(rows)):
        s.row(turn, role, text, fault == "blank", fault == "truncated", fault == "duplicate")
    cost, audit, kept = cheapest(rows)
    assert s.result()[5:] == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def test_survivors_coalesce():
    """A long conversation leaves a short tree behind it."""
    s, most = cr.Search(), 0
    for k in range(20_000):
        s.row(k, ("user", "assistant")[k % 2] if k % 7 else "tool", f"Row {k}.", False, False, False)
        held = {id(s.root)}
        for _, e in s.survivors.values():
            while e is not s.root:
                held.add(id(e))
                e = e.before
        most = max(most, len(held))
    assert most < 60 and len(s.letters) > 19_900


# Min-max near copies


def plain_components(texts, n=3, percent=85):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        r = root(i)
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    out = []
    for i, (d, _) in enumerate(texts):
        none, c = least[root(i)]
        c = None if none else c
        out.append((d, len(sets[i]), d if not sets[i] else c, not sets[i] or d == c))
    return sorted(out, key=str)


def near_texts(rng, clusters, copies):
    out = []
    for c in range(clusters):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 4, 8, 9, 12, 30, 80, 200]))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            out.append(" ".join(w).title() if rng.random() < 0.3 else "  ".join(w))
    return out


def test_near_copies(spark):
    rng = random.Random(12)
    texts = [(i, t) for i, t in enumerate(near_texts(rng, 60, 7))]
    texts += [(900, None), (901, ""), (902, " \t\n"), (None, "no id"), (None, None), (903, "NO ID"), (904, "École É"), (905, "école é"), (3, texts[3][1]), (3, "other words of three here"), (906, "a b c d")]
    texts += [(950, " ".join(f"l{i % 5000}" for i in range(30_000))), (951, " ".join(f"l{i % 5000}" for i in range(30_100)))]
    df = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    for how in ({}, {"block_texts": 3}, {"block_bytes": 500}):
        got = mm.near_copies(df, **how)
        assert sorted(map(tuple, got.collect()), key=str) == plain_components(texts)
    assert mm.near_copies(df.limit(0)).count() == 0


def test_large_cluster_across_blocks(spark):
    """Chains of near copies whose neighbours only are similar hang together over many blocks."""
    w = [f"w{i}" for i in range(100)]
    chain = []
    for k in range(120):
        w[(k * 2) % 100] = f"n{k}"
        chain.append((k, " ".join(w)))
    texts = chain + [(500 + i, t) for i, t in enumerate(near_texts(random.Random(5), 3, 40))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for how in ({"block_texts": 4}, {"block_texts": 16}, {}):
        assert sorted(map(tuple, mm.near_copies(df, **how).collect()), key=str) == plain_components(texts)


def test_near_copies_of_given_documents(spark, sf_dir):
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    texts = list(d[["doc_id", "text"]].itertuples(index=False, name=None))
    assert sorted(map(tuple, q.op12_minmax_dedup(spark, sf_dir).collect()), key=str) == plain_components(texts)


def test_signature_is_unbiased():
    rng = np.random.default_rng(3)
    shares = []
    for _ in range(60):
        g = rng.integers(0, 2**64, 230, dtype=np.uint64)
        a, b = np.sort(g[:215]), np.sort(np.concatenate([g[15:]]))
        shares.append((mm.signature(a) == mm.signature(b)).mean())
    assert abs(np.mean(shares) - 200 / 230) < 0.012
    assert np.std(shares) < 1.1 * (200 / 230 * 30 / 230 / mm.VALUES) ** 0.5
    assert 40 < mm.least_agreements(0.85, 1e-9) < 55


# Periodic runs


def plain_runs(w):
    out = {}
    for p in range(1, len(w) // 3 + 1):
        x = 0
        while x < len(w) - p:
            a = x
            while x < len(w) - p and w[x] == w[x + p]:
                x += 1
            if x + p - a >= max(24, 3 * p):
                out.setdefault((a, x + p), p)
            x = max(x, a + 1)
    return sorted((a, b - a, p) for (a, b), p in out.items())


def plain_described(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *top, sha("".join(f"{a},{length},{p}\n" for a, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_of_made_words():
    rng = random.Random(13)
    for _ in range(400):
        k, w = rng.choice([1, 2, 2, 3, 5]), []
        while len(w) < rng.randint(20, 400):
            b = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 18, 31, 33, 40, 64]))]
            if rng.random() < 0.5 and w:
                b = w[-rng.randint(1, min(60, len(w))) :]
            w += b * rng.choice([1, 1, 2, 3, 4, 9])
            if rng.random() < 0.4:
                w.append(rng.randrange(k + 2))
        assert pr.runs_of(np.array(w)) == plain_runs(w)


def test_runs_of_long_texts():
    for w, want in ((np.zeros(300_000, int), [(0, 300_000, 1)]), (np.arange(300_000) % 9, [(0, 300_000, 9)]), (np.arange(300_000) % 99_999, [(0, 300_000, 99_999)]), (np.arange(300_000), [])):
        assert pr.runs_of(w) == want


def test_periodic_runs(spark, sf_dir):
    rng = random.Random(14)
    texts = [(i, " \t".join(rng.choice(["a", "A", "b", "é", "c d"]) for _ in range(rng.randint(0, 90)))) for i in range(80)]
    texts += [(100, None), (101, ""), (102, " \n"), (None, "is " * 40), (103, "is " * 40), (103, "is " * 40), (104, "x y " * 30 + "z"), (105, "one  two three " * 9_000)]
    df = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    for plant in (True, False):
        got = pr.periodic_runs(df, plant=plant)
        assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_described(i, t, plant) for i, t in texts), key=str)
    assert pr.periodic_runs(df.limit(0)).count() == 0


def test_runs_of_given_documents(spark, sf_dir):
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = [plain_described(i, t) for i, t in d[["doc_id", "text"]].itertuples(index=False, name=None) if len(t or "") < 5_000]
    short = {w[0] for w in want}
    got = [tuple(r) for r in q.op13_periodic_runs(spark, sf_dir).collect() if r.doc_id in short]
    assert sorted(got, key=str) == sorted(want, key=str)
