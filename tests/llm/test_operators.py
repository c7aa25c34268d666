"""Each operator against a plain version, on rows with nulls, blanks, ties, repeats and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, exact_dedup, jaccard_join, license_scan, line_dedup, mixing, suffix_dedup, toxicity, url_filter, warc
from spanloom.llm import queries as q
from spanloom.llm.shared import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
NUMBERS = " ".join(f"n{i}" for i in range(40))
TEXTS = [
    (1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "one  TWO three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (3, None), (4, ""), (5, " \t\n"), (6, "ÉCOLE école"), (7, LONG), (8, LONG + " and more"),
    (9, NUMBERS), (9, NUMBERS), (10, NUMBERS + " tail"), (None, "no id here"), (11, "a\nb\nc\nd\na\nb\nc"), (12, "x\na\nb\nc\ny"),
    (13, "Released under the MIT License. mit LICENSE mit license!"), (14, "the GNU General Public License"), (11, "other text of eleven"),
    (15, "is " * 500), (16, "short"), (17, "short"),
]


def words(t):
    return WORD.findall((t or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named like those that the operators make."""
    df = spark.createDataFrame([(i, t, "s" if (i or 0) % 3 else None) for i, t in TEXTS], "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("tk", "h", "w", "n", "node", "starts", "lines", "copies", "key", "chunk", "size")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_contamination(spark, docs, empty):
    items = [(1, TEXTS[0][1].upper()), (2, "n3 n4 n5"), (3, "short"), (4, None), (5, "..."), (10, "n3 n4 n5"), (None, "école"), (7, "absent words")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(1))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])].add(i)
    want = []
    for i, t in TEXTS:
        w, hit, ids = words(t), set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= {str(x) for x in own if x is not None}
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    for block in (500_000, 3):
        got = decontaminate.contamination(docs, bench, block_shingles=block)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t in TEXTS:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        n, _, _, keep = min(groups[norm])
        want.append((i, keep, len(groups[norm]), i == keep and len(t or "") == -n, hashlib.sha256(norm.encode()).hexdigest()))
    for how in ({}, {"capacity": 2}, {"capacity": 2, "key_bits": 3}, {"key_bits": 1}):
        got = exact_dedup.exact_dedup(docs, **how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_index_is_by_bucket(spark, docs):
    """Keys that collide are chained, a bucket holds its capacity at most, and look-ups go through it."""
    index, slots, depth = exact_dedup.build_index(docs, capacity=4, key_bits=4)
    rows = index.collect()
    assert max(r.chained for r in rows) > 1 and all((r.norm is None) == (r.chained == 1) for r in rows)
    assert sorted((r.h, r.chain) for r in rows) == sorted({(r.h, k) for r in rows for k in range(r.chained)})
    of_slot = {r.slot: r.bucket for r in slots.collect()}
    assert all(of_slot[(r.h % 2**64) >> (64 - depth) if depth else 0] == r.bucket for r in rows)
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan and "slot" in plan


def test_the_owner_of_a_bucket_decides(spark, docs, monkeypatch):
    """What stays and how many there are comes from the chains: one that takes texts of a key for the same gives
    another answer."""
    right = sorted(map(tuple, exact_dedup.exact_dedup(docs, key_bits=3).collect()), key=str)
    monkeypatch.setattr(exact_dedup, "_same", lambda a, b: F.lit(True))
    wrong = sorted(map(tuple, exact_dedup.exact_dedup(docs, key_bits=3).collect()), key=str)
    assert max(r[2] for r in wrong) > max(r[2] for r in right)


def test_directory_doubles(spark):
    entries = spark.range(5000).select(F.xxhash64("id").alias("h"))
    depth, slots = exact_dedup.directory(entries, 300)
    of_slot = {r.slot: r.bucket for r in slots.collect()}
    assert len(of_slot) == 2**depth and depth >= 4
    load = Counter(of_slot[(r.h % 2**64) >> (64 - depth)] for r in entries.collect())
    assert max(load.values()) <= 300
    halves = [int(b.split(":")[0]) for b in set(of_slot.values())]
    assert sum(2 ** (depth - d) for d in halves) == 2**depth


def test_archives(spark):
    rows = [(1, "http://a b.com/x", "<p>ü</p>"), (2, None, "<p>ü</p>"), (3, "u", None), (4, "u", ""), (5, "u", LONG), (None, "u", "<p>ü</p>"), (2, None, "<p>ü</p>"), (None, "u", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("keep", F.lit(1))
    by = defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i)
    want = []
    for i, _, h in rows:
        ids = [x for x in by[h or ""] if x is not None]
        keep = max(ids) if ids else None
        digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        want.append((i, len((h or "").encode()), digest, "response" if i == keep else "revisit", None if i == keep else keep))
    assert sorted(map(tuple, warc.archive_pages(pages).collect()), key=str) == sorted(want, key=str)
    small = warc.archive_pages(pages, least_bytes=1000).where("record_type <> 'response'")
    assert small.count() == 0
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_of_many_files_have_a_dictionary(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(2)
    learned = warc.build_dictionary(warc.payloads_of(pages), dict_bytes=4096)
    manifest = warc.write_archives(warc.with_revisits(pages), learned, file_bytes=20_000)
    files = manifest.collect()
    assert len(files) > 2 and sum(f.records for f in files) == pages.count()
    heads = [open(f.path.removeprefix("file://"), "rb").read(4) for f in files]
    assert heads and all(int.from_bytes(h, "little") == warc.MAGIC for h in heads)
    back = warc.read_archives(manifest).where("intact")
    assert back.join(pages, (back.page_id == pages.page_id) & (back.payload.cast("string") == pages.html)).count() == pages.count()


def test_archives_are_read_by_the_address_they_were_written_to(spark, tmp_path, sf_dir, monkeypatch):
    """Scheme and host stay in the manifest."""
    monkeypatch.setattr(warc, "new_path", lambda spark, name: f"file://{tmp_path}/{name}")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_archives(warc.with_revisits(pages), b"")
    assert all(f.path.startswith(f"file://{tmp_path}/") for f in manifest.collect())
    assert warc.read_archives(manifest).where("intact").count() == pages.count()


def frames(raw):
    """The places in the bytes of an archive where a frame begins, its dictionary's apart."""
    import zstandard

    at = 8 + int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(raw[8:at])
    while at < len(raw):
        z = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        block = z.decompress(raw[at:])
        yield at, block
        at = len(raw) - len(z.unused_data)


@pytest.mark.parametrize("n", [1, 5, 60])
def test_each_record_is_a_frame_of_its_own(spark, n):
    rows = [(i, f"u{i}", None if i == 1 else f"<p>text {i * i}</p>" * (i + 1)) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    (file,) = warc.write_archives(warc.with_revisits(pages), warc.build_dictionary(warc.payloads_of(pages))).collect()
    raw = open(file.path.removeprefix("file://"), "rb").read()
    assert len(raw) == file.bytes and int.from_bytes(raw[:4], "little") == warc.MAGIC and int.from_bytes(raw[4:8], "little") > 0
    found = list(frames(raw))
    assert len(found) == n + 1 and all(block.startswith(b"WARC/1.1") and block.endswith(b"\r\n\r\n") for _, block in found)


def test_urls_come_back_as_they_were(spark):
    urls = ["http://a b.com/x y", "line\r\nWARC-Type: x", " blanks ", "", None, "http://a.com/\u00fc\u2028?q=1#f", "tab\there"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("same"))
    back = warc.read_archives(warc.write_archives(warc.with_revisits(pages), warc.build_dictionary(warc.payloads_of(pages))))
    assert [r.url for r in back.orderBy("page_id").collect()] == urls


def test_lost_responses_fail(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    whole = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **k: whole(*a, **k).where("record_type = 'revisit'"))
    with pytest.raises(ValueError, match="response"):
        warc.archive_pages(pages)


@pytest.mark.parametrize(("length", "gram"), [(400, 64), (60, 20)])
def test_suffix_dedup(spark, docs, empty, length, gram):
    import random

    r = random.Random(5)
    base = "".join(r.choice("abcdé ") for _ in range(3000))
    texts = list(TEXTS) + [(100 + k, base[a:b]) for k, (a, b) in enumerate([(0, 3000), (10, 900), (700, 2500), (0, 399), (2400, 3000)])]
    for k in range(6):
        t = list(base)
        for _ in range(8):
            t[r.randrange(len(t))] = "#"
        texts.append((200 + k, "".join(t)))
    texts.append((300, "z" * 2000 + base[:500] + "z" * 900))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    want = []
    for (i, _), d in zip(texts, data):
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        want.append((i, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(df, length, gram).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(docs, with_text=True).where("n_removed = 0 and kept is null").count() == 0


def plain_repeats(texts, length):
    """Removed bytes and runs of each text, looking at every string."""
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    for (i, _), d in zip(texts, data):
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        yield i, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone)))


def test_suffix_dedup_of_periods(spark):
    """Stretches that repeat themselves, of several periods, alone, cut short, in other texts, and at edges."""
    import random

    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    texts = []
    for p in (1, 2, 3, 7, 50, 90):
        unit = noise(p)
        texts += [unit * (3000 // p), noise(150) + unit * (900 // p) + noise(200), unit[p // 2 :] + unit * (130 // p + 1)]
        texts += [noise(40) + unit * (110 // p + 1), unit * (100 // p + 2) + noise(5) + unit * (700 // p)]
    texts += ["-" * 99, "-" * 100, "=" * 101, "_" * 100 + "x" + "_" * 100]
    texts = list(enumerate(texts))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), 100, 20).drop("kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(plain_repeats(texts, 100))


def test_long_period_is_one_run():
    import numpy as np

    lo, *_, sure = suffix_dedup.anchors(np.full(1_000_000, 45, np.uint8), 400, 64)
    assert len(lo) < 50 and sure.sum() == 1


def test_equal_polynomial_hashes_are_not_equal_texts(spark):
    """Thue-Morse words defeat any polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [(1, word[:1024]), (2, word[1024:2048]), (3, "x" + word[:1024]), (4, word[1024:2048] + "y")]
    want = sorted(plain_repeats(texts, 1024))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(texts[:2], "doc_id long, text string"), 1024, 64).collect()
    assert all(r.n_removed == 0 for r in got)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), 1024, 64).drop("kept_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_suffix_segments(monkeypatch):
    """Runs of a long text are the same suffixes, however it is cut into segments."""
    import numpy as np

    data = np.frombuffer((LONG * 2).encode(), np.uint8)
    whole = suffix_dedup.anchors(data, 400, 64)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 10_000)
    cut = suffix_dedup.anchors(data, 400, 64)
    for lo, hi, *_, sure in (whole, cut):
        lo, hi = lo[~sure], hi[~sure]
        assert lo[0] == 0 and hi[-1] == len(data) - 400 and (lo[1:] == hi[:-1] + 1).all()


def test_url_filter(spark, duck):
    canon = lambda u: f'<html><LINK href="{u}" rel="canonical"></html>'
    refresh = lambda u: f'<meta http-equiv=refresh content="0; url={u}">'
    rows = [
        (1, "http://a.com/en/1", "x"), (2, "http://b.org/zz?q=1#f", canon("https://A.com/en/1")), (3, "http://c.org/x", refresh("//b.org/zz?q=1")),
        (4, "http://d.org/x", canon("/y")), (5, "http://d.org/y", refresh("http://w.example.com/en/77")), (6, "http://e.org/q", canon("http://d.org/y")),
        (7, "http://d.org/r", canon("http://k.com/en/2")), (8, "http://d.org/r", canon("http://e.org/q")), (9, None, None), (10, "nothing", "x"),
        (11, "HTTP://X.ORG?a=/b", "x"), (13, "http://f.net/dir/p", canon("other?x=1&amp;y=2")), (14, "http://f.net/dir/other?x=1&y=2", refresh("http://z.net/de/1")),
        (1, "http://a.com/en/1", "x"), (15, "http://notcom/en/", None), (16, "http://sub.example.com/en/7#", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit("n")).withColumn("host", F.lit("h"))
    got = sorted(map(tuple, url_filter.filter_urls(df).collect()), key=str)
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    c.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert got == sorted(c.execute(q.OP5_SQL).fetchall(), key=str)
    by = {r[0]: r[4] for r in got}
    assert (by[2], by[3], by[4], by[5], by[7], by[13]) == ("block", "block", "allow", "allow", "allow", "block")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_addresses_are_resolved(spark):
    cases = {
        "HTTP://A.ORG:80/es/1": "a.org/es/1", "https://a.org:443?x=1#f": "a.org?x=1", "https://a.org:80/": "a.org:80/", "http://a.org/x/../../y/./z": "a.org/y/z",
        "http://a.org/x/..": "a.org/", "http://a.org/..": "a.org/", "http://a.org/a/.b/c..": "a.org/a/.b/c..", "http://a.org/p?q=/../r": "a.org/p?q=/../r", "no": None, "x:///y": None,
    }
    got = spark.createDataFrame([(u,) for u in cases], "url string").select("url", url_filter.address_of(F.col("url")).alias("a")).collect()
    assert {r.url: r.a for r in got} == cases


def test_url_filter_follows_links_of_all_kinds(spark, duck):
    """Random pages with relative, absolute and odd links, long HTML, several tags; SQL and a plain search agree."""
    import random

    import duckdb
    import pandas as pd

    r = random.Random(3)
    hosts = ["a.com", "B.com:80", "c.org", "www.example.com", "d.net", "e.io", "f.io", "g.io:8080"]
    paths = ["/en/1", "/en/77", "/es/2", "/de/3", "/x/y", "/x/../es/9", "/", "", "/q?z=1", "/q?z=2"]
    links = ["../../es/1", "/de/5", "//c.org/es/4", "http://e.io/x/y", "https://f.io:443/x/y", "y", "./y", "..", "", "http://www.example.com/en/7", "?z=1"]
    tag = lambda u: r.choice([f'<link rel="canonical" href="{u}">', f"<LINK HREF='{u}' REL=canonical>", f'<meta http-equiv="Refresh" content="3;URL={u}">'])
    rows = []
    for i in range(160):
        body = "<p>text</p>" * r.choice([1, 3, 20_000 if i % 40 == 0 else 5])
        html = body + "".join(tag(r.choice(links + ["http://" + r.choice(hosts) + r.choice(paths)])) for _ in range(r.choice([0, 0, 1, 1, 2])))
        rows.append((i, r.choice(["http://", "https://", "HTTP://"]) + r.choice(hosts) + r.choice(paths), html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, url_filter.filter_urls(df).collect()), key=str)
    c = duckdb.connect()
    c.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert got == sorted(c.execute(q.OP5_SQL).fetchall(), key=str)
    near = defaultdict(set)
    for x in url_filter.links_of(df).collect():
        near[x.a].add(x.b)
        near[x.b].add(x.a)

    def rule(address):
        host, _, rest = address.partition("/")
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host.split("?")[0] == h or host.split("?")[0].endswith("." + h)) and ("/" + rest).startswith(p)]
        return max(fits, key=lambda x: len(x[0]))[1] if fits else None

    nodes = {x.page_id: x.a for x in df.select("page_id", url_filter.address_of(F.col("url")).alias("a")).collect()}
    assert sum(bool(near[n]) for n in nodes.values()) > 50
    for i, _, _, own, verdict in got:
        seen, todo = set(), [nodes[i]]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        found = {rule(x) for x in seen} if len(seen) > 1 else set()
        if own is None:
            assert verdict == ("block" if "block" in found and "allow" not in found else "allow"), (i, nodes[i])


def test_url_filter_takes_all_tags(spark):
    reload = "<meta http-equiv=refresh content=30>"
    refresh = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    canon = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://a.org/1", reload + refresh("http://x.com/en/1")), (2, "http://a.org/2", "<link rel=canonical>" + canon("http://a.org/ok") + canon("http://x.com/en/2")),
        (3, "http://a.org/3", canon("http://x.com/en/3") + refresh("http://a.org/3b") + refresh("http://www.example.com/en/7")), (4, "http://a.org/3b", ""), (5, "http://a.org/5", reload),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    links = {tuple(r) for r in url_filter.links_of(df).collect()}
    assert links == {("a.org/1", "x.com/en/1"), ("a.org/2", "a.org/ok"), ("a.org/2", "x.com/en/2"), ("a.org/3", "x.com/en/3"), ("a.org/3", "a.org/3b"), ("a.org/3", "www.example.com/en/7")}
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(5, 5), (60, 61), (61, 60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 30)}, 60: 60, 61: 60}


def near(rows, n=5, t=0.8):
    """Class, links and copies of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(text)
        m = min(n, len(w))
        sets.append(frozenset(tuple(w[k : k + m]) for k in range(len(w) - m + 1)) if w else None)
    distinct = [s for s in dict.fromkeys(sets) if s]
    links, parent = Counter(), {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            both = len(a & b)
            if both >= t * (len(a) + len(b) - both):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s:
            r = root(s)
            least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    out = []
    for (i, _), s in zip(rows, sets):
        out.append((i, i, 0, 1) if not s else (i, None if least[root(s)][0] else least[root(s)][1], links[s], sets.count(s)))
    return out


def copies(seed, groups=4, size=40):
    import random

    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(120)]
        for k in range(size):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
            rows.append((g * 1000 + k, " ".join(w)))
    return rows


def test_jaccard_join(spark, docs, empty):
    rows = TEXTS + copies(3)
    df = spark.createDataFrame([(None if i is None else i, t) for i, t in rows], "doc_id long, text string")
    want = sorted(near(rows), key=str)
    for texts in (2048, 16):
        got = jaccard_join.similar_documents(df, block_texts=texts).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert jaccard_join.similar_documents(empty).count() == 0
    assert jaccard_join.similar_documents(docs, with_key=True).where("first").count() > 0


def test_pruning_keeps_what_reaches_the_threshold():
    least = jaccard_join.least_matches(0.8, 1e-6)
    assert least[16] <= 5 and 50 <= least[96] <= 62 and all(least[n] <= n for n in range(97))


def test_line_dedup(docs, empty):
    rows = sorted(set((i is not None, i or 0, t) for i, t in TEXTS), key=lambda x: (x[0], x[1], x[2] or ""))
    got = line_dedup.dedup_lines(docs.drop("n_lines")).select("doc_id", "text", "clean_text", "n_lines", "n_removed", "n_spans").collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == len(TEXTS)
    assert by[11, "a\nb\nc\nd\na\nb\nc"][2:] == ("a\nb\nc\nd", 7, 3, 1)
    assert by[12, "x\na\nb\nc\ny"][2:] == ("x\ny", 5, 3, 1)
    assert by[3, None][2:] == (None, 0, 0, 0) and by[4, ""][2:] == ("", 1, 0, 0)
    assert sum(r.n_removed for r in got) == 6 and len(rows) == len(by)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_toxicity(spark, docs, empty):
    import random

    r = random.Random(1)
    clean = lambda: [f"k{r.randrange(300)}" for _ in range(60)]
    rows, labels = [], []
    for i in range(900):
        w, bad = clean(), i % 6 == 0
        for _ in range(r.randrange(2, 5) if bad else 0):
            w.insert(r.randrange(60), f"grumf{r.choice(['el', 'ix', 'ock', 'und'])}")
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows + [(5000, None), (5001, ""), (None, "x"), (0, "x")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (77777, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.score_documents(df, lab).collect()
    assert len(got) == 904 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    truth = dict(labels)
    wrong = [x for x in got if x.held_out and x.doc_id in truth and x.doc_id and x.predicted != truth[x.doc_id]]
    assert len(wrong) <= 3
    assert toxicity.score_documents(docs, lab.limit(0)).count() == len(TEXTS)
    assert toxicity.score_documents(empty, lab).count() == 0


def test_grammar_reads_clauses():
    g = toxicity.Grammar()
    tape = lambda t: dict(zip(toxicity.TAPES, g.tapes(t, set())))
    assert tape("You are an idiot.")["aimed"] > 0
    assert tape("What an idiot")["plain"] > 0
    assert tape("That is not an idiot")["negated"] > 0
    assert tape("Somebody said idiot")["reported"] > 0
    assert tape("I will hurt you")["threat"] > 0 and tape("It may hurt")["threat"] == 0
    assert not any(g.tapes("A calm sentence. And one more", set()))


def test_transducers_against_their_rules():
    """The composed machines, on all clauses of up to five words."""
    import itertools

    for n in range(1, 6):
        for clause in itertools.product(toxicity.SYMBOLS, repeat=n):
            want = []
            for k, x in enumerate(clause):
                negated = "n" in clause[max(0, k - toxicity.REACH) : k]
                said = "s" in clause[:k]
                aimed = "y" in clause[max(0, k - toxicity.REACH) : k + toxicity.REACH + 1]
                if x == "i":
                    want.append("negated" if negated else "reported" if said else "aimed" if aimed else "plain")
                else:
                    want.append("threat" if x == "t" and aimed and not negated and not said else "")
            assert toxicity.tapes_of_clause(list(clause)) == want, clause


def test_scores_follow_the_clauses(spark):
    """Scores of documents by hand: the strongest match of each clause, on its tape."""
    import math

    g = toxicity.Grammar(words={"idiot": 3.0, "clown": 2.0})
    rows = {
        "You idiot, you clown. idiot": {"aimed": 3.0, "plain": 3.0}, "not an idiot; they said clown": {"negated": 3.0, "reported": 2.0},
        "We will hurt you! Nobody kills": {"threat": 1.0}, "hurt not you": {"threat": 1.0}, "nothing here": {}, "": {},
    }
    scores = spark.createDataFrame([(t,) for t in rows], "text string").select("text", toxicity.toxicity_score(F.col("text"), g).alias("s")).collect()
    for r in scores:
        want = rows[r.text]
        z = toxicity.PRIOR[0] + sum(math.log1p(v) * g.tape_weights()[toxicity.TAPES.index(k)] for k, v in want.items())
        assert abs(r.s - 1 / (1 + math.exp(-z))) < 1e-9, r.text


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(500)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 3, "doc_id long, toxic int")
    assert toxicity._training_rows(docs, labels, 10).count() == 10
    assert toxicity._training_rows(docs, labels, 1000).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(50))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_license_spans_are_verified(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    w = notice.split()
    shuffled = " ".join(x for k in range(0, len(w), 3) for x in reversed(w[k : k + 3]))
    texts = [
        (1, f"a b c {notice} x y"), (2, "z " + " ".join(w[:9] + ["other"] + w[9:14] + w[15:]) + " z"), (3, shuffled), (4, " ".join(w[:8])),
        (5, notice + " and again " + notice.upper()), (6, " ".join(w[:10]) + " " + "pad " * 30 + " ".join(w[10:])),
    ]
    spans = license_scan.license_spans(spark.createDataFrame(texts, "doc_id long, text string")).where("tid >= 0").collect()
    good = {}
    for r in spans:
        if r.share is not None and r.share >= 0.8:
            good.setdefault(r.doc_id, []).append((r.first_word, r.last_word, round(r.share, 3)))
    assert good.pop(1) == [(3, 22, 1.0)] and good.pop(2) == [(1, 20, 0.95)] and sorted(good.pop(5)) == [(0, 19, 1.0), (22, 41, 1.0)] and not good


@pytest.mark.parametrize("at", range(0, len(license_scan.NOTICES), 9))
def test_each_notice_is_one_license(spark, at):
    """Its own text gives its label only; with its telling words changed it gives none."""
    notices = license_scan.NOTICES[at : at + 9]
    rows = [(k, f"some words before. {text}. And others after it") for k, (_, text) in enumerate(notices)]
    other = {"4.0": "9.0", "3.0": "9.0", "2.0": "9.0", "1.0": "9.0", "1.1": "9.1", "2.1": "9.1", "1.2": "9.2", "1.3": "9.3", "3.01": "9.01", "version 3": "version 9", "version 2": "version 9", "Version 2": "Version 9", "v1.0": "v9.0"}
    for k, (_, text) in enumerate(notices):
        for a in sorted(other, key=len, reverse=True):
            if text.endswith(a):
                rows.append((100 + k, f"some words before. {text.removesuffix(a)}{other[a]}. And others after it"))
                break
    got = {r.doc_id: set(r.labels.split(",")) - {"", *r.base_labels.split(",")} for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _) in enumerate(notices):
        assert got[k] == {label} - {"mit"} or got[k] == {label}, (k, label)
    assert not any(v for k, v in got.items() if k >= 100)


def test_a_license_that_is_not_listed(spark):
    texts = ["Licensed under CC BY-NC-XX 4.0.", "Licensed under the Foo Public License 2.0", "Licensed under CC BY 2.5", "Licensed under CC BY-NC 4.0. Licensed under CC BY-ND 4.0", "it is licensed under a license"]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in got} == {0: "", 1: "", 2: "", 3: "cc-by-nc-4.0,cc-by-nd-4.0", 4: ""}
    assert all(r.score < 1 for r in got if r.doc_id != 3)


def plain_licenses(text):
    """Labels and score without a join: every template against every place, diagonals by hand."""
    from difflib import SequenceMatcher

    w = words(text)
    base = [x for p, x in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    spans, best = [], 0.0
    for tid, (label, t, asked) in enumerate(license_scan.TEMPLATES):
        t = words(t)
        votes = defaultdict(set)
        for j in range(len(t) - 2):
            for k in range(len(w) - 2):
                if w[k : k + 3] == t[j : j + 3]:
                    votes[k - j].add(j)
        runs = []
        for d in sorted(votes):
            if not runs or d - runs[-1][-1] > 2:
                runs.append([])
            runs[-1].append(d)
        for run in runs:
            share = len(set().union(*(votes[d] for d in run))) / (len(t) - 2)
            d = min(run, key=lambda x: (-len(votes[x]), x))
            if share >= 0.4:
                begin = max(d - 8, 0)
                m = [b for b in SequenceMatcher(None, w[begin : d + len(t) + 8], t, autojunk=False).get_matching_blocks() if b.size]
                a, z = m[0].a, m[-1].a + m[-1].size
                share = 2 * sum(b.size for b in m) / (z - a + len(t))
                if share >= asked:
                    spans.append(((share, len(t), -tid, begin + a), range(begin + a, begin + z), label))
            best = max(best, share)
    won = {x for r, at, x in spans if not any(set(at) & set(o) and q_ > r for q_, o, _ in spans)}
    return ",".join(sorted(won | set(base))), 1.0 if base else best


def test_licenses_of_given_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in q.queries()["op9_license_scan"](spark, sf_dir).collect()}
    want = {r.doc_id: plain_licenses(r.text) for r in d.collect()}
    assert got == {k: (a, round(b, 9)) for k, (a, b) in want.items()}
    assert any(a for a, _ in want.values())


def test_license_base_matches_sql(spark, duck, sf_dir):
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = q.queries()["op9_license_scan"](spark, sf_dir).select(cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(duck.execute(q.OP9_BASE_SQL).fetchall(), key=str)


def test_license_scan(spark, docs, empty):
    want = []
    phrases = [(p.split(), x) for p, x in license_scan.BASE]
    for i, t in TEXTS:
        w = words(t)
        at = [(k, x) for p, x in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        want.append((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = license_scan.scan_licenses(docs)
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want, key=str)
    text = "Here: permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files end"
    one = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert one.labels == "mit" and one.base_labels == "" and 0.7 < one.score < 1
    assert license_scan.scan_licenses(empty).count() == 0


def targets(rows, share=1.5, cap=2):
    size = defaultdict(int)
    for s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, free, left = {}, set(order), share * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= cap * size[s]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        for s in over:
            want[s] = cap * size[s]
            left -= want[s]
        free -= over
    return size, want


def test_mixing(spark, docs, empty, sf_dir):
    for df in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(3)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
        text = [(r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.select("source", "text").collect()]
        size, want = targets(text)
        taken = Counter()
        for r in got:
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert len(got) == len(text) and all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert mixing.mix(empty).count() == 0


def test_targets_of_many_sources_are_summed_in_ranges(spark, monkeypatch):
    """Ranges of few sources give what one range gives, whatever ends a range: ties in size, no words, null."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rows = [(None if k == 40 else f"s{k % 60:02d}", (k * 37) % 11 * (100 if k % 9 == 0 else 1)) for k in range(150)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long"), cap=2).collect()
    size, want = targets(rows)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    assert {r.source: r.sid for r in got} == {s: k for k, s in enumerate(order)}
    assert all(r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 for r in got) and len(got) == len(size)
    docs = spark.createDataFrame([(k, s, "w " * n) for k, (s, n) in enumerate(rows)], "doc_id long, source string, text string")
    taken = Counter()
    for r in mixing.mix(docs, shard_slots=16).collect():
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)


def test_mix_is_written_in_shards(spark, docs, empty, sf_dir):
    word = r"[^\x20\x09-\x0D]+"
    for df in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        d, shards = mixing.mix_shards(df, shard_slots=64)
        texts = defaultdict(list)
        for r in df.collect():
            texts[r.doc_id, r.source, len(re.findall(word, r.text or ""))].append(re.findall(word, r.text or ""))
        laid, taken = defaultdict(dict), Counter()
        for r in d.collect():
            if r.size:
                laid[r.sid][r.off] = [r.doc_id, r.source, r.size]
        # Rows of one id, source and size differ in words at most: any order is tried by what the mix holds.
        words_of = {s: [None] * sum(x[2] for x in of.values()) for s, of in laid.items()}
        mixed, want = shards.collect(), {r.sid: int(r.target + 1e-6) for r in d.collect()}
        assert len({r.place for r in mixed}) == len(mixed) and all(r.shard == r.place // 64 for r in mixed)
        for r in mixed:
            got = re.findall(word, r.text)
            assert len(got) == r.use == sum(x.n for x in r.spans) <= 64
            taken[r.sid] += r.use
            for j, w in enumerate(got, 64 * r.b):
                assert words_of[r.sid][j] in (None, w)
                words_of[r.sid][j] = w
            at = 64 * r.b
            for x in r.spans:
                assert x.off == at or (x.off < at == 64 * r.b)
                at += x.n
        for s, of in laid.items():
            for off, (i, source, size) in of.items():
                seen = words_of[s][off : off + size]
                assert any(all(a in (None, b) for a, b in zip(seen, t)) for t in texts[i, source, size])
        assert all(abs(taken[s] - n) <= 1 for s, n in want.items())
    assert mixing.mix_shards(empty)[1].count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).selectExpr("id as i", f"cast({n} as long) as n_blocks", "5L as seed")
        df = df.withColumn("shifts", F.transform(F.sequence(F.lit(0), F.lit(mixing.ROUNDS - 1)), lambda r: F.pmod(F.xxhash64("seed", r), "n_blocks")))
        df = df.withColumn("b", mixing.swap_or_not(F.col("i")))
        rows = df.withColumn("i", F.col("i")).withColumn("back", mixing.swap_or_not(F.col("b"), back=True)).collect()
        assert sorted(r.b for r in rows) == list(range(n)) and all(r.back == r.i for r in rows)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = q.queries()[name](spark, sf_dir)
    cur = duck.execute(q.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(str([r[c] for c in order]) for r in df.collect())
    assert got == sorted(str([r[names.index(c)] for c in order]) for r in cur.fetchall())
