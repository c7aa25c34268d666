"""The pipeline's stages, each against a plain version on what the one before it kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from spanloom.llm import toxicity
from test_operators import near, targets, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(cp.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]

    one = steps["toxicity"](spark, docs, sf_dir)
    grammar = toxicity.fit_grammar(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = [r for r in rows(docs) if grammar.score(toxicity.np.array([grammar.tapes(r[1] or "", set())]))[0] < cp.TOXIC]
    assert rows(one) == keep and one.columns == COLUMNS and len(keep) < docs.count()

    two = steps["line_dedup"](spark, one, sf_dir)
    seen, want = set(), []
    for i, text, lang, source, n in keep:
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            win = tuple(lines[k : k + 3])
            gone |= set(range(k, k + 3)) if win in seen else set()
            seen.add(win)
        if len(gone) < len(lines):
            text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
            want.append((i, text, lang, source, len(text) if gone else n))
    assert rows(two) == want and two.columns == COLUMNS

    three = steps["jaccard_join"](spark, two, sf_dir)
    classes = near([(r[0], r[1]) for r in want])
    want = [r for r, (i, c, _, _) in zip(want, classes) if i == c]
    assert rows(three) == want and three.columns == COLUMNS

    four = steps["decontamination"](spark, three, sf_dir)
    wins = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        wins |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for r in want:
        w, hit = words(r[1]), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r)
    assert rows(four) == clean and four.columns == COLUMNS

    last = steps["mixing"](spark, four, sf_dir).collect()
    word = r"[^\x20\x09-\x0D]+"
    found = {r[0]: re.findall(word, r[1]) for r in clean}
    size, target = targets([(r[3], len(found[r[0]])) for r in clean])
    taken, of_doc = Counter(), defaultdict(Counter)
    for r in last:
        got = re.findall(word, r.text)
        assert len(got) == r.n_words and r.doc_ids
        taken[r.source] += r.n_words
        for w in got:
            of_doc[r.doc_ids[0] if len(r.doc_ids) == 1 else None][w] += 1
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert all(n <= 2 * found[i].count(w) for i, of in of_doc.items() if i is not None for w, n in of.items())
    assert {i for r in last for i in r.doc_ids} <= {r[0] for r in clean}
    assert sorted(map(str, cp.run(spark, sf_dir).collect())) == sorted(map(str, last))


GAPS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, "same words here for all of us", "en", "a", 29), (3, "same words here for all of us", "en", "a", 29),
    (4, "same words here for all of us", "en", "b", 29), (None, "no id", "en", "b", 5), (5, "x " * 4000, "en", "b", 8000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_with_gaps(spark, sf_dir):
    """Nulls, blanks and repeated rows go through all stages; empty documents give an empty mix."""
    docs = spark.createDataFrame(GAPS, SCHEMA)
    for d, n in ((docs, 5), (docs.limit(0), 0)):
        for name, stage in cp.STAGES:
            if name == "mixing":
                assert d.count() == n
            d = stage(spark, d, sf_dir)
        mixed = d.collect()
        assert {i for r in mixed for i in r.doc_ids} == ({3, 5, None} if n else set())
        assert abs(sum(r.n_words for r in mixed) - 1.5 * 4009 * (n > 0)) <= 2


def test_columns_of_any_name_come_back(spark, sf_dir):
    """Other columns keep their names and values in each stage, also those that the operators use themselves."""
    names = ["tk", "lines", "starts", "LINES2", "n_removed", "N_Spans", "clean_text", "gone", "row", "a.b", "h", "w", "p", "score", "sid", "off", "first", "hs"]
    long = "\n".join(f"line {k} of a very long text" for k in range(40_000))
    repeated = "head\n" + "\n".join(f"line {k} of a very long text" for k in range(7)) + "\ntail"
    data = [(*r, *[f"{c} {k}" for c in names]) for k, r in enumerate([*GAPS, (6, long, "en", "a", len(long)), (7, repeated, "en", "a", len(repeated))])]
    docs = spark.createDataFrame(data, SCHEMA + "".join(f", `{c}` string" for c in names))
    given = {(r[0], r[2:4], r[5:]) for r in map(tuple, docs.collect())}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [*COLUMNS, *names]
        rows_ = list(map(tuple, docs.collect()))
        assert rows_ and all((r[0], r[2:4], r[5:]) in given for r in rows_), name
    by = {r[0]: r for r in rows_}
    assert by[6][1] == long and by[7][1] == "head\ntail" and by[7][4] == len("head\ntail")
    assert cp.mix_sources(spark, docs, sf_dir).columns == ["shard", "place", "source", "n_words", "text", "doc_ids"]
