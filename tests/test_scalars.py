import random
import uuid

import pytest
from pyspark.sql import functions as F

from spanloom.functions import scalars as sc
from spanloom.operators import facts as fx
from spanloom.operators import graph as g
from spanloom.sources import documents as d


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_main_text(spark):
    page = "<html><head><title> A &amp; B </title><style>p{}</style></head><body><nav>menu</nav><p>One &lt;two&gt;</p><script>x()</script><!-- no --> three<footer>end</footer></body>"
    assert one(spark, page, sc.main_text) == "# A &amp; B\n\nOne <two> three"
    assert one(spark, "plain", sc.main_text) == "plain"


def test_approvals_are_read_as_substrings(spark):
    cases = {"I do not approve": "approved", "unknown": "rejected", "Yes!": "approved", "hm": "unclear", "Y": "approved", "n": "rejected", "y ": "unclear", "accept": "unclear"}
    assert {k: one(spark, k, sc.parse_approval) for k in cases} == cases


def test_tokens_count_units(spark):
    cases = {"": 0, "abcd": 1, "abcde": 2, "日本語日": 2, "😀😀😀": 2}
    assert {k: one(spark, k, sc.estimate_tokens) for k in cases} == cases


def test_prompts_types_and_templates(spark):
    assert one(spark, "  What   NOW?!.", sc.normalize_prompt) == "what now"
    assert one(spark, "/a.b/report.HTML", sc.mime_type) == "text/html"
    assert one(spark, "/a.b/report", sc.mime_type) == "text/plain"
    assert one(spark, {"k": "v"}, lambda m: sc.interpolate(F.lit("{{k}} {{z}}"), m), "map<string,string>") == "v {{z}}"
    assert one(spark, 2.4996, sc.round3, "double") == 2.5


def test_functions_have_sql_forms(spark):
    """Every registered function is there in SQL and says the same."""
    page = "<html><head><title> A &amp; B </title></head><body><nav>menu</nav><p>One &lt;two&gt; &quot;x&quot;</p><!-- no --> three</body></html>"
    texts = ["", "plain", page, "  What   NOW?!.", "Y", "no way", "/a.b/report.HTML", "/a.b/x.toml", "text/plain; charset=x", "application/PDF", "x" * 400, "日本語" * 90, "😀" * 9, None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    sc.register(spark)
    assert set(sc.SQL_FORMS) == set(sc.REGISTRY) and sc.names("preview", "nothing") == ["preview"] and sc.names() == sorted(sc.REGISTRY)
    for name in sc.names():
        x = F.lit(2.4996) if name == "round3" else F.col("x")
        got = df.select(sc.resolve(name)(x).alias("a"), F.expr(f"{name}({'2.4996' if name == 'round3' else 'x'})").alias("b"), "x").collect()
        assert all(r.a == r.b for r in got), (name, [r for r in got if r.a != r.b])


def test_content_kinds(spark):
    cases = {None: "html", "Application/PDF": "pdf", "text/plain; charset=utf-8": "text", "text/markdown": "text", "image/png": "html"}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", sc.content_kind(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases


def test_reports_are_selected_newest_first(spark):
    rows = [("ab-1", 3), ("ab-2", 5), ("cd-1", 4), ("ef-1", 1)]
    reports = spark.createDataFrame(rows, "name string, at int")
    newest = [-F.col("at"), F.col("name")]
    assert [(r.name, r["rank"]) for r in d.select_reports(reports, "name", newest, last=2).orderBy("rank").collect()] == [("ab-2", 1), ("cd-1", 2)]
    assert [r.name for r in d.select_reports(reports, "name", newest, prefixes=["ef", "ab", "ab-1"]).orderBy("rank").collect()] == ["ef-1", "ab-2", "ab-1"]
    with pytest.raises(Exception, match="begins with zz"):
        d.select_reports(reports, "name", newest, prefixes=["ab", "zz"]).collect()


def test_reports_that_do_not_parse_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"case_id": 1, "run": 2, "category": "x", "a": 1, "b": 2}\n{"case_id": 2, "run"\n{"case_id": 3, "run": 1}\n')
    got = d.read_reports(spark, str(tmp_path), modified=True).collect()
    assert [(r.case_id, r.file) for r in got] == [(1, "a.json")] and got[0].modified is not None


def adjacency(spark, folder, edges, **how):
    e = spark.createDataFrame([(k, 0, a, 0, b) for k, a, b in edges], "kind string, src_kind int, src long, dst_kind int, dst long")
    return g.write_adjacency(e, str(folder), f"edges_{uuid.uuid4().hex}", buckets=3, **how)


def test_search_by_kind_and_both_ways(spark, tmp_path):
    edges = [("a", 1, 2), ("b", 2, 3), ("a", 4, 2), ("c", 4, 5)]
    roots = spark.createDataFrame([(7, 0, 1)], "run_id long, node_kind int, node long")
    there, back = adjacency(spark, tmp_path, edges), adjacency(spark, tmp_path, edges, turned=True)

    def find(*e, **how):
        return {r.node: r.hops for r in g.reachable(list(e), roots, 3, str(tmp_path / uuid.uuid4().hex), **how).collect()}

    assert find(there) == {1: 0, 2: 1, 3: 2} and find(there, kinds=["a"]) == {1: 0, 2: 1}
    assert find(there, back, kinds=["a", "b"]) == {1: 0, 2: 1, 3: 2, 4: 2} and find(there, back) == {1: 0, 2: 1, 3: 2, 4: 2, 5: 3}


def test_search_reads_the_kinds_it_has_come_to(spark, tmp_path):
    """A number is a node of its own in each kind; the search ends where no kind leads on; roots may be missing."""
    rows = [("owns", 0, 1, 1, 1), ("owns", 0, 1, 1, 2), ("makes", 1, 2, 2, 1), ("makes", 1, 2, 0, 1), ("stray", 3, 1, 3, 9)]
    e = g.write_adjacency(spark.createDataFrame(rows, "kind string, src_kind int, src long, dst_kind int, dst long"), str(tmp_path), f"edges_{uuid.uuid4().hex}", buckets=3)
    roots = spark.createDataFrame([(7, 0, 1), (8, 1, 2), (9, 2, 5)], "run_id long, node_kind int, node long")
    got = sorted(tuple(r) for r in g.reachable([e], roots, 9, str(tmp_path / "levels")).collect())
    of_7 = [(7, 0, 1, 0), (7, 1, 1, 1), (7, 1, 2, 1), (7, 2, 1, 2)]
    assert got == of_7 + [(8, 0, 1, 1), (8, 1, 1, 2), (8, 1, 2, 0), (8, 2, 1, 1), (9, 2, 5, 0)]
    assert not (tmp_path / "levels/level-4").exists()
    assert g.reachable([e], roots.limit(0), 9, str(tmp_path / "none")).count() == 0


def test_levels_do_not_shuffle_the_edges(spark, tmp_path):
    """The side of the edges comes from its buckets; only the frontier is dealt out."""
    e = spark.table(adjacency(spark, tmp_path, [("a", k, k + 1) for k in range(50)]))
    roots = spark.range(40).selectExpr("id AS run_id", "CAST(id % 1 AS INT) AS node_kind", "id AS node")
    step = roots.join(e.where("src_kind = 0").hint("merge"), roots.node == e.src)
    plan = step._jdf.queryExecution().toString().split("Physical Plan")[1]
    scan = plan.index("FileScan")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 1 and "Exchange" not in plan[plan.rindex("Sort", 0, scan) : scan]


def test_facts_by_pattern_and_by_several(spark):
    out = spark.createDataFrame([(1, 1, "L'ÉCOLE costs 30 EUR")], "doc_id long, case_id long, text string")
    rows = [(1, 1, None, "école", None, 1, True), (2, 1, None, None, ["costs", r"30\s+eur"], 2, True), (3, 1, "nothing", None, None, 1, False), (4, 1, "absent", None, None, 1, True)]
    facts = spark.createDataFrame(rows, "fact_id long, case_id long, canonical string, pattern string, required_patterns array<string>, weight int, present boolean")
    m = fx.match_facts(out, facts)
    assert {r.fact_id: r.matched for r in m.collect()} == {1: True, 2: True, 3: False, 4: False}
    assert fx.factual_score(m, ["doc_id"]).first().score == 0.75
    assert fx.per_fact_score(m, ["doc_id"]).first().score == 0.8


def test_search_ends_on_cycles(spark, tmp_path):
    e = adjacency(spark, tmp_path, [("a", 1, 2), ("a", 2, 3), ("a", 3, 1), ("a", 3, 4)])
    roots = spark.createDataFrame([(7, 0, 1)], "run_id long, node_kind int, node long")
    assert {r.node: r.hops for r in g.reachable([e], roots, 9, str(tmp_path / "levels")).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc", ["abc"]), ("ab", None), ("abc|def", ["abc", "def"]), ("abc|d", None), ("(?:abcd|xyz)+q", ["abcd", "xyz"]), ("(?:abcd)?", None), ("ab(?:cde)", ["abcde"]), ("ab(cde)", ["cde"]),
        (r"\d{3}", None), (r"total:\s+\d+ eur", ["total:"]), ("[abc]def", ["def"]), ("a(?=bcd)", None), ("(", None), (r"\Qabc\E", None), ("x(abc){2,}", ["abc"]), ("[a&&[b]]cdef", None), ("(?x)a b c d", None),
    ],
)
def test_literals_that_a_pattern_needs(pattern, want):
    assert fx.needed_literals(pattern) == want


def test_patterns_over_a_corpus_equal_a_plain_loop(spark):
    rng = random.Random(15)
    words = ["Straße", "STRASSE", "Kelvin", "\u212aelvin", "ΟΔΟΣ", "οδος", "total", "12 eur", "Total:\u00a07 EUR", "abc", "ABD", "ſtone", "stone", "x"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for k in range(120)] + [(500, None), (501, "")]
    rows = [
        (1, "straße", None, None), (2, None, "kelvin", None), (3, None, "οδοσ", None), (4, None, r"total:?\s+(?:12|7) eur", None), (5, None, None, ["stone", "ab[cd]"]), (6, None, r"\d+", None),
        (7, None, "abc|abd", None), (8, "no such", None, None), (9, None, None, None), (10, None, None, ["x", "kelvin|stone"]), (11, "x", None, None), (12, None, r"\Qabc\E", None),
    ]
    out = spark.createDataFrame(texts, "output_id long, text string")
    facts = spark.createDataFrame(rows, "fact_id long, canonical string, pattern string, required_patterns array<string>")
    got = sorted(map(tuple, fx.search(out, facts).collect()))
    want = sorted(map(tuple, out.crossJoin(facts).where(fx._found(F.col("text"))).select("output_id", "fact_id").collect()))
    assert got == want and len({f for _, f in got}) >= 9


def test_blanks_of_any_alphabet_collapse(spark):
    texts = ["  Is\u00a0it\u2003\u3000OK ?! ", "a\ufeffb\u2028c", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(sc.normalize_prompt(F.col("t")), sc.normalize_blanks(F.col("t")), fx.tokens(F.col("t"))).collect()]
    assert got == [("is it ok ", "Is it OK ?!", ["is", "it", "ok", "?!"]), ("a b c", "a b c", ["a", "b", "c"]), ("plain", "plain", ["plain"])]


def test_upsert_fills_blanks_only(spark):
    old = spark.createDataFrame([(1, "", False), (2, "kept", False)], "id long, about string, flag boolean")
    new = spark.createDataFrame([(1, "filled", True), (2, "other", True), (3, "new", False)], "id long, about string, flag boolean")
    got = sorted(map(tuple, d.upsert(old, new, ["id"], ["about"], ["flag"]).collect()))
    assert got == [(1, "filled", True), (2, "kept", True), (3, "new", False)]
