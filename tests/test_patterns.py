"""Patterns over a corpus: what they need, and that each condition is tried once."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import scalars as sc
from spanloom.operators import facts as fx

FACTS = "fact_id long, canonical string, pattern string, required_patterns array<string>"


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"[5][0-2]\.", [["50.", "51.", "52."]]), ("ab[^c]d", []), ("abc[ \t]+(?:de|f)", [["abc\t", "abc "]]), (r"ab\x{63}", [["abc"]]), (r"ab\\x{3}", [["ab\\x"]]),
        ("abc.*def|ghi", [["abc", "ghi"]]), ("abc.def", [["abc"], ["def"]]), ("(?:abc)?def", [["def"]]), (r"\Qabc\E", []), ("x(abc){2,}", [["xabc"], ["abc"]]), ("(", []), (None, []),
    ],
)
def test_sets_that_a_pattern_needs(pattern, want):
    assert [sorted(x) for x in fx.needed_sets(pattern)] == want


def test_no_pattern_of_a_spelled_blank_is_tried_on_every_text():
    found = fx.needed_sets("haha" + sc.BLANK + "+(?:the|inn)")
    assert len(found) == 2 and "haha　" in found[0] and " the" in found[1]


@pytest.mark.parametrize("in_tasks", [50_000, 0])
def test_conditions_equal_a_plain_loop(spark, monkeypatch, in_tasks):
    monkeypatch.setattr(fx, "IN_TASKS", in_tasks)
    monkeypatch.setattr(fx, "PIECE", 200)
    rng = random.Random(4)
    parts = ["straße", "STRASSE", "ẞ", "K", "kelvin", "Kelvin", "ΟΔΟΣ", "οδος", "abc", "ABD", "ſtone", " ", "  ", " ", "　", "12.", "57.", "日本語", "😀", "İx", "i̇x", "ab", "x"]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for k in range(250)] + [(500, None), (501, ""), (None, "abc 57."), (7, "straße"), (502, "x" * 900 + "abc")]
    asked = [
        ("straße", None, None), ("ẞabc", None, None), (None, r"stra[ß]e", None), (None, "kelvin", None), (None, "οδοσ", None), (None, r"[5][0-7]\.", None), (None, r"\d\.", None), (None, None, ["abc", "[1-5].\\."]),
        (None, "ab[cd]" + sc.BLANK + "+(?:12|abc)", None), (None, r"\Qabc\E", None), ("日本語", None, None), (None, "😀.{0,9}😀", None), (None, None, None), ("i̇x", None, None), (None, "stone|日本", None), (None, "", None),
        ("", None, None), (None, "abcabdabc|stonestone", None), (None, "(x)abc", None), (None, None, []),
        (None, "x.{1,2}abc", None), (None, "^abc", None), (None, r"abc\b", None), (None, "straße[^x]{0,3}(?:abc|K)+", None), (None, "(?:ab*c)?57.", None), (None, "(?=abc)abc", None), (None, r"(abc).*\1", None), (None, "ab(?-i:d)x", None),
    ]
    facts = spark.createDataFrame([(k, *x) for k, x in enumerate(asked + asked[5:9])] + [(0, "abc", None, None)], FACTS)
    out = spark.createDataFrame(texts, "output_id long, text string")
    got = sorted(map(str, map(tuple, fx.search(out, facts).collect())))
    want = out.crossJoin(facts).where(fx._found(F.col("text"))).select("output_id", "fact_id")
    assert got == sorted(map(str, map(tuple, want.collect()))) and len(got) > 500


def test_facts_that_ask_the_same_are_tried_once(spark):
    """80 facts of four conditions: four are tried, each where its literals are."""
    out = spark.range(50).select(F.col("id").alias("output_id"), F.concat(F.lit("abc 5"), F.col("id") % 10, F.lit(".")).alias("text"))
    facts = spark.createDataFrame([(k, None, rf"[{k % 4}5][0-7]\.", None) for k in range(80)], FACTS)
    written = []
    found = fx.search(out, facts, lambda df: written.append(df.persist()) or written[-1])
    assert found.count() == 40 * 80
    asked = [x for x in written if "sets" in x.columns]
    assert [x.count() for x in asked] == [4] and asked[0].where("sets is null").count() == 0


def test_all_that_a_pattern_takes_as_equal_is_folded_alike(spark):
    """Every character against its other cases and theirs, as single characters."""
    x = spark.range(128, 0x1F000).where("id < 55296 or id > 57343").select(F.col("id"), F.decode(F.expr("unhex(lpad(hex(id), 8, '0'))"), "UTF-32").alias("a")).where(F.length("a") == 1)
    cases = F.array(F.lower("a"), F.upper("a"), F.lower(F.upper("a")), F.upper(F.lower("a")), F.lower(F.upper(F.lower("a"))))
    x = x.select("a", F.explode(cases).alias("b")).where((F.length("b") == 1) & (F.col("a") != F.col("b")))
    same = F.rlike("a", F.concat(F.lit("(?iuU)"), F.col("b"))) & F.rlike("b", F.concat(F.lit("(?iuU)"), F.col("a")))
    assert x.where(same).count() > 1000
    assert [r.a for r in x.where(same & (fx.folded(F.col("a")) != fx.folded(F.col("b")))).collect()] == []
