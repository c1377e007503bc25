"""Column functions against hand-made values, and against plain Python."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import amounts, names, scores
from graphloom.functions.similarity import common_subsequence, cosine, token_sort_score
from graphloom.model import canonical_relation


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_normal_forms(spark):
    got = column(spark, ["Poulina Group Holding", "Groupe Poulina", "Poulina S.A.", "Poulina S.A.R.L.", "Holding", "Société X SARL", None], names.normalized)
    assert got == ["poulina", "poulina", "poulina sa", "poulina rl", "", "société x", None]
    assert column(spark, ["Poulina S.A.", "Poulina S.A.R.L."], lambda c: names.normalized(c, strict=True)) == ["poulina", "poulina"]


def test_issue_codes(spark):
    values = ["PDG", "X", "BT", "a" * 101, "Smith 2019a", "Reuters on 12 march", "one two three four five six", "investor11", "company 2", "company 2019", "Amen Bank"]
    assert column(spark, values, names.issue_of) == ["job_titles", "too_short", None, "too_long", "citations", "references", "sentence_like", "generic_numbered", "generic_numbered", "citations", None]


def test_types(spark):
    rows = [("Amen Bank", "ORG"), ("Poulina Group", "ORG"), ("Banque Group", "ORG"), ("Hassan Ali", "PER"), ("Mme Leila Trabel", "ORG"), ("Tunis", "GPE"), ("Foo", "MISC")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, l string")
    got = [r["t"] for r in df.select("i", names.entity_type(F.col("n"), F.col("l")).alias("t")).orderBy("i").collect()]
    assert got == ["Bank", "Group", "Bank", "Company", "Person", "Location", None]


def test_validity(spark):
    assert column(spark, ["CEO", "x", "Z13", "tn", "Acme", "one two of four five six", "a b c d e f", None], names.valid_mention) == [False, False, False, False, True, False, True, False]
    assert column(spark, ["board member", "Acme Corp", "a b c d e f", "company 2", "companys 2"], names.valid_extracted_name) == [False, True, False, False, True]


def test_compounds(spark):
    got = column(spark, ["Alpha and Beta", "Alpha et Beta, Gamma", "A/B", "Alone", "Alpha and x"], names.compound_parts)
    assert got == [["Alpha", "Beta"], ["Alpha", "Beta, Gamma"], ["A/B"], ["Alone"], ["Alpha"]]


def test_amounts(spark):
    assert column(spark, ["25.5%", "12,3 %", "none", None], amounts.percentage) == [25.5, 12.3, None, None]
    values = ["1,250,000 TND", "3.5 MTND", "2,5 MD", "5 MDT"]
    assert column(spark, values, amounts.amount) == [1.25, 3.5, 2_500_000.0, 5.0]
    assert column(spark, values, lambda c: amounts.amount(c, strict=True)) == [1_250_000.0, 3_500_000.0, 2_500_000.0, 5_000_000.0]
    assert column(spark, ["1,250,000 actions", "3 500 000 parts", ""], amounts.share_count) == [1_250_000, 3_500_000, None]


def test_relations(spark):
    assert column(spark, ["OWNS", "OWNED_BY", "owns", "OWNS X", "NOPE", None], canonical_relation) == ["OWNS", "OWNS", None, None, None, None]


def test_confidence(spark):
    rows = [(1, 0, False), (2, 0, False), (3, 0, False), (40, 5, False), (2, 0, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m long, r long, v boolean")
    got = [r["c"] for r in df.select("i", scores.confidence_after(F.lit(0.5), F.col("m"), F.col("r"), F.col("v")).alias("c")).orderBy("i").collect()]

    def loop(n, r, v, c=0.5):
        for k in range(2, n + 1):
            c += min(0.25, 0.05 * math.log(k + 1)) + (min(0.15, 0.03 * math.log(r + 1)) if r else 0)
            c = min(1, max(c, 0.95) if v else c)
        return c

    assert got == pytest.approx([loop(*r) for r in rows])
    assert got[1] == pytest.approx(0.554931, abs=1e-6) and got[2] == pytest.approx(0.624245, abs=1e-6)


def test_scores_of_known_pairs():
    pairs = {("Poulina Group", "Poulina Group Holding"): 76.4706, ("red widget", "widget red"): 100, ("red widget", "Red Widget"): 80, ("small ring", "small bolt"): 60, ("Banque de Tunisie", "Banque de la Tunisie"): 91.8919, ("blue bolt", "blue belt"): 55.5556}
    for (a, b), score in pairs.items():
        assert token_sort_score(a, b) == pytest.approx(score, abs=1e-4)


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert common_subsequence(a, b) == t[-1][-1] == common_subsequence(b, a)
    assert 0 <= token_sort_score(a, b) <= 100


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] == pytest.approx(2**-0.5)
