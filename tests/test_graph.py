"""Graph queries, traversal, merging and curation on small graphs."""

import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.operators import curation, graph, resolution, traversal, upserts
from graphloom.plans import ask


@pytest.fixture(scope="module")
def tiny(spark):
    entities = spark.createDataFrame([(n, "Company", c, []) for n, c in (("aaa", 0.9), ("bbb", 0.8), ("ccc", 0.7), ("ddd", None))], "name string, type string, confidence double, aliases array<string>")
    edges = spark.createDataFrame([("aaa", "OWNS", "bbb", 0.9, None), ("bbb", "OWNS", "ccc", 0.0, "e"), ("ccc", "OWNS", "aaa", 0.5, None), ("bbb", "RELATED_TO", "aaa", None, None)], "src string, rel_type string, dst string, confidence double, evidence string")
    mentions = spark.createDataFrame([("aaa", "p1"), ("aaa", "p0")], "entity_name string, doc_path string")
    return entities, edges, mentions


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


def test_trails(tiny):
    got = rows(traversal.neighbours(tiny[0], tiny[1], "aaa", 3), "name", "distance")
    assert got == [("aaa", 2), ("aaa", 3), ("bbb", 1), ("ccc", 2)]


def test_shortest_path(tiny, spark):
    assert rows(traversal.shortest_path(tiny[1], "aaa", "ccc")) == [(1, "aaa", "OWNS", "ccc")]
    assert rows(traversal.shortest_path(tiny[1], "aaa", "nobody")) == []
    chain = spark.createDataFrame([(f"n{i}", "R", f"n{i + 1}") for i in range(6)], "src string, rel_type string, dst string")
    assert len(rows(traversal.shortest_path(chain, "n6", "n0", 10))) == 6
    assert rows(traversal.shortest_path(chain, "n6", "n0", 5)) == []
    with pytest.raises(ValueError):
        traversal.shortest_path(chain, "a", "b", 11)


def test_detail_and_stats(tiny):
    assert graph.detail(tiny[0], tiny[2], "aaa").first()["documents"] == ["p0", "p1"]
    assert graph.detail(tiny[0], tiny[2], "bbb").first()["documents"] == []
    assert rows(graph.stats(*tiny)) == [(4, 6)]
    assert rows(graph.stats(tiny[0], tiny[1].where("false"), tiny[2].where("false"))) == [(4, 0)]


def test_search_puts_nulls_first(tiny):
    got = [r["name"] for r in graph.search(tiny[0].withColumn("name", F.concat(F.lit("Xy"), "name")), "xy").collect()]
    assert got == ["Xyddd", "Xyaaa", "Xybbb", "Xyccc"]
    with pytest.raises(ValueError):
        graph.search(tiny[0], "x")


def test_overview(tiny):
    got = rows(graph.overview(*tiny, limit=2, min_confidence=0.6), "name", "degree", "target", "edge_confidence")
    assert got == [("aaa", 5, "bbb", 0.9), ("bbb", 3, "aaa", 0.8), ("bbb", 3, "ccc", 0.8)]


def test_questions(tiny):
    assert ask.plan_question("Who owns the BBB?").args == ("BBB",)
    assert ask.plan_question("What is the relationship between A and B?").kind == "path"
    assert rows(ask.ask("who owns BBB", *tiny[:2])[1]) == [("aaa", 0.9)]
    assert len(ask.ask("relationship between aaa and ccc", *tiny[:2])[1].collect()) == 1
    with pytest.raises(ValueError):
        ask.plan_question("tell me everything that there is to know about it")


def test_upserts(spark):
    r = spark.createDataFrame([(1, "A", "Company", ["x"], 0.7, {"k": "1", "l": "1"}), (2, "A", "Bank", ["x", "y"], 0.9, {"k": "2"}), (3, "B", "Bank", None, None, None)], "ord long, name string, type string, aliases array<string>, confidence double, properties map<string,string>")
    once = upserts.upsert_entities(r)
    a = once.where("name = 'A'").first()
    assert (a["type"], a["confidence"], a["aliases"], a["properties"]) == ("Company", 0.9, ["x", "y"], {"k": "2", "l": "1"})
    again = upserts.upsert_entities(once.select(*r.columns).unionByName(r.withColumn("ord", F.col("ord") + 10)))
    assert rows(again, "name", "type", "confidence", "aliases") == rows(once, "name", "type", "confidence", "aliases")
    e = spark.createDataFrame([(2, "a", "R", "b", 0.5, "e2", "d2"), (1, "a", "R", "b", 0.4, "e1", "d1"), (3, "a", "R", "b", 0.1, None, "d3")], "ord long, src string, rel_type string, dst string, confidence double, evidence string, source_document string")
    assert rows(upserts.upsert_edges(e), "confidence", "evidence", "source_document") == [(0.5, "e1\n---\ne2", "d1")]


def test_redirect_and_absorb(tiny, spark):
    m = spark.createDataFrame([("aaa", "bbb")], "canonical string, duplicate string")
    assert rows(upserts.redirect_edges(tiny[1], m), "src", "dst") == [("aaa", "ccc"), ("ccc", "aaa")]
    got = upserts.absorb_duplicates(tiny[0], m)
    assert rows(got.where("name = 'aaa'"), "aliases") == [(["bbb"],)] and got.count() == 3
    e, x, n = upserts.detach_delete(*tiny, spark.createDataFrame([("aaa",)], "name string"))
    assert (e.count(), x.count(), n.count()) == (3, 1, 0)


def test_known_ends_and_remapping(tiny, spark):
    r = spark.createDataFrame([("aaa", "R", "old"), ("aaa", "R", "nobody")], "src string, rel_type string, dst string")
    mapped = upserts.remapped(r, spark.createDataFrame([("old", "bbb")], "old_name string, name string"))
    assert rows(upserts.with_known_ends(mapped, tiny[0]).select("src", "dst")) == [("aaa", "bbb")]


def test_case_variants(spark):
    e = spark.createDataFrame([("Star", "Company", 5), ("STAR", "Sector", 5), ("star", "Company", 1), ("Odd", "Person", 1), ("ODD", "Company", 1)], "name string, type string, connections long")
    assert rows(curation.case_variants(e)) == [("Star", "STAR"), ("Star", "star")]
    assert rows(curation.merge_report(e)) == [(1, 2, 6)]


def test_manual_merge(spark, tiny):
    rules = spark.createDataFrame([("aaa", "bbb", "Bank"), ("zzz", "ccc", "Bank")], "canonical string, duplicate string, new_type string")
    e, x = curation.manual_merge(tiny[0], tiny[1], rules)
    assert rows(e, "name", "type") == [("aaa", "Bank"), ("ccc", "Company"), ("ddd", "Company")]
    assert rows(x, "src", "dst") == [("aaa", "ccc"), ("ccc", "aaa")]


def test_resolution():
    def row(n, a=(), c=0.9):
        return {"name": n, "type": "Company", "aliases": list(a), "confidence": c}

    one = resolution.resolve_group([row("Poulina Group"), row("Poulina Group", c=0.95)])
    assert len(one) == 1 and one[0]["confidence"] == 0.95
    both = resolution.resolve_group([row("P", ["PGH"]), row("P", ["Poulina Holding"])])
    assert both[0]["aliases"] == ["PGH", "Poulina Holding"]
    assert len(resolution.resolve_group([row("red widget"), row("widget red"), row("blue")])) == 2
    assert len(resolution.resolve_group([row("Al"), row("Alpha Ltd")], known={"alpha ltd": "Al"})) == 1


def test_stars_follow_the_loop(spark):
    import random

    rng = random.Random(5)
    for _ in range(3):
        n = [f"n{i:02d}" for i in range(14)]
        pairs = [(a, b) for a, b in itertools.combinations(n, 2) if rng.random() < 0.18]
        free, want = set(n), []
        for a in n:
            if a in free:
                free.discard(a)
                for b in n:
                    if (a, b) in pairs and b in free:
                        free.discard(b)
                        want.append((a, b))
        got = resolution.stars(spark.createDataFrame(pairs, "name string, other string"), spark.createDataFrame([(x, i) for i, x in enumerate(n)], "name string, rank int"))
        assert rows(got) == sorted(want)


def test_decisions(spark):
    d = spark.createDataFrame([("A", "b", "merge", 1), ("B", "a", "separate", 2)], "entity1 string, entity2 string, decision string, ord int")
    assert rows(resolution.decision_pairs(d)) == [("a", "b", "separate")]
    p = spark.createDataFrame([("a", "B"), ("a", "C")], "entity1 string, entity2 string")
    assert rows(resolution.undecided(p, d)) == [("a", "C")]


def test_padded_names_meet(spark):
    left = spark.createDataFrame([("Bank \n          \u00a0     Amen", 0)], "name string, block int")
    right = spark.createDataFrame([("amen bank", 0), ("  Amen" + " " * 40 + "Bank ", 0)], "name string, block int")
    assert [r["score"] for r in resolution.scored_pairs(left, right, ["block"]).collect()] == [100.0, 100.0]
