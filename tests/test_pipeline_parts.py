"""Chunks, extraction, sources, registry and streaming."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.functions.similarity import token_sort_score
from graphloom.operators import chunks, extraction, registry, resolution
from graphloom.plans import catalog
from graphloom.sources import files, financial, html
from graphloom.streaming import ingest


def lengths(spark, paras, **kw):
    df = spark.createDataFrame([(["x" * n for n in paras],)], "p array<string>")
    out = df.select(chunks.page_chunks(F.col("p"), **kw).alias("c")).first()["c"]
    return [[len(x) for x in c["text"].split("\n\n")] for c in out]


def test_page_chunks(spark):
    assert lengths(spark, [400, 500, 300, 200]) == [[400, 500], [500, 300, 200]]
    assert lengths(spark, [50]) == []
    assert lengths(spark, [60, 40]) == [[60, 40]]
    assert lengths(spark, [50, 1200, 99]) == [[50], [1201]]
    assert lengths(spark, [900, 900, 900]) == [[900], [900, 900], [900, 900]]
    assert lengths(spark, [900, 900], overlap=0) == [[900], [900]]
    assert lengths(spark, []) == []


def test_paragraphs_and_context(spark):
    df = spark.createDataFrame([("a\n b \n\n\nc",)], "t string")
    assert df.select(chunks.paragraphs(F.col("t"))).first()[0] == ["a b", "c"]
    c = spark.createDataFrame([(1, 0, "x" * 300), (1, 1, "y")], "doc_id int, chunk_index int, text string")
    got = chunks.with_context(c).orderBy("chunk_index").collect()
    assert (got[0]["before"], got[0]["after"], len(got[1]["before"]), got[1]["after"]) == ("", "y", 200, "")
    w = c.select(chunks.mention_window(F.col("text"), F.lit("y"), 3)).collect()
    assert sorted(str(r[0]) for r in w) == ["None", "y"]


def test_low_quality(spark):
    clean = "word " * 40
    cases = ["APPENDIX: List of Banks", clean, clean + "Table of contents", "." * 150 + "a" * 40, clean + "1. 2. 3. 4. 5. 6."]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    assert [r[1] for r in df.select("i", chunks.low_quality(F.col("t"))).orderBy("i").collect()] == [True, False, True, True, True]


def test_extraction(spark):
    text = "Acme Corp owns Beta Ltd. " + "filler words follow here " * 6
    c = spark.createDataFrame([(1, text), (2, "short")], "chunk_id int, text string")
    entities, relations = extraction.extracted(c, extraction.capitalized_mentions, extraction.verb_relations)
    assert [(r["source"], r["relation"], r["target"]) for r in relations.collect()] == [("Acme Corp", "OWNS", "Beta Ltd")]
    assert {"Acme Corp", "Beta Ltd"} <= {r["name"] for r in entities.collect()}


def test_json(spark):
    good = json.dumps({"entities": [{"name": " Acme ", "type": "Company"}, {"name": "CEO", "type": "Person"}, {"name": "Zed", "type": "Alien"}], "relations": [{"source": "A", "relation": "OWNED_BY", "target": "B"}, {"source": "A", "relation": "is", "target": "B"}]})
    r = extraction.parsed(spark.createDataFrame([(1, f"```json\n{good}\n```"), (2, "{oops"), (3, None)], "chunk_id int, response string"))
    assert [(x["name"], x["confidence"]) for x in extraction.given_entities(r).collect()] == [("Acme", 0.8)]
    assert [x["relation"] for x in extraction.given_relations(r).collect()] == ["OWNS"]


def test_html(spark):
    page = '<html><body><nav><a href="/x/1">One</a><a href="http://b/c/2/">Two</a></nav><article><h1>T &amp; U</h1><p>Hello <b>you</b></p><script>no()</script></article></body></html>'
    p = spark.createDataFrame([(1, "http://s/d/e", page), (2, "http://s/", "<p>none</p>")], "page_id int, url string, html string")
    a = html.articles(p).collect()
    assert [(r["title"], r["content"], r["date"]) for r in a] == [("T & U", "T & U\nHello\nyou", None)]
    assert [r["target"] for r in html.links(p, 2).collect()] == ["http://s/x/1", "http://b/c/2/"]
    assert [(r["name"], r["id"]) for r in html.companies(p, "/c/").collect()] == [("Two", "2")]
    assert html.article_files(html.articles(p), F.lit("2024-01-02")).first()["file_name"] == "2024-01-02_generic_t___u.txt"


def test_fetched_pages(spark):
    def fetch(url):
        if "bad" in url:
            raise TimeoutError
        return None if "none" in url else f"<h1>{url}</h1>"

    a = spark.createDataFrame([(1, "http://a"), (2, "http://bad"), (3, "http://none")], "page_id int, url string").coalesce(1)
    began = time.monotonic()
    got = {r["page_id"]: r["html"] for r in html.fetched(a, fetch, wait=0.3).collect()}
    assert got == {1: "<h1>http://a</h1>", 2: None, 3: None} and time.monotonic() - began >= 0.6


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"page one")
    (tmp_path / "b.txt").write_bytes(b"no")
    got = files.listed(spark, str(tmp_path)).collect()
    assert [(r["filename"], r["size"]) for r in got] == [("a.pdf", 8)]
    data = spark.createDataFrame([("p", b"x")], "path string, content binary")
    pages = files.pages(data, lambda c: F.array(F.struct(F.lit(1).alias("page_number"), c.cast("string").alias("text"))), lambda c, n: F.lit("scanned"))
    assert pages.first()["text"] == "scanned" and files.document_totals(pages).first()["total_chars"] == 7


def test_financial(spark):
    row = ("Acme", None, None, None, None, None, None, "Boss", "http://x", [("Ann", 3, None, None, "person")])
    e, r = financial.company_graph(spark.createDataFrame([row], financial.COMPANY))
    assert {(x["name"], x["confidence"]) for x in e.collect()} == {("Acme", 0.95), ("Ann", 0.9), ("Boss", 0.9)}
    got = {x["source"]: x["properties"] for x in r.collect()}
    assert got["Ann"]["share_count"] == "3" and got["Ann"]["percentage"] == "0" and got["Boss"] == {"title": "CEO"}


def test_registry(spark):
    e, a = registry.seed(spark)
    q = spark.createDataFrame([(1, "pgh", "Group"), (2, "AMEN BANK", "Bank"), (3, "Orange Tunisia Ltd", "Company"), (4, "Amen Bank", "Company"), (5, "Tunisia Orange", "Company")], "qid int, name string, entity_type string")
    got = {r["qid"]: r["tier"] for r in registry.lookup(q, e, a).collect()}
    assert got == {1: 2, 2: 1, 3: 3, 4: None, 5: 4}
    assert a.where("alias_type = 'translation'").count() > 5
    assert registry.violations(e, a).count() == 0
    known = e.withColumns({"first_doc": F.lit(None).cast("string"), "last_doc": F.lit(None).cast("string")})
    m = spark.createDataFrame([("amen bank", "Bank", "d1", 1), ("New", "Bank", "d2", 2), ("new", "Bank", "d3", 3)], "canonical_name string, entity_type string, document string, ord int")
    out = {r["canonical_name"]: r for r in registry.registered(known, m).collect()}
    assert out["Amen Bank"]["mention_count"] == 2 and out["New"]["mention_count"] == 2 and out["New"]["id"] == 14
    more = spark.createDataFrame([(8, "Amen Bank", 1), (8, "AMEN", 2), (8, "Fresh", 3), (8, "FRESH", 4), (99, "x", 5)], "entity_id long, alias_name string, ord int")
    assert [r["alias_name"] for r in registry.with_aliases(e, a, more).where("source = 'learned'").collect()] == ["Fresh"]


def test_registry_query_scores(spark, tmp_path):
    names = ["cold rod", "old rod", "cold anvil", "old anvil", "red anvil", "brass wheel", "brass wheels", "green pipe", "old rod", "brass wheel", "green pipe"]
    spark.createDataFrame([(i, n, i) for i, n in enumerate(names, 1)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["qid"]: (r["tier"], r["entity_id"]) for r in catalog.QUERIES["registry_lookup"](spark, str(tmp_path)).collect()}
    first = {n: names.index(n) + 1 for n in names}
    keys = [(i % 2, 0, i, n) for n, i in first.items()] + [(i % 2, 1, i, f"part {n}") for n, i in first.items()]
    want = {}
    for k, n in enumerate(names, 1):
        if first[n] % 2 == k % 2:
            want[k] = (1 + k % 3, first[n])
            continue
        name = (n, f"part {n}", f"{n} ltd")[k % 3]
        score, _, i = min((-token_sort_score(name, key), kind, i) for odd, kind, i, key in keys if odd == k % 2)
        want[k] = (4, i) if -score >= 85 else (None, None)
    assert got == want and 4 in {t for t, _ in want.values()} and None in {t for t, _ in want.values()}


@pytest.mark.parametrize("threshold", [60.0, 70.0, 85.0, 95.0])
def test_scored_pairs_by_brute_force(spark, threshold):
    rng = random.Random(int(threshold))
    letters = ["ab", "abcdef ", "aé bank"]
    names_ = {"".join(rng.choices(rng.choice(letters), k=rng.randrange(1, 24))) for _ in range(120)} | {"", " ", "x", "Acme  Corp", "corp acme", "ACME\tCORP", "Acme Corp Ltd", "a b c d e f g h", "h g f e d c b a"}
    for n in sorted(names_)[:60]:
        w = list(n)
        for _ in range(rng.randrange(3)):
            if w and rng.random() < 0.5:
                del w[rng.randrange(len(w))]
            else:
                w.insert(rng.randrange(len(w) + 1), rng.choice("abc "))
        names_.add("".join(w))
    rows = sorted(names_)
    left = spark.createDataFrame([(n, i % 2, i) for i, n in enumerate(rows)], "name string, block int, id int")
    right = spark.createDataFrame([(n, i % 2, i) for i, n in enumerate(rows) for _ in range(1 + (i == 5))], "name string, block int, place int")
    got = Counter((r["id"], r["other_place"], round(r["score"], 9)) for r in resolution.scored_pairs(left, right, ["block"], threshold).collect())
    want = Counter()
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            score = token_sort_score(x.lower(), y.lower())
            if i % 2 == j % 2 and score >= threshold:
                want[i, j, round(score, 9)] += 1 + (j == 5)
    assert got == want


def test_best_vectors_in_parts(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(60)] + [(60, 0, None), (61, 1, [0.0, 0.0, 0.0]), (62, 7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, block int, vector array<double>")

    def cos(x, y):
        return round(sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5, 9)

    want = {}
    for i, b, x in rows:
        near = [(-cos(x, y), j) for j, c, y in rows if x and y and any(x) and any(y) and b == c and i != j]
        if near and -min(near)[0] >= 0.2:
            want[i] = (min(near)[1], -min(near)[0])
    for together in (7, 2048):
        got = {r["id"]: (r["best_id"], round(r["similarity"], 9)) for r in resolution.best_by_vector(df, df, 0.2, together).collect()}
        assert got == want


def test_streamed_upserts(spark, tmp_path):
    rows = [[(1, "A", "Company", ["x"], 0.5, {"k": "1"})], [(2, "A", "Bank", ["y"], 0.9, {"k": "2"}), (3, "B", "Bank", [], 0.1, {})]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, ingest.ROWS).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    ingest.ingest(spark, str(tmp_path / "in/*"), str(tmp_path / "table"), str(tmp_path / "ck"), files_per_batch=1).awaitTermination(120)
    last = sorted((tmp_path / "table").iterdir(), key=lambda p: int(p.name.split("=")[1]))[-1]
    got = {r["name"]: r for r in spark.read.parquet(str(last)).collect()}
    assert got["A"]["confidence"] == 0.9 and set(got["A"]["aliases"]) == {"x", "y"} and set(got) == {"A", "B"}


def test_providers(spark):
    calls = extraction.model_relations(lambda p: '{"entities": [], "relations": []}' if "Acme" in p else 1 / 0, wait=0)
    c = spark.createDataFrame([(1, "Acme"), (2, "Beta")], "chunk_id int, text string")
    assert {r["chunk_id"]: r["response"] is None for r in calls(c).collect()} == {1: False, 2: True}

    def slow(_):
        raise TimeoutError

    assert extraction._completed(slow, "x", 2, 0) is None
    assert extraction.by_language({"fr": extraction.capitalized_mentions}, "en-GB") is extraction.capitalized_mentions
    assert extraction.by_language({}, "en")(c).count() == 0
    g = extraction.gazetteer_mentions(spark.createDataFrame([("Acme", "ORG")], "name string, label string"))
    assert [(r["chunk_id"], r["mention"]) for r in g(c).collect()] == [(1, "Acme")]


def test_hosted_model():
    """Headers tell what is left; a refusal for too many requests leaves the response null; no answer means no models."""
    answers = [(200, {"X-RateLimit-Remaining": "7", "x-ratelimit-reset": "90000"}, {"choices": [{"message": {"content": "{}"}}]}), (429, {"x-ratelimit-remaining": "0"}, {}), (200, {"x-ratelimit-remaining": "?"}, {"data": [{"id": "a"}, {"id": "b"}]}), (500, {}, {})]
    asked = []

    def transport(method, path, body):
        asked.append((method, path, body))
        if not answers:
            raise ConnectionError
        return answers.pop(0)

    m = extraction.HostedModel(transport, "some-model")
    assert m("read this") == "{}" and m.rate_limit() == {"remaining": 7, "reset": 90.0}
    assert asked[0][2]["messages"][0]["content"] == extraction.system_prompt() and "OWNS_SHARES" in extraction.system_prompt() and "Person" in extraction.system_prompt()
    with pytest.raises(extraction.RateLimited) as e:
        m("more")
    assert e.value.reset == 90.0 and m.remaining == 0
    assert m.models() == ["a", "b"] and not m.available() and not m.available() and m.models() == []
    answers.append((429, {}, {}))
    assert extraction._completed(m, "x", 0, 0) is None


def test_resolution_by_known_aliases_and_vectors(spark):
    rows = spark.createDataFrame([(1, 0, "Poulina Group", "Group", [], 0.8), (1, 1, "PGH", "Group", [], 0.9), (1, 2, "the poultry firm", "Company", [], 0.7), (1, 3, "Other", "Company", [], 0.7)], "chunk_id int, pos int, name string, type string, aliases array<string>, confidence double")

    def embed(names_):
        return [[1.0, 0.1] if "Poul" in n or "poul" in n else [0.0, 1.0] for n in names_]

    got = [(r["name"], r["aliases"], r["confidence"]) for r in resolution.resolved(rows, known={"pgh": "Poulina Group"}, embed=embed).collect()]
    assert got == [("Poulina Group", ["PGH", "the poultry firm"], 0.9), ("Other", [], 0.7)]
    assert len(resolution.resolved(rows).collect()) == 4


def test_providers_get_context_and_names(spark):
    from graphloom.plans.ingest import ingest as run

    seen = []

    def primary(c):
        seen.append(c.columns)
        rows_ = c.select("chunk_id", "names", "before", "after").collect()
        seen.append({r["chunk_id"]: (r["names"], bool(r["before"]), bool(r["after"])) for r in rows_})
        return extraction.verb_relations(c)

    line = "Beta Ltd owns Acme Corp" + " and many words follow in this line" * 20
    other = "Delta Inc owns Acme Corp and Beta Ltd" + " and many other words come in here" * 20
    pages = spark.createDataFrame([("d", 1, line + "\n\n" + other)], "doc_id string, page_number int, text string")
    graph = spark.createDataFrame([("Nothing", [], 1)], "name string, aliases array<string>, ord long")
    out = run(pages, graph, extraction.capitalized_mentions, primary)
    assert seen[1]["d#0"] == (["Beta Ltd", "Acme Corp"], False, True)
    assert {r["name"] for r in out.entities.collect()} == {"Beta Ltd", "Acme Corp", "Delta Inc"}


def test_reprocessing_resolves_over_documents(spark):
    from graphloom.plans.ingest import reprocess

    first = "Acme Corp owns Beta Ltd" + " and many words follow in this line" * 28
    second = "ACME CORP acquired Gamma Inc" + " and many other words come in here" * 28
    pages = spark.createDataFrame([("d", 1, first + "\n\n" + second)], "doc_id string, page_number int, text string")
    out = reprocess(pages, extraction.capitalized_mentions, extraction.verb_relations)
    assert {r["name"] for r in out.entities.collect()} == {"Acme Corp", "Beta Ltd", "Gamma Inc"}
    assert {(r["src"], r["rel_type"], r["dst"]) for r in out.edges.collect()} == {("Acme Corp", "OWNS", "Beta Ltd"), ("Acme Corp", "ACQUIRED", "Gamma Inc")}


def test_ingest(spark):
    from graphloom.plans.ingest import ingest as run

    filler = " and filler words follow here" * 6
    pages = spark.createDataFrame([("d1", 1, f"Acme Corp owns Beta Ltd.{filler}"), ("d2", 1, f"ACME CORP acquired Gamma Inc.{filler}")], "doc_id string, page_number int, text string")
    graph = spark.createDataFrame([("Acme Corporation", ["acme corp"], 1)], "name string, aliases array<string>, ord long")
    out = run(pages, graph, extraction.capitalized_mentions, extraction.verb_relations)
    assert {"Acme Corporation", "Beta Ltd", "Gamma Inc"} <= {r["name"] for r in out.entities.collect()}
    assert {(r["src"], r["rel_type"], r["dst"]) for r in out.edges.collect()} == {("Acme Corporation", "OWNS", "Beta Ltd"), ("Acme Corporation", "ACQUIRED", "Gamma Inc")}
    assert {(r["entity_name"], r["doc_path"]) for r in out.mentions.collect()} >= {("Acme Corporation", "d1"), ("Acme Corporation", "d2")}
    assert out.totals.first()["chunks"] == 2 and out.documents.count() == 2
