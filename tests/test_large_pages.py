"""Pages are searched once by a site's patterns."""


def test_pages_are_searched_once_by_a_site(spark):
    from graphloom.sources import html

    p = spark.createDataFrame([(1, "u", "<h1>A</h1><article>x<br>y</article>"), (2, "u", "<h1>B</h1>"), (3, "u", None), (4, "u", "<h1></h1><article></article><time datetime='d'>")], "page_id long, url string, html string")
    out = html.articles(p)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<article[^>]*>") <= 2  # twice in one expression: the match, and the group in it
    assert {tuple(r)[:5] for r in out.collect()} == {(1, "u", "A", "x\ny", None), (4, "u", "", "", "d")}
