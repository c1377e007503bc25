"""The registered queries of the graph engine, and equivalent SQL for an independent engine.

Each query runs its operator over whole tables; limits stand where they are the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, names, scores, similarity
from ..model import RELATION_ALIASES, RELATION_TYPES, canonical_relation
from ..operators import chunks, curation, extraction, graph, registry, resolution, traversal, upserts
from ..sources import financial, html
from . import ask, demo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FIRM, FIRM2, PERSON, PLACE = "Supplier#000000005", "Supplier#000000002", "Customer#000000001", "NATION_1"
G = "WITH " + demo.GRAPH_SQL
ALL_SQL = ", all_edges AS (SELECT src, rel_type, dst, confidence FROM edges UNION ALL SELECT entity_name, 'MENTIONED_IN', 'doc:' || doc_path, NULL FROM mentions)"
NAMED = "(lower(name) = lower('{0}') OR len(list_filter(aliases, lambda a: lower(a) = lower('{0}'))) > 0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the graph


@query(G + "SELECT name, type, confidence FROM entities WHERE contains(lower(name), 'customer') AND type = 'Person' ORDER BY confidence DESC, name LIMIT 25")
def entity_search(spark, sf_dir):
    return graph.search(demo.entities(spark, sf_dir), "Customer", "Person", 25)


@query(G + f"SELECT name, type, confidence, (SELECT count(*) FROM mentions WHERE entity_name = name) AS n_documents, (SELECT string_agg(doc_path, ' ' ORDER BY doc_path) FROM mentions WHERE entity_name = name) AS documents FROM entities WHERE name = '{FIRM}'")
def entity_detail(spark, sf_dir):
    d = graph.detail(demo.entities(spark, sf_dir), demo.mentions(spark, sf_dir), FIRM)
    return d.select("name", "type", "confidence", F.size("documents").cast("long").alias("n_documents"), F.array_join("documents", " ").alias("documents"))


@query(G + f"""
SELECT DISTINCT rel_type, dst AS target, m.type AS target_type, e.confidence, evidence, NULL::VARCHAR AS source, NULL::VARCHAR AS source_type FROM edges e JOIN entities m ON m.name = dst WHERE src = '{FIRM}'
UNION SELECT DISTINCT rel_type, NULL, NULL, e.confidence, evidence, src, m.type FROM edges e JOIN entities m ON m.name = src WHERE dst = '{FIRM}'""")
def entity_relationships(spark, sf_dir):
    return graph.relationships(demo.entities(spark, sf_dir), demo.edges(spark, sf_dir), FIRM)


@query(G + ALL_SQL + " SELECT (SELECT count(*) FROM entities) AS entity_count, (SELECT count(*) FROM all_edges) AS relationship_count")
def graph_stats(spark, sf_dir):
    return graph.stats(demo.entities(spark, sf_dir), demo.edges(spark, sf_dir), demo.mentions(spark, sf_dir))


@query(G + f"SELECT src AS owner, confidence FROM edges WHERE rel_type = 'OWNS' AND dst IN (SELECT name FROM entities WHERE {NAMED.format('c5')})")
def who_owns(spark, sf_dir):
    return ask.ask("Who owns the C5?", demo.entities(spark, sf_dir), demo.edges(spark, sf_dir))[1]


@query(G + f"""
SELECT DISTINCT m.name, m.type, rel_type FROM (SELECT src AS a, dst AS b, rel_type FROM edges UNION ALL SELECT dst, src, rel_type FROM edges) x JOIN entities m ON m.name = b
WHERE m.type IN ('Company', 'Group', 'Bank') AND a IN (SELECT name FROM entities WHERE {NAMED.format(FIRM2)})""")
def linked_companies(spark, sf_dir):
    return ask.ask(f"What companies are linked to {FIRM2.lower()}?", demo.entities(spark, sf_dir), demo.edges(spark, sf_dir))[1]


@query(G + "SELECT e.src AS name, p.type, e.dst AS sector FROM edges e JOIN entities p ON p.name = e.src JOIN entities s ON s.name = e.dst WHERE rel_type = 'OPERATES_IN' AND contains(lower(s.name), 'nation_1')")
def operates_in(spark, sf_dir):
    return ask.ask("What groups operate in nation_1?", demo.entities(spark, sf_dir), demo.edges(spark, sf_dir))[1]


@query(G + "SELECT DISTINCT a.dst AS company1, b.dst AS company2, a.src AS person FROM edges a JOIN edges b ON a.src = b.src AND a.dst <> b.dst WHERE a.rel_type = 'DIRECTOR_OF' AND b.rel_type = 'DIRECTOR_OF'")
def shared_directors(spark, sf_dir):
    return graph.shared_directors(demo.edges(spark, sf_dir), None)


TRAILS_SQL = """
, ids AS (SELECT row_number() OVER () AS edge, src, dst FROM (SELECT DISTINCT src, rel_type, dst FROM edges))
, t AS (
  SELECT dst AS node, [edge] AS trail, 1 AS distance FROM ids WHERE src = '{0}'
  UNION ALL SELECT ids.dst, list_append(trail, ids.edge), distance + 1 FROM t JOIN ids ON ids.src = node WHERE distance < {1} AND NOT list_contains(trail, ids.edge)
)"""


@query(G.replace("WITH", "WITH RECURSIVE") + TRAILS_SQL.format(PERSON, 4) + " SELECT DISTINCT name, type, distance FROM t JOIN entities ON name = node")
def neighbors_k(spark, sf_dir):
    return traversal.neighbours(demo.entities(spark, sf_dir), demo.edges(spark, sf_dir), PERSON, 4)


@query(G.replace("WITH", "WITH RECURSIVE") + f"""
, ids AS (SELECT row_number() OVER () AS edge, src, rel_type, dst, confidence FROM edges)
, ends AS (SELECT src AS a, dst AS b, edge FROM ids UNION ALL SELECT dst, src, edge FROM ids WHERE src <> dst)
, t AS (
  SELECT b AS node, [edge] AS trail, 1 AS d FROM ends WHERE a = '{FIRM}'
  UNION ALL SELECT b, list_append(trail, ends.edge), d + 1 FROM t JOIN ends ON a = node WHERE d < 2 AND NOT list_contains(trail, ends.edge)
), good AS (SELECT name FROM entities WHERE confidence >= 0.6), used AS (
  SELECT DISTINCT unnest(trail) AS edge FROM t WHERE node IN (SELECT name FROM good WHERE length(name) > 2 AND length(name) < 100)
)
SELECT src, rel_type, dst, confidence FROM ids WHERE edge IN (SELECT edge FROM used) AND src IN (SELECT name FROM good) AND dst IN (SELECT name FROM good)""")
def neighborhood_edges(spark, sf_dir):
    return traversal.neighbourhood(demo.entities(spark, sf_dir), demo.edges(spark, sf_dir), FIRM, 2, 2_000_000_000)


def _path_sql(start: str, goal: str, depth: int, edges: str = "edges") -> str:
    """The least of the shortest paths: distances from the goal, then at each hop the least node that is one step nearer."""
    return G.replace("WITH", "WITH RECURSIVE") + ALL_SQL + f"""
, ends AS (SELECT DISTINCT a, rel_type, b FROM (SELECT src AS a, rel_type, dst AS b FROM {edges} UNION ALL SELECT dst, rel_type, src FROM {edges}))
, t AS (SELECT '{goal}' AS node, 0 AS d UNION SELECT a, d + 1 FROM t JOIN ends ON b = node WHERE d < {depth})
, far AS (SELECT node, min(d) AS d FROM t GROUP BY node)
, nearer AS (
  SELECT a, rel_type, b, row_number() OVER (PARTITION BY a ORDER BY b, rel_type) AS k FROM ends JOIN far x ON x.node = a JOIN far y ON y.node = b WHERE y.d = x.d - 1
), p AS (
  SELECT 1 AS hop, a AS source, rel_type, b AS target FROM nearer WHERE a = '{start}' AND k = 1
  UNION ALL SELECT hop + 1, a, n.rel_type, b FROM p JOIN nearer n ON n.a = p.target AND n.k = 1
)
SELECT hop, source, rel_type, target FROM p"""


@query(_path_sql(PERSON, "AFRICA", 5))
def shortest_path_hops(spark, sf_dir):
    return traversal.shortest_path(demo.edges(spark, sf_dir), PERSON, "AFRICA")


@query(_path_sql(PERSON, "NATION_7", 6, "all_edges"))
def document_path(spark, sf_dir):
    """A path that may lead over documents that name two entities."""
    return traversal.shortest_path(demo.edges(spark, sf_dir), PERSON, "NATION_7", 6, demo.mentions(spark, sf_dir))


@query(_path_sql(PERSON, FIRM, 3))
def relationship_question(spark, sf_dir):
    return ask.ask(f"Show the relationships between {PERSON.lower()} and c5?", demo.entities(spark, sf_dir), demo.edges(spark, sf_dir))[1]


@query(G + "SELECT DISTINCT a.dst AS company1, b.dst AS company2, a.src AS person FROM edges a JOIN edges b ON a.src = b.src AND a.dst <> b.dst WHERE a.rel_type = 'DIRECTOR_OF' AND b.rel_type = 'DIRECTOR_OF' ORDER BY 1, 2, 3 LIMIT 50")
def directors_question(spark, sf_dir):
    return ask.ask("Which companies have shared directors?", demo.entities(spark, sf_dir), demo.edges(spark, sf_dir))[1]


@query(G + "SELECT name, type, confidence FROM entities WHERE contains(lower(name), 'supplier#00000000') ORDER BY confidence DESC, name LIMIT 10")
def search_question(spark, sf_dir):
    return ask.ask("the Supplier#00000000?", demo.entities(spark, sf_dir), demo.edges(spark, sf_dir))[1]


OVERVIEW_SQL = ALL_SQL + """
, degree AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM all_edges UNION ALL SELECT dst FROM all_edges WHERE src <> dst) GROUP BY name)
, top AS (
  SELECT e.name, type, confidence, degree FROM entities e JOIN degree USING (name)
  WHERE confidence >= 0.6 AND length(e.name) > 2 AND length(e.name) < 100 ORDER BY degree DESC, confidence DESC, e.name LIMIT 300
), certain AS (
  SELECT src, rel_type, dst AS target, m.type AS target_type, m.confidence AS target_confidence, coalesce(nullif(e.confidence, 0), 0.8e0) AS edge_confidence
  FROM edges e JOIN entities m ON m.name = e.dst WHERE m.confidence >= 0.6
), view AS (
  SELECT top.name, top.type, top.confidence, degree, x.rel_type, x.target, x.target_type, x.target_confidence,
         x.edge_confidence
  FROM top LEFT JOIN certain x ON x.src = top.name
)"""


@query(G + OVERVIEW_SQL + " SELECT * FROM view")
def overview_edges(spark, sf_dir):
    return graph.overview(demo.entities(spark, sf_dir), demo.edges(spark, sf_dir), demo.mentions(spark, sf_dir), 300)


@query(G + OVERVIEW_SQL + " SELECT DISTINCT id, type, confidence FROM (SELECT name AS id, type, confidence FROM view UNION ALL SELECT target, target_type, target_confidence FROM view WHERE target IS NOT NULL)")
def overview_nodes(spark, sf_dir):
    return graph.overview_nodes(overview_edges(spark, sf_dir))


@query(G + """
, top AS (SELECT name, type, confidence FROM entities WHERE type = 'Company' AND confidence >= 0.7 AND length(name) > 2 ORDER BY confidence DESC, name LIMIT 50)
, near AS (
  SELECT a, rel_type, b AS neighbour, m.type AS neighbour_type, x.confidence AS edge_confidence
  FROM (SELECT src AS a, dst AS b, rel_type, confidence FROM edges UNION ALL SELECT dst, src, rel_type, confidence FROM edges WHERE src <> dst) x JOIN entities m ON m.name = b WHERE m.confidence >= 0.7
)
SELECT top.name, top.type, top.confidence, rel_type, neighbour, neighbour_type, edge_confidence FROM top LEFT JOIN near ON a = top.name""")
def by_type(spark, sf_dir):
    return graph.by_type(demo.entities(spark, sf_dir), demo.edges(spark, sf_dir), "Company")


@query(G + ALL_SQL + " SELECT name, count(*) AS degree FROM (SELECT src AS name FROM all_edges UNION ALL SELECT dst FROM all_edges WHERE src <> dst) WHERE NOT starts_with(name, 'doc:') GROUP BY name")
def degree(spark, sf_dir):
    return graph.degree(graph.all_edges(demo.edges(spark, sf_dir), demo.mentions(spark, sf_dir))).where(~F.col("name").startswith("doc:"))


@query(G + "SELECT rel_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM edges WHERE confidence >= 0.75 GROUP BY rel_type")
def raw_sql(spark, sf_dir):
    graph.register_views(demo.entities(spark, sf_dir), demo.edges(spark, sf_dir), demo.mentions(spark, sf_dir))
    return spark.sql("SELECT rel_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM edges WHERE confidence >= :least GROUP BY rel_type", args={"least": 0.75})


# ---- merging


def _entity_rows(spark, sf_dir):
    """Customers seen once an order: the type differs with the order, aliases and confidence too."""
    o = _table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "Person").otherwise("Organization")
    props = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.concat(F.lit("k"), F.col("o_orderkey") % 3), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), F.col("o_custkey")).alias("name"), kind.alias("type"), F.array(F.concat(F.lit("a"), F.col("o_orderkey") % 5)).alias("aliases"), ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"), props.alias("properties"))


@query("""
WITH r AS (SELECT o_orderkey AS ord, 'c' || o_custkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'Person' ELSE 'Organization' END AS type, 'a' || (o_orderkey % 5) AS alias, (o_orderkey % 100) / 100e0 AS confidence, o_orderstatus AS s, o_orderkey % 3 AS k, o_orderpriority AS p FROM orders),
al AS (SELECT name, string_agg(alias, ',' ORDER BY o) AS aliases FROM (SELECT name, alias, min(ord) AS o FROM r GROUP BY ALL) GROUP BY name)
SELECT r.name, arg_min(type, ord) AS type, max(confidence) AS confidence, any_value(al.aliases) AS aliases, arg_max(s, ord) AS status, arg_max(p, ord) FILTER (k = 0) AS k0, min(ord) AS ord FROM r JOIN al ON r.name = al.name GROUP BY r.name""")
def entity_upsert(spark, sf_dir):
    out = upserts.upsert_entities(_entity_rows(spark, sf_dir))
    return out.select("name", "type", "confidence", F.array_join("aliases", ",").alias("aliases"), F.try_element_at("properties", F.lit("status")).alias("status"), F.try_element_at("properties", F.lit("k0")).alias("k0"), "ord")


@query("""
SELECT 'c' || o_custkey AS src, 'OWNS_SHARES' AS rel_type, 's' || l_suppkey AS dst, max(l_discount) AS confidence, string_agg('o' || l_orderkey || '.' || l_linenumber, chr(10) || '---' || chr(10) ORDER BY l_orderkey * 10 + l_linenumber) AS evidence,
       arg_min('order_' || l_orderkey, l_orderkey * 10 + l_linenumber) AS source_document, min(l_orderkey * 10 + l_linenumber) AS ord
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""")
def edge_upsert(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.lit("OWNS_SHARES").alias("rel_type"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), F.col("l_discount").alias("confidence"), F.concat(F.lit("o"), F.col("l_orderkey"), F.lit("."), F.col("l_linenumber")).alias("evidence"), F.concat(F.lit("order_"), F.col("l_orderkey")).alias("source_document"))
    return upserts.upsert_edges(rows)


@query("SELECT source AS path, arg_min('chunk_' || doc_id, doc_id) AS chunk_id FROM documents GROUP BY source")
def document_upsert(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return upserts.upsert_documents(d.select(F.col("doc_id").alias("ord"), F.col("source").alias("path"), F.concat(F.lit("chunk_"), F.col("doc_id")).alias("chunk_id")))


def _doomed(spark, sf_dir):
    return demo.entities(spark, sf_dir).where("type = 'Person' AND confidence < 0.7").select("name")


@query(G + ", doomed AS (SELECT name FROM entities WHERE type = 'Person' AND confidence < 0.7) SELECT src, rel_type, dst, confidence FROM edges WHERE src NOT IN (SELECT name FROM doomed) AND dst NOT IN (SELECT name FROM doomed)")
def detach_delete(spark, sf_dir):
    e = demo.entities(spark, sf_dir)
    return upserts.detach_delete(e, demo.edges(spark, sf_dir), demo.mentions(spark, sf_dir), _doomed(spark, sf_dir))[1].select("src", "rel_type", "dst", "confidence")


def _supplier_mapping(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 1").select("s_name", (F.col("s_suppkey") - 1).alias("k"))
    to = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("canonical"))
    return s.join(to, "k").select("canonical", F.col("s_name").alias("duplicate"))


MAPPING_SQL = ", mapping AS (SELECT b.s_name AS canonical, a.s_name AS duplicate FROM supplier a JOIN supplier b ON a.s_suppkey - 1 = b.s_suppkey WHERE a.s_suppkey % 3 = 1)"


@query(G + MAPPING_SQL + """
SELECT src, rel_type, dst, confidence, evidence FROM (
  SELECT coalesce(a.canonical, src) AS src, rel_type, coalesce(b.canonical, dst) AS dst, confidence, evidence, a.canonical IS NOT NULL OR b.canonical IS NOT NULL AS moved
  FROM edges LEFT JOIN mapping a ON a.duplicate = src LEFT JOIN mapping b ON b.duplicate = dst
) WHERE src <> dst OR NOT moved""")
def redirect_edges(spark, sf_dir):
    return upserts.redirect_edges(demo.edges(spark, sf_dir), _supplier_mapping(spark, sf_dir))


@query(G + MAPPING_SQL + """
SELECT e.name, e.type, e.confidence, CASE WHEN m.canonical IS NULL THEN array_to_string(e.aliases, ',') ELSE array_to_string(list_concat(e.aliases, list_sort([m.duplicate, d.aliases[1]])), ',') END AS aliases
FROM entities e LEFT JOIN mapping m ON m.canonical = e.name LEFT JOIN entities d ON d.name = m.duplicate WHERE e.name NOT IN (SELECT duplicate FROM mapping)""")
def absorb_duplicates(spark, sf_dir):
    out = upserts.absorb_duplicates(demo.entities(spark, sf_dir), _supplier_mapping(spark, sf_dir))
    return out.select("name", "type", "confidence", F.array_join("aliases", ",").alias("aliases"))


# ---- texts


def _chunks(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))
    return chunks.chunked(d, chunks.lines_as_paragraphs(F.col("text")))


@query("""
WITH RECURSIVE s AS (
  SELECT doc_id, pos, trim(p, ' ' || chr(9) || chr(10) || chr(13)) || '.' AS s FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), '.')) AS p, unnest(range(len(string_split(coalesce(text, ''), '.')))) AS pos FROM documents)
  WHERE trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> ''
), n AS (SELECT doc_id, s, length(s) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM s
), f AS (
  SELECT doc_id, i, s, len AS size, 0 AS chunk FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, n.s, CASE WHEN f.size + n.len > 1000 THEN n.len ELSE f.size + n.len END, CASE WHEN f.size + n.len > 1000 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1
)
SELECT doc_id, chunk AS chunk_index, md5(string_agg(s, ' ' ORDER BY i)) AS text_md5, length(string_agg(s, ' ' ORDER BY i)) AS char_count FROM f GROUP BY doc_id, chunk""")
def sentence_chunks(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.sentence_chunks(F.coalesce("text", F.lit("")))).alias("chunk_index", "text"))
    return d.select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("char_count"))


_DIGITS = " + ".join(f"(contains(text, '{i}.') OR contains(text, ' {i} '))::INTEGER" for i in range(10))
_MARKS = " OR ".join(f"contains(lower(text), '{m}')" for m in chunks.CONTENTS_MARKS)


@query(rf"""
SELECT doc_id, length(text) < 100 OR {_MARKS} OR length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) < length(text) * 0.5e0 OR ({_DIGITS}) > 5 AS low_quality FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def low_quality_chunks(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", chunks.low_quality(F.coalesce("text", F.lit(""))).alias("low_quality"))


def _html_sql(pattern: str, between: str) -> str:
    bare = rf"regexp_replace(regexp_extract(html, '{pattern}', 1), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"
    pieces = rf"list_filter(list_transform(string_split(regexp_replace({bare}, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
    out = f"array_to_string({pieces}, {between})"
    for name, char in html.ENTITIES:
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return out


@query(rf"""
SELECT page_id, url, {_html_sql('(?is)<h1[^>]*>(.*?)</h1>', "''")} AS title, md5({_html_sql('(?is)<article[^>]*>(.*?)</article>', 'chr(10)')}) AS content_md5, NULL::VARCHAR AS date, 'generic' AS source
FROM pages WHERE regexp_matches(html, '(?is)<h1[^>]*>(.*?)</h1>') AND regexp_matches(html, '(?is)<article[^>]*>(.*?)</article>')""")
def html_articles(spark, sf_dir):
    a = html.articles(_table(spark, sf_dir, "pages"))
    return a.select("page_id", "url", "title", F.md5("content").alias("content_md5"), "date", "source")


@query(r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["'']([^"''#]+)', 1)) AS href FROM pages),
r AS (SELECT page_id, href, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, regexp_extract(url, '^(https?://[^?#]*/)', 1) AS base, regexp_extract(url, '^(https?:)', 1) AS scheme FROM l)
SELECT page_id, href, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN root || href ELSE CASE WHEN base = '' THEN root || '/' ELSE base END || href END AS target FROM r""")
def page_links(spark, sf_dir):
    return html.links(_table(spark, sf_dir, "pages")).select("page_id", "href", "target")


@query("SELECT source, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    return html.source_counts(_table(spark, sf_dir, "documents"))


@query(r"""
SELECT page_id, concat_ws('_', '2024-01-01', 'generic', lower(regexp_replace(left(t, 50), '[^\p{L}\p{N}]', '_', 'g'))) || '.txt' AS file_name FROM (
""" + rf"SELECT page_id, {_html_sql('(?is)<h1[^>]*>(.*?)</h1>', chr(39) * 2)} AS t FROM pages WHERE regexp_matches(html, '(?is)<article')" + ")")
def article_names(spark, sf_dir):
    a = html.articles(_table(spark, sf_dir, "pages"))
    files = html.article_files(a, F.lit("2024-01-01"))
    return a.select("page_id", F.concat(F.concat_ws("_", F.coalesce("date", F.lit("2024-01-01")), "source", names.slug(F.col("title"))), F.lit(".txt")).alias("file_name")) if files.columns == ["file_name", "body"] else files


# ---- names


#: Names in many shapes, from the parts and from numbers.
NAMES_SQL = """names AS (
  SELECT p_partkey AS id, CASE p_partkey % 12
    WHEN 0 THEN p_name || ' SA' WHEN 1 THEN p_name || ' SARL' WHEN 2 THEN upper(p_name) || ' Holding' WHEN 3 THEN 'Groupe ' || p_name WHEN 4 THEN p_name || ' Bank'
    WHEN 5 THEN p_name || ' ' || (1900 + p_partkey % 100) WHEN 6 THEN 'company ' || p_partkey WHEN 7 THEN 'CEO' WHEN 8 THEN 'x' || p_partkey WHEN 9 THEN p_name || ' and ' || p_brand
    WHEN 10 THEN p_name || ' sold in the town of ' || p_brand ELSE 'Mme ' || p_name END AS name,
    CASE p_partkey % 4 WHEN 0 THEN 'ORG' WHEN 1 THEN 'PER' WHEN 2 THEN 'LOC' ELSE 'MISC' END AS label FROM part
)"""


def _names(spark, sf_dir):
    p, k, n = _table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_name")
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    shapes = [t(n, " SA"), t(n, " SARL"), t(F.upper(n), " Holding"), t("Groupe ", n), t(n, " Bank"), t(n, " ", 1900 + k % 100), t("company ", k), F.lit("CEO"), t("x", k), t(n, " and ", F.col("p_brand")), t(n, " sold in the town of ", F.col("p_brand")), t("Mme ", n)]
    label = F.element_at(F.array(*map(F.lit, ("ORG", "PER", "LOC", "MISC"))), (k % 4 + 1).cast("int"))
    return p.select(k.alias("id"), F.element_at(F.array(*shapes), (k % 12 + 1).cast("int")).alias("name"), label.alias("label"))


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_SPACES = "length(name) - length(replace(name, ' ', ''))"
_DATED = r"\b(in|on|from)\s+\d+\s+(" + "|".join(names.MONTHS) + ")"


@query(rf"""
WITH {NAMES_SQL}
SELECT id, NOT (length(name) < 2 OR length(name) > 100 OR lower(name) IN ({_quoted(names.JOB_TITLES)}) OR regexp_matches(name, '^[\p{{L}}\p{{N}}_\s]+ \d{{4}}[a-z]?$') OR ({_SPACES} >= 5 AND ({" OR ".join(f"contains(lower(name), '{w}')" for w in names.SENTENCE_WORDS)}))
  OR regexp_matches(lower(name), '{_DATED}') OR regexp_matches(lower(name), '^(company|investor|shareholders?|entity)\s*\d+$') OR regexp_matches(lower(name), '^[a-z]\d+$') OR lower(name) IN ({_quoted(names.DOMAINS)})) AS valid_mention,
  NOT (length(name) < 2 OR length(name) > 100 OR lower(name) IN ({_quoted(names.EXTRACTED_JOB_TITLES)}) OR {_SPACES} >= 5 OR regexp_matches(name, '^[\p{{L}}\p{{N}}_\s]+ \d{{4}}[a-z]?$') OR regexp_matches(lower(name), '^(company|investor|shareholder|entity)\s*\d+$')) AS valid_extracted
FROM names""")
def name_validity(spark, sf_dir):
    return _names(spark, sf_dir).select("id", names.valid_mention(F.col("name")).alias("valid_mention"), names.valid_extracted_name(F.col("name")).alias("valid_extracted"))


@query(rf"""
WITH {NAMES_SQL}
SELECT id, CASE WHEN {" OR ".join(f"contains(lower(name), '{w}')" for w in names.COMPANY_WORDS)}
  THEN CASE WHEN contains(lower(name), 'bank') OR contains(lower(name), 'banque') THEN 'Bank' WHEN contains(lower(name), 'group') THEN 'Group' ELSE 'Company' END
  WHEN list_has_any(string_split(lower(name), ' '), [{_quoted(names.PERSON_TITLES)}]) THEN 'Person'
  ELSE CASE label WHEN 'PER' THEN 'Person' WHEN 'ORG' THEN 'Company' WHEN 'LOC' THEN 'Location' END END AS type FROM names""")
def classify_names(spark, sf_dir):
    return _names(spark, sf_dir).select("id", names.entity_type(F.col("name"), F.col("label")).alias("type"))


def _normal_sql(column: str, suffixes) -> str:
    out = f"trim(lower({column}))"
    for s in suffixes:
        if s.isascii():
            out = rf"regexp_replace({out}, '\b{s}\b', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH {NAMES_SQL} SELECT id, " + ", ".join(f"{_normal_sql('name', s)} AS {n}" for n, s in (("resolver", names.RESOLVER_SUFFIXES), ("registry", names.REGISTRY_SUFFIXES), ("linker", names.LINKER_SUFFIXES), ("merger", names.MERGER_SUFFIXES))) + " FROM names")
def normalize_names(spark, sf_dir):
    n = F.col("name")
    return _names(spark, sf_dir).select("id", names.normalized(n).alias("resolver"), names.normalized(n, names.REGISTRY_SUFFIXES).alias("registry"), names.normalized(n, names.LINKER_SUFFIXES).alias("linker"), names.normalized(n, names.MERGER_SUFFIXES, dotted=False).alias("merger"))


@query(rf"""
WITH {NAMES_SQL}, p AS (SELECT id, name, list_filter(list_transform(string_split(regexp_replace(name, '(?i)\band\b', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM names)
SELECT id, unnest(CASE WHEN len(parts) >= 2 THEN list_filter(parts, lambda x: length(x) >= 2) ELSE [name] END) AS part, CASE WHEN len(parts) >= 2 THEN 0.8e0 * 0.9e0 ELSE 0.8e0 END AS confidence FROM p""")
def compound_split(spark, sf_dir):
    n = _names(spark, sf_dir).withColumn("parts", names.compound_parts(F.col("name"), tuple(resolution.ACRONYMS)))
    return n.select("id", F.explode("parts").alias("part"), F.when(F.size("parts") > 1, F.lit(0.8) * resolution.SPLIT_PENALTY).otherwise(0.8).alias("confidence"))


@query(rf"""
WITH {NAMES_SQL}, i AS (
  SELECT CASE WHEN lower(name) IN ({_quoted(names.JOB_TITLES)}) THEN 'job_titles' WHEN length(name) <= 2 AND upper(name) NOT IN ({_quoted(names.KEPT_ACRONYMS)}) THEN 'too_short' WHEN length(name) > 100 THEN 'too_long'
    WHEN regexp_matches(name, '^[\p{{L}}\p{{N}}_\s]+ \d{{4}}[a-z]?$') THEN 'citations' WHEN regexp_matches(lower(name), '{_DATED}') THEN 'references' WHEN {_SPACES} >= 5 THEN 'sentence_like'
    WHEN regexp_matches(lower(name), '^(company|investor|shareholders?|entity)\s*\d+$') THEN 'generic_numbered' END AS issue FROM names)
SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue UNION ALL SELECT 'total', count(*) FROM i""")
def quality_issues(spark, sf_dir):
    return curation.issue_report(_names(spark, sf_dir))


# ---- extraction


def _relation_sql() -> str:
    aliases = ", ".join(f"('{a}', '{b}')" for a, b in RELATION_ALIASES.items())
    return f"aliases(alias, canonical) AS (VALUES {aliases})"


RELATION_NAMES = (*RELATION_TYPES, *RELATION_ALIASES, "owns", "OWNS SHARES", "UNKNOWN", "")


@query(f"WITH {_relation_sql()}, n AS (SELECT event_id, [{_quoted(RELATION_NAMES)}][event_id % {len(RELATION_NAMES)} + 1] AS name FROM events) SELECT event_id, CASE WHEN name IN ({_quoted(RELATION_TYPES)}) THEN name ELSE canonical END AS relation FROM n LEFT JOIN aliases ON alias = name")
def relation_canonicalize(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    name = F.element_at(F.array(*map(F.lit, RELATION_NAMES)), (F.col("event_id") % len(RELATION_NAMES) + 1).cast("int"))
    return e.select("event_id", canonical_relation(name).alias("relation"))


def _responses(spark, sf_dir):
    """Answers as a provider gives them: fenced, bare and broken JSON; confidences missing, low and out of range."""
    c = _table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_name")
    conf = F.when(k % 7 == 0, F.lit(None).cast("double")).when(k % 11 == 0, F.lit(1.5)).otherwise((k % 10) / 10.0)
    ents = F.array(F.struct(n.alias("name"), F.when(k % 5 == 0, "Alien").otherwise("Person").alias("type"), conf.alias("confidence")), F.struct(F.lit("CEO").alias("name"), F.lit("Person").alias("type"), F.lit(0.9).alias("confidence")))
    rels = F.array(F.struct(n.alias("source"), F.when(k % 3 == 0, "OWNED_BY").when(k % 3 == 1, "LINKED_TO").otherwise("is linked").alias("relation"), F.lit("Acme").alias("target"), conf.alias("confidence"), F.lit("said so").alias("evidence")))
    text = F.to_json(F.struct(ents.alias("entities"), rels.alias("relations")))
    answer = F.when(k % 13 == 0, F.lit("{not json")).when(k % 2 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)
    return c.select(k.alias("chunk_id"), answer.alias("response"))


PARSED_SQL = """r AS (
  SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 7 = 0 THEN 0.8e0 WHEN c_custkey % 11 = 0 THEN 1.5e0 ELSE (c_custkey % 10) / 10e0 END AS conf FROM customer WHERE c_custkey % 13 <> 0
)"""


@query(f"WITH {PARSED_SQL} SELECT k AS chunk_id, c_name AS source, CASE WHEN k % 3 = 0 THEN 'OWNS' ELSE 'RELATED_TO' END AS relation, 'Acme' AS target, conf AS confidence, 'said so' AS evidence FROM r WHERE k % 3 <> 2 AND conf BETWEEN 0.7e0 AND 1")
def llm_json_relations(spark, sf_dir):
    return extraction.given_relations(extraction.parsed(_responses(spark, sf_dir))).drop("pos")


@query(f"WITH {PARSED_SQL} SELECT k AS chunk_id, c_name AS name, 'Person' AS type, conf AS confidence FROM r WHERE k % 5 <> 0 AND conf BETWEEN 0 AND 1")
def llm_json_entities(spark, sf_dir):
    return extraction.given_entities(extraction.parsed(_responses(spark, sf_dir))).select("chunk_id", "name", "type", "confidence")


@query(f"""
WITH {PARSED_SQL}, a AS (SELECT c_custkey AS k, upper(c_name) AS n, 0.8e0 AS conf, 'Company' AS type FROM customer WHERE c_custkey % 4 = 0),
b AS (SELECT k, c_name AS n, conf, 'Person' AS type FROM r WHERE k % 5 <> 0 AND conf BETWEEN 0 AND 1)
SELECT coalesce(a.k, b.k) AS chunk_id, coalesce(a.n, b.n) AS name, coalesce(a.type, b.type) AS type, greatest(coalesce(a.conf, 0), coalesce(b.conf, 0)) AS confidence FROM a FULL JOIN b ON a.k = b.k AND lower(a.n) = lower(b.n) WHERE greatest(coalesce(a.conf, 0), coalesce(b.conf, 0)) >= 0.7e0""")
def merge_ner_llm(spark, sf_dir):
    ner = _table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("chunk_id"), F.lit(0).alias("pos"), F.upper("c_name").alias("name"), F.lit("Company").alias("type"), F.lit(0.8).alias("confidence"))
    return extraction.merged(ner, extraction.given_entities(extraction.parsed(_responses(spark, sf_dir)))).drop("aliases", "pos")


# ---- similarity, resolution, linking


LCS_SQL = """
, grid AS (
  SELECT a, b, 0 AS i, list_resize([0], length(b) + 1, 0) AS r FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_prepend([0], [[j] for j in range(1, length(b) + 1)]), lambda cur, j: list_append(cur, CASE WHEN substr(b, j[1], 1) = substr(a, i + 1, 1) THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], cur[j[1]]) END)) FROM grid WHERE i < length(a)
)"""


@query(
    "WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS s FROM part), pairs AS (SELECT DISTINCT x.s AS a, y.s AS b FROM n x JOIN n y ON x.name < y.name)" + LCS_SQL + """
SELECT x.name AS name, y.name AS other, round(200e0 * r[length(b) + 1] / (length(a) + length(b)), 6) AS score FROM n x JOIN n y ON x.name < y.name JOIN grid ON a = x.s AND b = y.s AND i = length(a)
WHERE 200e0 * r[length(b) + 1] / (length(a) + length(b)) >= 70"""
)
def token_sort_pairs(spark, sf_dir):
    n = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("block", F.lit(0))
    out = resolution.scored_pairs(n, n, ["block"], 70.0).where("name < other_name")
    return out.select("name", F.col("other_name").alias("other"), F.round("score", 6).alias("score"))


@query("""
WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.id, b.id AS best_id, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), 9) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, best_id) AS k FROM p)
SELECT id, best_id, round(similarity, 6) AS similarity FROM k WHERE k = 1 AND similarity >= 0""")
def cosine_best_match(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("embedding").alias("vector"))
    return resolution.best_by_vector(v, v, 0.0).select("id", "best_id", F.round("similarity", 6).alias("similarity"))


def _link_inputs(spark, sf_dir):
    """Names in shapes for each tier, compound ones among them: names, aliases, acronyms, suffixes, misspelt ones, strange ones."""
    p = _table(spark, sf_dir, "part")
    known = p.groupBy("p_name").agg(F.min("p_partkey").alias("ord")).select(F.initcap("p_name").alias("name"), F.array(F.concat(F.lit("part "), F.col("p_name"))).alias("aliases"), "ord")
    banks = spark.createDataFrame([(full, 10_000_000_000 + i) for i, full in enumerate(resolution.ACRONYMS.values()) if i % 3], "name string, ord long")
    known = known.unionByName(banks.select("name", F.array().cast("array<string>").alias("aliases"), "ord"))
    shape, n = F.col("p_partkey") % 7, F.col("p_name")
    short = F.element_at(F.array(*map(F.lit, resolution.ACRONYMS)), (F.col("p_partkey") % len(resolution.ACRONYMS) + 1).cast("int"))
    name = F.when(shape == 0, F.upper(n)).when(shape == 1, F.concat(F.lit("Part "), n)).when(shape == 2, F.concat(n, F.lit(" Company SA"))).when(shape == 3, short)
    name = name.when(shape == 4, F.concat(F.left(n, F.length(n) - 1), F.lit("x"))).when(shape == 5, F.concat(F.lit("zzz "), F.col("p_brand"))).otherwise(F.concat(n, F.lit(" and "), short))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.lit(0.8).alias("confidence")), known


_ACRONYM_ROWS = ", ".join("({}, '{}', '{}')".format(i, k, v.replace("'", "''")) for i, (k, v) in enumerate(resolution.ACRONYMS.items()))
LINK_SQL = f"""
WITH RECURSIVE acronyms(i, short, full_name) AS (VALUES {_ACRONYM_ROWS}),
keys AS (
  SELECT lower(p_name) AS key, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') AS canonical, min(p_partkey) AS ord FROM part GROUP BY p_name
  UNION ALL SELECT 'part ' || lower(p_name), array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' '), min(p_partkey) FROM part GROUP BY p_name
  UNION ALL SELECT lower(full_name), full_name, 10000000000 + i FROM acronyms WHERE i % 3 <> 0
), asked AS (
  SELECT p_partkey AS id, unnest(CASE p_partkey % 7 WHEN 0 THEN [upper(p_name)] WHEN 1 THEN ['Part ' || p_name] WHEN 2 THEN [p_name || ' Company SA'] WHEN 3 THEN [short]
    WHEN 4 THEN [left(p_name, length(p_name) - 1) || 'x'] WHEN 5 THEN ['zzz ' || p_brand] ELSE [p_name, short] END) AS name, CASE p_partkey % 7 WHEN 6 THEN 0.8e0 * 0.9e0 ELSE 0.8e0 END AS confidence
  FROM part JOIN acronyms ON i = p_partkey % {len(resolution.ACRONYMS)}
), names AS (SELECT DISTINCT name FROM asked
), t1 AS (SELECT name, canonical, 1 AS tier FROM names JOIN keys ON key = lower(name)
), t2 AS (SELECT name, canonical, 2 AS tier FROM names JOIN acronyms ON short = name JOIN keys ON key = lower(full_name) WHERE name = upper(name) AND length(name) <= 5
), t3 AS (
  SELECT name, arg_min(canonical, (ord, key)) AS canonical, 3 AS tier FROM (SELECT name, {_normal_sql("name", names.LINKER_SUFFIXES)} AS norm FROM names) n
  JOIN (SELECT *, {_normal_sql("key", names.LINKER_SUFFIXES)} AS norm FROM keys) k USING (norm) WHERE norm <> '' GROUP BY name
), left_ AS (
  SELECT name, array_to_string(list_sort(string_split(lower(name), ' ')), ' ') AS s FROM names WHERE name NOT IN (SELECT name FROM t1 UNION ALL SELECT name FROM t2 UNION ALL SELECT name FROM t3)
), sorted AS (SELECT *, array_to_string(list_sort(string_split(key, ' ')), ' ') AS s FROM keys
), pairs AS (SELECT DISTINCT x.s AS a, y.s AS b FROM left_ x, sorted y WHERE 200e0 * least(length(x.s), length(y.s)) / (length(x.s) + length(y.s)) >= 85
)""" + LCS_SQL + """
, t4 AS (
  SELECT name, arg_min(canonical, (-score, ord, key)) AS canonical, 4 AS tier FROM (
    SELECT x.name, y.*, 200e0 * r[length(b) + 1] / (length(a) + length(b)) AS score FROM grid JOIN left_ x ON x.s = a JOIN sorted y ON y.s = b WHERE i = length(a)
  ) WHERE score >= 85 GROUP BY name
), hits AS (
  SELECT name, arg_min(canonical, tier) AS canonical, min(tier) AS tier FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4) GROUP BY name
)
SELECT asked.id, asked.name, confidence, canonical, tier FROM asked LEFT JOIN hits USING (name)"""


@query(LINK_SQL)
def link_tiers(spark, sf_dir):
    asked, known = _link_inputs(spark, sf_dir)
    parts = resolution.split_compounds(asked)
    out = resolution.linked(parts.select(F.struct("id", "name", "confidence").alias("id"), "name"), known)
    return out.select("id.id", "name", "id.confidence", "canonical", "tier")


def _shop_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("rank")).select(F.concat("p_name", F.when(F.col("rank") % 2 == 0, " Group").otherwise(" SA")).alias("name"), "rank")


@query(
    "WITH RECURSIVE n AS (SELECT p_name || CASE WHEN min(p_partkey) % 2 = 0 THEN ' Group' ELSE ' SA' END AS name, p_name AS norm, min(p_partkey) AS rank, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS s FROM part GROUP BY p_name), pairs AS (SELECT DISTINCT x.s AS a, y.s AS b FROM n x JOIN n y ON x.rank < y.rank)" + LCS_SQL + """
SELECT x.name, y.name AS other, round(200e0 * r[length(b) + 1] / (length(a) + length(b)), 6) AS score FROM n x JOIN n y ON x.rank < y.rank JOIN grid ON a = x.s AND b = y.s AND i = length(a) WHERE 200e0 * r[length(b) + 1] / (length(a) + length(b)) >= 75"""
)
def duplicate_pairs(spark, sf_dir):
    return resolution.duplicate_pairs(_shop_names(spark, sf_dir), 75.0).select("name", "other", F.round("score", 6).alias("score"))


def _variants(spark, sf_dir):
    p, k = _table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.initcap("p_name")).otherwise(F.col("p_name"))
    kind = F.when(F.col("p_size") % 10 < 5, "Company").when(F.length("p_name") % 2 == 0, "Sector").otherwise("Person")
    return p.groupBy(name.alias("name")).agg(F.min(kind).alias("type"), F.count(F.lit(1)).alias("connections"))


@query("""
WITH v AS (
  SELECT name, min(type) AS type, count(*) AS connections FROM (
    SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') ELSE p_name END AS name,
           CASE WHEN p_size % 10 < 5 THEN 'Company' WHEN length(p_name) % 2 = 0 THEN 'Sector' ELSE 'Person' END AS type FROM part) GROUP BY name
), g AS (SELECT lower(name) AS key FROM v GROUP BY 1 HAVING count(*) > 1 AND (count(DISTINCT type) = 1 OR bool_and(type IN ('Company', 'Sector')))),
r AS (SELECT name, lower(name) AS key, row_number() OVER w AS k, first_value(name) OVER w AS canonical FROM v WHERE lower(name) IN (SELECT key FROM g)
  WINDOW w AS (PARTITION BY lower(name) ORDER BY connections DESC, (name = array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(name, ' ')], ' ')) DESC, name))
SELECT canonical, name AS duplicate FROM r WHERE k > 1""")
def case_variant_merge(spark, sf_dir):
    return curation.case_variants(_variants(spark, sf_dir))


@query("""
WITH d AS (SELECT event_id AS ord, 'U' || user_id AS a, 'u' || (floor(value)::BIGINT % 50) AS b, CASE event_id % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'separate' ELSE 'pending' END AS decision FROM events)
SELECT least(lower(a), lower(b)) AS a, greatest(lower(a), lower(b)) AS b, arg_max(decision, ord) AS decision FROM d GROUP BY 1, 2""")
def review_pairs(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("merge", "separate", "pending"))), (F.col("event_id") % 3 + 1).cast("int"))
    return resolution.decision_pairs(e.select(F.col("event_id").alias("ord"), F.concat(F.lit("U"), "user_id").alias("entity1"), F.concat(F.lit("u"), F.floor("value").cast("long") % 50).alias("entity2"), kind.alias("decision")))


# ---- registry


def _registry(spark, sf_dir):
    p = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.count(F.lit(1)).alias("mention_count"), F.sum(F.col("p_size") % 2).alias("relation_count"))
    e = p.select("id", F.initcap("p_name").alias("canonical_name"), F.when(F.col("id") % 2 == 0, "Company").otherwise("Bank").alias("entity_type"), F.lit(0.5).alias("confidence"), "mention_count", "relation_count", (F.col("id") % 5 == 0).alias("validated"), "p_name")
    a = e.select(F.col("id").alias("entity_id"), F.concat(F.lit("Part "), "p_name").alias("alias_name"), F.lit("variant").alias("alias_type"), F.lit(0.7).alias("confidence"), F.lit("learned").alias("source"))
    return e.drop("p_name"), a


REGISTRY_SQL = """reg AS (
  SELECT min(p_partkey) AS id, p_name, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') AS canonical_name, CASE WHEN min(p_partkey) % 2 = 0 THEN 'Company' ELSE 'Bank' END AS entity_type,
         count(*) AS mention_count, sum(p_size % 2)::BIGINT AS relation_count, min(p_partkey) % 5 = 0 AS validated FROM part GROUP BY p_name
)"""


@query(f"""
WITH RECURSIVE {REGISTRY_SQL}, q AS (
  SELECT p_partkey AS qid, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'PART ' || p_name ELSE p_name || ' Ltd' END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Company' ELSE 'Bank' END AS entity_type FROM part
), keys AS (
  SELECT id, lower(canonical_name) AS key, entity_type, 0 AS kind FROM reg UNION ALL SELECT id, 'part ' || lower(p_name), entity_type, 1 FROM reg
), names AS (SELECT DISTINCT name, entity_type FROM q
), exact AS (SELECT name, n.entity_type, arg_min(id, (kind, id)) AS id, min(kind) + 1 AS tier FROM names n JOIN keys k ON key = lower(name) AND k.entity_type = n.entity_type GROUP BY ALL
), normal AS (
  SELECT name, n.entity_type, arg_min(id, (kind, id)) AS id, 3 AS tier FROM (SELECT *, {_normal_sql("name", names.REGISTRY_SUFFIXES)} AS norm FROM names) n
  JOIN (SELECT *, {_normal_sql("key", names.REGISTRY_SUFFIXES)} AS norm FROM keys) k ON k.norm = n.norm AND k.entity_type = n.entity_type WHERE n.norm <> '' GROUP BY name, n.entity_type
), left_ AS (
  SELECT *, array_to_string(list_sort(string_split(lower(name), ' ')), ' ') AS s FROM names WHERE (name, entity_type) NOT IN (SELECT (name, entity_type) FROM exact UNION ALL SELECT (name, entity_type) FROM normal)
), sorted AS (SELECT *, array_to_string(list_sort(string_split(key, ' ')), ' ') AS s FROM keys
), pairs AS (SELECT DISTINCT x.s AS a, y.s AS b FROM left_ x JOIN sorted y ON x.entity_type = y.entity_type WHERE 200e0 * least(length(x.s), length(y.s)) / (length(x.s) + length(y.s)) >= 85
){LCS_SQL}, alike AS (
  SELECT name, entity_type, arg_min(id, (-score, kind, id)) AS id, 4 AS tier FROM (
    SELECT x.name, x.entity_type, y.id, y.kind, 200e0 * r[length(b) + 1] / (length(a) + length(b)) AS score FROM grid JOIN left_ x ON x.s = a JOIN sorted y ON y.s = b AND y.entity_type = x.entity_type WHERE i = length(a)
  ) WHERE score >= 85 GROUP BY name, entity_type
), hits AS (SELECT name, entity_type, arg_min(id, tier) AS id, min(tier) AS tier FROM (SELECT * FROM exact UNION ALL SELECT * FROM normal UNION ALL SELECT * FROM alike) GROUP BY name, entity_type)
SELECT qid, entity_type, id AS entity_id, tier FROM q LEFT JOIN hits USING (name, entity_type)""")
def registry_lookup(spark, sf_dir):
    e, a = _registry(spark, sf_dir)
    k, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 3 == 0, F.upper(n)).when(k % 3 == 1, F.concat(F.lit("PART "), n)).otherwise(F.concat(n, F.lit(" Ltd")))
    q = _table(spark, sf_dir, "part").select(k.alias("qid"), name.alias("name"), F.when(k % 2 == 0, "Company").otherwise("Bank").alias("entity_type"))
    return registry.lookup(q, e, a).select("qid", "entity_type", "entity_id", "tier")


@query(f"""
WITH RECURSIVE {REGISTRY_SQL}, c AS (
  SELECT id, mention_count AS n, relation_count AS r, validated AS v, 1 AS k, 0.5e0 AS c FROM reg
  UNION ALL SELECT id, n, r, v, k + 1, least(1e0, CASE WHEN v THEN greatest(0.95e0, x) ELSE x END) FROM (SELECT *, c + least(0.25e0, 0.05e0 * ln(k + 2)) + CASE WHEN r > 0 THEN least(0.15e0, 0.03e0 * ln(r + 1)) ELSE 0 END AS x FROM c WHERE k < n)
)
SELECT id, round(c, 9) AS confidence FROM c WHERE k = n""")
def registry_confidence(spark, sf_dir):
    e, _ = _registry(spark, sf_dir)
    return e.select("id", F.round(scores.confidence_after(F.col("confidence"), F.col("mention_count"), F.col("relation_count"), F.col("validated")), 9).alias("confidence"))


@query(f"WITH {REGISTRY_SQL} SELECT entity_type, count(*) AS n, (SELECT count(*) FROM reg) AS total_entities, 0.5e0 AS avg_confidence, (SELECT count(*) FROM reg) AS total_aliases FROM reg GROUP BY entity_type")
def registry_stats(spark, sf_dir):
    return registry.stats(*_registry(spark, sf_dir))


@query(f"WITH {REGISTRY_SQL} SELECT id, canonical_name, mention_count FROM reg WHERE entity_type = 'Company' ORDER BY mention_count DESC, canonical_name LIMIT 20")
def registry_top(spark, sf_dir):
    return registry.top(_registry(spark, sf_dir)[0], 0.5, "Company", 20).select("id", "canonical_name", "mention_count")


@query(f"""
WITH {REGISTRY_SQL}, n AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN 'Brand new ' || (o_custkey % 30) ELSE upper((SELECT any_value(canonical_name) FROM reg WHERE id = (SELECT min(id) FROM reg))) END AS name, 'order_' || o_orderkey AS doc FROM orders),
g AS (SELECT lower(name) AS key, count(*) AS n FROM n GROUP BY 1)
SELECT coalesce(canonical_name, (SELECT arg_min(name, ord) FROM n WHERE lower(name) = key)) AS canonical_name, coalesce(mention_count, 0) + coalesce(g.n, 0) AS mention_count FROM reg FULL JOIN g ON lower(canonical_name) = key AND entity_type = (SELECT any_value(entity_type) FROM reg WHERE id = (SELECT min(id) FROM reg))""")
def registry_register(spark, sf_dir):
    e, _ = _registry(spark, sf_dir)
    e = e.withColumns({"first_doc": F.lit(None).cast("string"), "last_doc": F.lit(None).cast("string")})
    first = e.orderBy("id").limit(1).select(F.upper("canonical_name").alias("first_name"), F.col("entity_type").alias("first_type"))
    o = _table(spark, sf_dir, "orders").join(F.broadcast(first))
    new = F.col("o_orderkey") % 4 == 0
    m = o.select(F.when(new, F.concat(F.lit("Brand new "), F.col("o_custkey") % 30)).otherwise(F.col("first_name")).alias("canonical_name"), F.col("first_type").alias("entity_type"), F.concat(F.lit("order_"), "o_orderkey").alias("document"), F.col("o_orderkey").alias("ord"))
    return registry.registered(e, m).select("canonical_name", "mention_count")


@query(f"""
WITH {REGISTRY_SQL}, n AS (SELECT r.id AS entity_id, r.canonical_name, o.o_orderkey AS ord, CASE o.o_orderkey % 3 WHEN 0 THEN upper(r.canonical_name) WHEN 1 THEN 'PART ' || r.p_name ELSE 'Alias ' || (o.o_orderkey % 9) END AS alias_name FROM orders o JOIN part p ON o.o_custkey = p.p_partkey JOIN reg r ON r.p_name = p.p_name),
x AS (SELECT entity_id, lower(alias_name) AS key, arg_min(alias_name, ord) AS alias_name FROM n WHERE lower(alias_name) <> lower(canonical_name) AND (entity_id, lower(alias_name)) NOT IN (SELECT (id, lower('Part ' || p_name)) FROM reg) GROUP BY 1, 2)
SELECT entity_id, alias_name FROM x UNION ALL SELECT id, 'Part ' || p_name FROM reg""")
def alias_insert(spark, sf_dir):
    e, a = _registry(spark, sf_dir)
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "part"), F.col("o_custkey") == F.col("p_partkey"))
    o = o.join(e.select("id", "canonical_name"), F.initcap("p_name") == F.col("canonical_name"))
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, F.upper("canonical_name")).when(k == 1, F.concat(F.lit("PART "), "p_name")).otherwise(F.concat(F.lit("Alias "), F.col("o_orderkey") % 9))
    return registry.with_aliases(e, a, o.select(F.col("id").alias("entity_id"), name.alias("alias_name"), F.col("o_orderkey").alias("ord"))).select("entity_id", "alias_name")


@query(G + ALL_SQL + """, deg AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM all_edges UNION ALL SELECT dst FROM all_edges WHERE src <> dst) GROUP BY name)
SELECT e.name AS canonical_name, type AS entity_type, coalesce(nullif(confidence, 0), 0.5e0) AS confidence, coalesce(degree, 0) AS relation_count FROM entities e LEFT JOIN deg USING (name) WHERE type IN ('Person', 'Company')""")
def registry_bootstrap(spark, sf_dir):
    edges = graph.all_edges(demo.edges(spark, sf_dir), demo.mentions(spark, sf_dir))
    return registry.from_graph(demo.entities(spark, sf_dir), graph.degree(edges), ("Person", "Company"))[0].select("canonical_name", "entity_type", "confidence", "relation_count")


# ---- amounts and companies


AMOUNTS_SQL = "a AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN n || ' TND' WHEN 1 THEN n || ' MTND' WHEN 2 THEN n || ' MD' WHEN 3 THEN replace(n, '.', ',') || ' %' WHEN 4 THEN n || ' MILLE DINARS' ELSE 'none' END AS t FROM (SELECT o_orderkey, printf('%.2f', o_totalprice) AS n FROM orders))"
_NUM = r"TRY_CAST(nullif(regexp_extract(replace(replace({0}, ' ', ''), ',', '.'), '(\d+\.?\d*)', 1), '') AS DOUBLE)"
_CUT = "replace(replace(replace(upper(t), 'TND', ''), 'DT', ''), 'DINARS', '')"


@query(rf"""
WITH {AMOUNTS_SQL} SELECT id, {_NUM.format('t')} AS percentage, {_NUM.format(_CUT)} * CASE WHEN regexp_matches({_CUT}, 'MTND|MD|MILLION') THEN 1e6 WHEN regexp_matches({_CUT}, 'KTND|MILLE') THEN 1e3 ELSE 1e0 END AS amount,
  TRY_CAST(nullif(regexp_extract(replace(replace(replace(lower(t), ' ', ''), ',', ''), '.', ''), '(\d+)', 1), '') AS BIGINT) AS share_count FROM a""")
def parse_amounts(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    n = F.format_string("%.2f", "o_totalprice")
    shapes = [F.concat(n, F.lit(" TND")), F.concat(n, F.lit(" MTND")), F.concat(n, F.lit(" MD")), F.concat(F.translate(n, ".", ","), F.lit(" %")), F.concat(n, F.lit(" MILLE DINARS")), F.lit("none")]
    t = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), amounts.percentage(t).alias("percentage"), amounts.amount(t).alias("amount"), amounts.share_count(t).alias("share_count"))


@query("""
WITH h AS (SELECT l_suppkey, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT c_name AS source, 'OWNS_SHARES' AS relation, s_name AS target, 0.9e0 AS confidence, 'Shareholder data from http://s/' || s_suppkey AS evidence, h.n::VARCHAR AS share_count FROM h JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON c_custkey = o_custkey WHERE n >= 3
UNION ALL SELECT 'Head ' || s_suppkey, 'DIRECTOR_OF', s_name, 0.9e0, NULL, NULL FROM supplier WHERE s_suppkey % 2 = 0""")
def financial_graph(spark, sf_dir):
    held = demo.pairs(spark, sf_dir).where("n >= 3").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    no = F.lit(None)
    share = F.struct(F.col("c_name").alias("name"), F.col("n").alias("share_count"), no.cast("double").alias("percentage"), no.cast("double").alias("value_tnd"), F.lit("person").alias("shareholder_type"))
    lists = held.groupBy("l_suppkey").agg(F.collect_list(share).alias("shareholders"))
    s = _table(spark, sf_dir, "supplier").join(lists, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    firms = s.select(F.col("s_name").alias("name"), *[no.cast("string").alias(c) for c in ("ticker", "sector", "legal_form", "headquarters", "ipo_date")], F.col("s_acctbal").alias("market_cap_tnd"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Head "), "s_suppkey")).alias("ceo"), F.concat(F.lit("http://s/"), "s_suppkey").alias("source_url"), "shareholders")
    return financial.company_graph(firms)[1].select("source", "relation", "target", "confidence", "evidence", F.try_element_at("properties", F.lit("share_count")).alias("share_count"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from ..streaming.ingest import event_windows as windows

    return windows(_table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))
