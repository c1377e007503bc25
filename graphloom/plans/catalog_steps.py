"""Further registered queries: files, texts, extraction, curation, registry and ingest, each with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..model import ENTITY_TYPES
from ..operators import chunks, curation, extraction, graph, registry, resolution, upserts
from ..sources import files, financial, html
from ..storage import folder
from . import demo
from .catalog import ALL_SQL, G, LCS_SQL, MAPPING_SQL, NAMES_SQL, OVERVIEW_SQL, QUERIES, REGISTRY_SQL, _chunks, _html_sql, _names, _normal_sql, _registry, _shop_names, _supplier_mapping, _table, query

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = f"""
lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, p, length(p) AS n FROM (
    SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos, trim(unnest(string_split(coalesce(text, ''), chr(10))), {BLANK}) AS p FROM documents
  ) WHERE p <> ''
)"""


# ---- files and pages


@query("SELECT s_suppkey AS id, s_name || '.pdf' AS filename FROM supplier")
def accepted_files(spark, sf_dir):
    """Uploads by suffix; others would raise an error."""
    s = _table(spark, sf_dir, "supplier")
    return files.accepted(s.select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(".pdf")).alias("filename")))


@query("""
SELECT page_id, len(h) AS page_count, (SELECT sum(length(x))::BIGINT FROM unnest(h) t(x)) AS total_chars, h[1] AS first_page FROM (
  SELECT page_id, list_transform(range(1, 4), lambda k: CASE WHEN length(trim(substr(html, (k - 1) * 400 + 1, 400))) < 50 THEN 'scanned ' || k ELSE substr(html, (k - 1) * 400 + 1, 400) END) AS h FROM pages
)""")
def decoded_pages(spark, sf_dir):
    """Pages of files through a decoder; pages with little text go to the second reader."""
    p = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))

    def decode(content):
        text = content.cast("string")
        return F.array(*[F.struct(F.lit(k).alias("page_number"), F.substring(text, (k - 1) * 400 + 1, 400).alias("text")) for k in (1, 2, 3)])

    out = files.pages(p, decode, lambda content, page: F.concat(F.lit("scanned "), page.cast("string")))
    first = out.where("page_number = 1").select("path", F.col("text").alias("first_page"))
    return files.document_totals(out).join(first, "path").select(F.col("path").cast("long").alias("page_id"), "page_count", "total_chars", "first_page")


@query("SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS author, '' AS subject, 5 AS n_keys FROM customer")
def file_metadata(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    found = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("title"), F.col("c_name"), F.lit("author"), F.col("c_mktsegment"), F.lit("trapped"), F.lit("no"))).otherwise(F.create_map(F.lit("title"), F.col("c_name")))
    m = files.metadata(found)
    return c.select(F.col("c_custkey").alias("id"), *[m[k].alias(k) for k in ("title", "author", "subject")], F.size(m).alias("n_keys"))


@query(r"""
WITH a AS (SELECT url AS page, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["''][^"'']+["''][^>]*>.*?</a>')) AS a FROM pages WHERE regexp_matches(url, '/fr/')),
b AS (SELECT regexp_replace(regexp_extract(a, '(?is)\bhref=["'']([^"'']+)', 1), '/+$', '') AS u, regexp_extract(a, '(?is)\bhref=["'']([^"'']+)', 1) AS url, """ + _html_sql("(?s)(.*)", "''").replace("html", "a") + r""" AS name FROM a)
SELECT name, string_split(u, '/')[-1] AS id, url FROM b WHERE regexp_matches(url, '^/') AND name <> ''""")
def page_companies(spark, sf_dir):
    """Companies that anchors lead to, the id from the last step of the address."""
    return html.companies(_table(spark, sf_dir, "pages").where(F.col("url").contains("/fr/")), "^/")


#: For each site the tags that its pages have where generic ones have h1, article and time.
SITE_TAGS = {
    "tap": ('<h1 class="article-title">', '<div class="article-content">', '<time class="article-date" datetime="2024-05-06">x</time>', "2024-05-06"),
    "african_manager": ('<h1 class="entry-title">', '<div class="entry-content">', '<time class="entry-date" datetime="2024-05-07">x</time>', "2024-05-07"),
    "ilboursa": ('<h1 class="article-title">', '<div class="article-body">', '<span class="article-date">8 mai</span>', "8 mai"),
}
_SITE_SQL = " UNION ALL ".join(
    f"SELECT page_id, '{site}' AS source, {_html_sql('(?is)<h1[^>]*>(.*?)</h1>', chr(39) * 2)} AS title, md5({_html_sql('(?is)<article[^>]*>(.*?)</article>', 'chr(10)')}) AS content_md5, '{date}' AS date FROM plain"
    for site, (_, _, _, date) in SITE_TAGS.items()
)


@query(r"WITH plain AS (SELECT page_id, url, html FROM pages WHERE regexp_matches(html, '(?is)<h1[^>]*>(.*?)</h1>') AND regexp_matches(html, '(?is)<article>(.*?)</article>') AND NOT regexp_matches(html, '(?is)<article>.*</?div.*</article>')) " + _SITE_SQL)
def site_articles(spark, sf_dir):
    """The selectors of each site on pages that are tagged as the site tags them; pages with blocks within the article are left aside."""
    # the first block after the tag is as good as any, so the search doesn't come back to it
    blocks = F.col("html").rlike("(?is)(?><article>.*?</?div).*</article>")
    p = _table(spark, sf_dir, "pages").where(F.col("html").rlike("(?is)<article>.*?</article>") & ~blocks)
    out = None
    for site, (title, content, date, _) in SITE_TAGS.items():
        tagged = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "(?i)<h1[^>]*>", title), "(?i)<article>", date + content), "(?i)</article>", "</div>")
        a = html.articles(html.computed(p, ["page_id", "url"], html=tagged), site).select("page_id", "source", "title", F.md5("content").alias("content_md5"), "date")
        out = a if out is None else out.unionByName(a)
    return out


# ---- texts


@query(f"""
WITH p AS (
  SELECT doc_id, list_filter(list_transform(string_split(array_to_string(list_transform(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {BLANK})), lambda x: CASE WHEN x = '' THEN chr(10) ELSE x END), ' '), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents
) SELECT doc_id, len(p)::INTEGER AS n, md5(array_to_string(p, '|')) AS paragraphs_md5 FROM p""")
def page_paragraphs(spark, sf_dir):
    p = chunks.paragraphs(F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("paragraphs_md5"))


CHUNKS_SQL = f"""
WITH RECURSIVE {LINES_SQL}, pieces AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, i ORDER BY pos) AS j, s, length(s) AS n FROM (
    SELECT doc_id, i, unnest(range(len(string_split(p, '.')))) AS pos, trim(unnest(string_split(p, '.')), {BLANK}) || '.' AS s FROM lines WHERE n > 1000
  ) WHERE s <> '.'
), fold AS (
  SELECT doc_id, i, j, s, n AS size, 0 AS k FROM pieces WHERE j = 1
  UNION ALL SELECT x.doc_id, x.i, x.j, x.s, CASE WHEN f.size + x.n > 1000 THEN x.n ELSE f.size + x.n END, CASE WHEN f.size + x.n > 1000 THEN f.k + 1 ELSE f.k END FROM fold f JOIN pieces x ON x.doc_id = f.doc_id AND x.i = f.i AND x.j = f.j + 1
), cut AS (SELECT doc_id, i, list(t ORDER BY k) AS texts FROM (SELECT doc_id, i, k, string_agg(s, ' ' ORDER BY j) AS t FROM fold GROUP BY doc_id, i, k) GROUP BY doc_id, i
), ready AS (SELECT l.doc_id, l.i, l.p, l.n, l.n > 1000 AS large, coalesce(c.texts, []) AS texts, max(l.i) OVER (PARTITION BY l.doc_id) AS last FROM lines l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.i = l.i
), state AS (
  SELECT doc_id, 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS cur, 0::BIGINT AS size, CAST([] AS STRUCT(text VARCHAR, paragraphs INTEGER)[]) AS done, max(last) AS last FROM ready GROUP BY doc_id
  UNION ALL
  SELECT s.doc_id, r.i,
    CASE WHEN r.large THEN [] WHEN s.size + r.n > 1000 AND len(s.cur) > 0 THEN [s.cur[-1], r.p] ELSE list_append(s.cur, r.p) END,
    CASE WHEN r.large THEN 0 WHEN s.size + r.n > 1000 AND len(s.cur) > 0 THEN length(s.cur[-1]) + r.n ELSE s.size + r.n END,
    list_concat(CASE WHEN len(s.cur) > 0 AND (r.large OR s.size + r.n > 1000) THEN [{{'text': array_to_string(s.cur, chr(10) || chr(10)), 'paragraphs': len(s.cur)::INTEGER}}] ELSE [] END,
                CASE WHEN r.large THEN list_transform(r.texts, lambda t: {{'text': t, 'paragraphs': 1}}) ELSE [] END),
    s.last
  FROM state s JOIN ready r ON r.doc_id = s.doc_id AND r.i = s.i + 1
), given AS (
  SELECT doc_id, i, unnest(range(len(done))) AS k, unnest(done) AS c FROM state
  UNION ALL SELECT doc_id, i + 1, 0, {{'text': array_to_string(cur, chr(10) || chr(10)), 'paragraphs': len(cur)::INTEGER}} FROM state WHERE i = last AND len(cur) > 0 AND size >= 100
), chunk AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INTEGER AS chunk_index, c.text AS text, length(c.text)::INTEGER AS char_count, c.paragraphs AS paragraph_count FROM given
), near AS (
  SELECT *, coalesce(right(lag(text) OVER w, 200), '') AS before, coalesce(left(lead(text) OVER w, 200), '') AS after FROM chunk WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)
)"""


@query(CHUNKS_SQL + " SELECT doc_id, chunk_index, char_count, paragraph_count, md5(text) AS text_md5, before, after FROM near")
def chunk_context(spark, sf_dir):
    """Chunks of whole documents, lines as paragraphs, with what stands before and after."""
    c = chunks.with_context(_chunks(spark, sf_dir))
    return c.select("doc_id", "chunk_index", "char_count", "paragraph_count", F.md5("text").alias("text_md5"), "before", "after")


@query(CHUNKS_SQL + """
SELECT doc_id, chunk_index, md5(CASE WHEN before <> '' THEN 'CONTEXT BEFORE:' || chr(10) || before || chr(10) || chr(10) ELSE '' END || 'TEXT:' || chr(10) || left(text, 2000) || chr(10) || chr(10)
  || CASE WHEN after <> '' THEN 'CONTEXT AFTER:' || chr(10) || after || chr(10) || chr(10) ELSE '' END || 'NAMES:' || chr(10) || 'Acme, Beta' || chr(10) || chr(10)) AS prompt_md5 FROM near""")
def chunk_prompts(spark, sf_dir):
    c = chunks.with_context(_chunks(spark, sf_dir))
    return c.select("doc_id", "chunk_index", F.md5(chunks.prompt(F.col("text"), F.col("before"), F.col("after"), F.array(F.lit("Acme"), F.lit("Beta")))).alias("prompt_md5"))


@query("""
SELECT doc_id, CASE WHEN instr(text, w) > 0 THEN substr(text, greatest(instr(text, w) - 100, 1), least(instr(text, w) + length(w) - 1 + 100, length(text)) - greatest(instr(text, w) - 100, 1) + 1) END AS near
FROM (SELECT doc_id, text, coalesce(string_split(text, ' ')[40], 'Acme') AS w FROM documents WHERE text IS NOT NULL)""")
def mention_windows(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("w", F.coalesce(F.try_element_at(F.split("text", " "), F.lit(40)), F.lit("Acme")))
    return d.select("doc_id", chunks.mention_window(F.col("text"), F.col("w")).alias("near"))


# ---- extraction


RUN = r"\p{Lu}[\p{L}\p{N}''#_-]*(?: \p{Lu}[\p{L}\p{N}''#_-]*)*"
_VALID_SQL = rf"""length(name) BETWEEN 2 AND 100 AND lower(name) NOT IN ({", ".join("'" + w.replace("'", "''") + "'" for w in names.JOB_TITLES)}) AND NOT regexp_matches(name, '^[\p{{L}}\p{{N}}_\s]+ \d{{4}}[a-z]?$')
  AND NOT (length(name) - length(replace(name, ' ', '')) >= 5 AND ({" OR ".join(f"contains(lower(name), '{w}')" for w in names.SENTENCE_WORDS)}))
  AND NOT regexp_matches(lower(name), '^(company|investor|shareholders?|entity)\s*\d+$') AND NOT regexp_matches(lower(name), '^[a-z]\d+$') AND lower(name) NOT IN ({", ".join("'" + w + "'" for w in names.DOMAINS)})"""
_TYPE_SQL = f"""CASE WHEN {" OR ".join(f"contains(lower(name), '{w}')" for w in names.COMPANY_WORDS)}
  THEN CASE WHEN contains(lower(name), 'bank') OR contains(lower(name), 'banque') THEN 'Bank' WHEN contains(lower(name), 'group') THEN 'Group' ELSE 'Company' END
  WHEN list_has_any(string_split(lower(name), ' '), [{", ".join("'" + w + "'" for w in names.PERSON_TITLES)}]) THEN 'Person'
  WHEN regexp_matches(name, '^\\p{{Lu}}{{2,}}$') THEN 'Company' WHEN len(string_split(name, ' ')) = 2 THEN 'Person' ELSE 'Location' END"""


@query(rf"""
WITH m AS (
  SELECT doc_id, unnest(range(len(f))) AS pos, unnest(f) AS name FROM (SELECT doc_id, regexp_extract_all(text, '{RUN}') AS f FROM documents WHERE text IS NOT NULL)
), t AS (SELECT doc_id, pos, name, {_TYPE_SQL} AS type FROM m WHERE {_VALID_SQL})
SELECT doc_id AS chunk_id, arg_min(name, pos) AS name, arg_min(type, pos) AS type, 0.8e0 AS confidence FROM t GROUP BY doc_id, lower(name)""")
def extract_entities(spark, sf_dir):
    """Mentions of whole documents by capitalized runs, typed and merged with what the verb provider finds."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").where(F.col("text").isNotNull())
    return extraction.extracted(d, extraction.capitalized_mentions, extraction.verb_relations)[0].drop("aliases", "pos")


@query(r"""
WITH w AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '[\p{L}\p{N}''#_-]+')) AS word FROM documents WHERE text IS NOT NULL),
n AS (SELECT DISTINCT upper(left(word, 1)) || substr(word, 2) AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) UNION SELECT 'The' UNION SELECT 'Is and')
SELECT doc_id AS chunk_id, name AS mention, instr(text, name)::INTEGER AS pos FROM w JOIN n ON string_split(name, ' ')[1] = word WHERE instr(text, name) > 0""")
def gazetteer(spark, sf_dir):
    """Names of a table in whole documents, at their first places."""
    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).select(F.concat(F.upper(F.left("word", F.lit(1))), F.substring("word", 2, 1000)).alias("name")).distinct()
    n = words.unionByName(spark.range(1).select(F.explode(F.array(F.lit("The"), F.lit("Is and"))).alias("name"))).distinct().withColumn("label", F.lit("ORG"))
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").where(F.col("text").isNotNull())
    return extraction.gazetteer_mentions(n)(d).select("chunk_id", "mention", "pos")


def _trade_pages(spark, sf_dir):
    """A page for each customer that bought of a supplier three times: a sentence that says so, and who founded it."""
    p = demo.pairs(spark, sf_dir).where("n >= 3").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    verb = F.when(F.col("o_custkey") % 2 == 0, "owns").otherwise("founded")
    text = F.concat("c_name", F.lit(" "), verb, F.lit(" "), "s_name", F.lit(" as the papers of the trade office say, where all of this was entered after a long time of waiting"))
    return p.select(F.concat(F.lit("d"), "o_custkey", F.lit("-"), "l_suppkey").alias("doc_id"), F.lit(1).alias("page_number"), text.alias("text"))


def _parts_of(out):
    """All that an ingest gives, as rows (part, a, b, c, confidence)."""
    no = F.lit(None).cast("string")
    rows = out.entities.select(F.lit("entity").alias("part"), F.col("name").alias("a"), F.col("type").alias("b"), F.array_join("aliases", "|").alias("c"), "confidence")
    rows = rows.unionByName(out.edges.select(F.lit("edge").alias("part"), F.concat_ws(">", "src", "rel_type", "dst").alias("a"), F.col("evidence").alias("b"), F.col("source_document").alias("c"), "confidence"))
    rows = rows.unionByName(out.mentions.select(F.lit("mention").alias("part"), F.col("entity_name").alias("a"), F.col("doc_path").alias("b"), no.alias("c"), F.lit(None).cast("double").alias("confidence")))
    rows = rows.unionByName(out.documents.select(F.lit("document").alias("part"), F.col("path").alias("a"), F.col("chunk_id").alias("b"), no.alias("c"), F.lit(None).cast("double").alias("confidence")))
    total = out.totals.select(F.lit("totals").alias("part"), *[F.concat_ws(",", *[F.col(c).cast("string") for c in cs]).alias(n) for n, cs in (("a", ("documents", "chunks")), ("b", ("entities", "relations")))], no.alias("c"), F.lit(None).cast("double").alias("confidence"))
    return rows.unionByName(total)


TRADES_SQL = """
WITH p AS (SELECT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT 'd' || o_custkey || '-' || l_suppkey AS doc, c_name, s_name, CASE WHEN o_custkey % 2 = 0 THEN 'owns' ELSE 'founded' END AS verb FROM p JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT 'entity' AS part, name AS a, 'Location' AS b, '' AS c, 0.8e0 AS confidence FROM (SELECT c_name AS name FROM t UNION SELECT s_name FROM t)
UNION ALL SELECT 'edge', c_name || '>' || upper(replace(verb, 'founded', 'FOUNDED')) || '>' || s_name, c_name || ' ' || verb || ' ' || s_name, doc, 0.9e0 FROM t
UNION ALL SELECT 'mention', c_name, doc, NULL, NULL FROM t UNION ALL SELECT 'mention', s_name, doc, NULL, NULL FROM t
UNION ALL SELECT 'document', doc, doc || '#0', NULL, NULL FROM t
UNION ALL SELECT 'totals', count(*) || ',' || count(*), 2 * count(*) || ',' || count(*), NULL, NULL FROM t"""


@query(TRADES_SQL)
def ingest_trades(spark, sf_dir):
    """From pages to rows for the graph: entities, edges, mentions, documents and totals."""
    from .ingest import ingest

    known = demo.entities(spark, sf_dir).where("type = 'Company'").select("name", "aliases", F.xxhash64("name").alias("ord"))
    return _parts_of(ingest(_trade_pages(spark, sf_dir), known, extraction.capitalized_mentions, extraction.verb_relations))


@query(TRADES_SQL)
def reprocess_trades(spark, sf_dir):
    """All pages anew, resolved by document."""
    from .ingest import reprocess

    return _parts_of(reprocess(_trade_pages(spark, sf_dir), extraction.capitalized_mentions, extraction.verb_relations))


@query("SELECT 'part' || p_partkey AS name, 'Company' AS type, 0.95e0 AS confidence, 'https://companies.example/list/part' || p_partkey AS source FROM part")
def placeholder_companies(spark, sf_dir):
    """Companies of which only the id is known, as entities."""
    ids = _table(spark, sf_dir, "part").select(F.concat(F.lit("part"), "p_partkey").alias("id"))
    e = financial.company_graph(financial.placeholders(ids, "https://companies.example/list/"))[0]
    return e.select("name", "type", "confidence", F.col("properties")["source"].alias("source"))


@query()
def ingest_documents(spark, sf_dir):
    """Whole documents from text to all rows for the graph; tests hold the steps against hand-made cases."""
    from .ingest import ingest

    pages = _table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))
    known = demo.entities(spark, sf_dir).where("type = 'Company'").select("name", "aliases", F.xxhash64("name").alias("ord"))
    return _parts_of(ingest(pages, known, extraction.capitalized_mentions, extraction.verb_relations, paragraphs=chunks.lines_as_paragraphs(F.col("text"))))


# ---- resolution


_PAIRED_SQL = LCS_SQL + """
, alike AS (
  SELECT x.name, y.name AS other, x.rank AS r1, y.rank AS r2 FROM n x JOIN n y ON x.rank < y.rank JOIN grid ON a = x.s AND b = y.s AND i = length(a) WHERE 200e0 * r[length(b) + 1] / (length(a) + length(b)) >= 75
)"""


@query(
    "WITH RECURSIVE n AS (SELECT p_name || CASE WHEN min(p_partkey) % 2 = 0 THEN ' Group' ELSE ' SA' END AS name, min(p_partkey) AS rank, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS s FROM part GROUP BY p_name), pairs AS (SELECT DISTINCT x.s AS a, y.s AS b FROM n x JOIN n y ON x.rank < y.rank)"
    + _PAIRED_SQL + """
, heads AS (SELECT name, row_number() OVER (ORDER BY rank) AS k, (SELECT coalesce(list(other ORDER BY r2), []) FROM alike WHERE alike.name = n.name) AS likes FROM n
), walk AS (
  SELECT 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS taken, CAST([] AS STRUCT(canonical VARCHAR, duplicate VARCHAR)[]) AS stars
  UNION ALL
  SELECT h.k, list_concat(w.taken, new), list_concat(w.stars, list_transform(new, lambda d: {'canonical': h.name, 'duplicate': d})) FROM walk w JOIN heads h ON h.k = w.k + 1,
    LATERAL (SELECT CASE WHEN list_contains(w.taken, h.name) THEN [] ELSE list_filter(h.likes, lambda d: NOT list_contains(w.taken, d)) END AS new)
)
SELECT s.canonical, s.duplicate FROM (SELECT unnest(stars) AS s FROM walk WHERE k = (SELECT max(k) FROM heads))"""
)
def duplicate_stars(spark, sf_dir):
    """Heads in order of rank take what is like them and still free."""
    n = _shop_names(spark, sf_dir)
    return resolution.stars(resolution.duplicate_pairs(n, 75.0).select("name", "other"), n)


@query(f"""
WITH RECURSIVE {NAMES_SQL}, n AS (
  SELECT id % 200 AS g, id, name, row_number() OVER (PARTITION BY id % 200 ORDER BY id) AS k, {_normal_sql("name", names.RESOLVER_SUFFIXES)} AS norm, array_to_string(list_sort(string_split(name, ' ')), ' ') AS s FROM names
), pairs AS (SELECT DISTINCT x.s AS a, y.s AS b FROM n x JOIN n y ON x.g = y.g AND x.k < y.k WHERE 200e0 * least(length(x.s), length(y.s)) / (length(x.s) + length(y.s)) >= 85){LCS_SQL}
, score AS (SELECT a, b, 200e0 * r[length(b) + 1] / (length(a) + length(b)) AS score FROM grid WHERE i = length(a)
), of AS (
  SELECT g, map(list(name), list(norm)) AS norms FROM (SELECT DISTINCT g, name, norm FROM n) GROUP BY g
), scored AS (
  SELECT g, map(list(key), list(score)) AS scores FROM (SELECT g, '' AS key, 0e0 AS score FROM n GROUP BY g UNION ALL SELECT DISTINCT x.g, x.name || chr(1) || y.name AS key, score FROM n x JOIN n y ON x.g = y.g AND x.k < y.k JOIN score ON a = x.s AND b = y.s) GROUP BY g
), walk AS (
  SELECT g, 1::BIGINT AS k, [{{'name': name, 'aliases': CAST([] AS VARCHAR[])}}] AS e FROM n WHERE k = 1
  UNION ALL
  SELECT g, k, CASE WHEN hit IS NULL THEN list_append(e, {{'name': name, 'aliases': CAST([] AS VARCHAR[])}})
    ELSE list_transform(e, lambda x, i: CASE WHEN i = hit AND NOT list_contains(list_transform(list_prepend(x.name, x.aliases), lambda a: lower(a)), lower(name)) THEN {{'name': x.name, 'aliases': list_append(x.aliases, name)}} ELSE x END) END
  FROM (
    SELECT g, k, name, e, coalesce(
        nullif(list_position(list_transform(e, lambda x: lower(x.name)), lower(name)), 0),
        CASE WHEN norm <> '' THEN nullif(list_position(list_transform(e, lambda x: len(list_filter(list_prepend(x.name, x.aliases), lambda a: norms[a] = norm)) > 0), true), 0) END,
        CASE WHEN list_max(best) >= 85 THEN list_position(best, list_max(best)) END) AS hit
    FROM (
      SELECT w.g, n.k, n.name, n.norm, w.e, norms, list_transform(w.e, lambda x: list_max(list_transform(list_prepend(x.name, x.aliases), lambda a: scores[a || chr(1) || n.name]))) AS best
      FROM walk w JOIN n ON n.g = w.g AND n.k = w.k + 1 JOIN of ON of.g = w.g JOIN scored ON scored.g = w.g
    )
  )
)
SELECT g AS chunk_id, x.name AS name, 'Company' AS type, array_to_string(x.aliases, '|') AS aliases, 0.8e0 AS confidence FROM (SELECT g, unnest(e) AS x FROM walk w WHERE k = (SELECT max(k) FROM n WHERE n.g = w.g))""")
def resolve_greedy(spark, sf_dir):
    """A fold in order, group by group."""
    n = _names(spark, sf_dir).select((F.col("id") % 200).alias("chunk_id"), F.col("id").alias("pos"), "name", F.lit("Company").alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit(0.8).alias("confidence"))
    return resolution.resolved(n).select("chunk_id", "name", "type", F.array_join("aliases", "|").alias("aliases"), "confidence")


@query("""
WITH p AS (SELECT event_id, 'U' || user_id AS a, 'u' || (event_id % 40) AS b FROM events),
d AS (SELECT DISTINCT least(lower('U' || user_id), 'u' || (floor(value)::BIGINT % 50)) AS a, greatest(lower('U' || user_id), 'u' || (floor(value)::BIGINT % 50)) AS b FROM events)
SELECT event_id, p.a AS entity1, p.b AS entity2 FROM p LEFT JOIN d ON d.a = least(lower(p.a), lower(p.b)) AND d.b = greatest(lower(p.a), lower(p.b)) WHERE d.a IS NULL""")
def undecided_pairs(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    told = e.select(F.col("event_id").alias("ord"), F.concat(F.lit("U"), "user_id").alias("entity1"), F.concat(F.lit("u"), F.floor("value").cast("long") % 50).alias("entity2"), F.lit("merge").alias("decision"))
    return resolution.undecided(e.select("event_id", F.concat(F.lit("U"), "user_id").alias("entity1"), F.concat(F.lit("u"), F.col("event_id") % 40).alias("entity2")), told)


# ---- merging and curation


@query(G + ", k AS (SELECT name FROM entities WHERE confidence >= 0.7) SELECT src, rel_type, dst, confidence FROM edges WHERE src IN (SELECT name FROM k) AND dst IN (SELECT name FROM k)")
def known_ends(spark, sf_dir):
    return upserts.with_known_ends(demo.edges(spark, sf_dir), demo.entities(spark, sf_dir).where("confidence >= 0.7")).select("src", "rel_type", "dst", "confidence")


@query(G + MAPPING_SQL + " SELECT coalesce(a.canonical, src) AS src, rel_type, coalesce(b.canonical, dst) AS dst, confidence FROM edges LEFT JOIN mapping a ON a.duplicate = src LEFT JOIN mapping b ON b.duplicate = dst")
def renamed_ends(spark, sf_dir):
    m = _supplier_mapping(spark, sf_dir).select(F.col("duplicate").alias("old_name"), F.col("canonical").alias("name"))
    return upserts.remapped(demo.edges(spark, sf_dir), m).select("src", "rel_type", "dst", "confidence")


@query(G + MAPPING_SQL + """
, e AS (SELECT src, CASE WHEN rel_type = 'SUBSIDIARY_OF' THEN 'RELATED_TO' ELSE rel_type END AS rel_type, dst FROM edges)
SELECT DISTINCT src, rel_type, dst FROM (
  SELECT src, rel_type, dst FROM e WHERE src NOT IN (SELECT duplicate FROM mapping) AND dst NOT IN (SELECT duplicate FROM mapping)
  UNION ALL SELECT * FROM (SELECT coalesce(a.canonical, src) AS src, rel_type, coalesce(b.canonical, dst) AS dst FROM e LEFT JOIN mapping a ON a.duplicate = src LEFT JOIN mapping b ON b.duplicate = dst
    WHERE rel_type = 'RELATED_TO' AND (a.canonical IS NOT NULL OR b.canonical IS NOT NULL)) WHERE src <> dst
)""")
def published_merge(spark, sf_dir):
    """Merging as published: of a duplicate's edges only RELATED_TO ones move (here those of subsidiaries have that type)."""
    kind = F.when(F.col("rel_type") == "SUBSIDIARY_OF", "RELATED_TO").otherwise(F.col("rel_type"))
    e = demo.edges(spark, sf_dir).withColumn("rel_type", kind)
    return curation.merge(demo.entities(spark, sf_dir), e, _supplier_mapping(spark, sf_dir), parity=True)[1].select("src", "rel_type", "dst")


@query(G + MAPPING_SQL + """
, moved AS (
  SELECT DISTINCT coalesce(a.canonical, src) AS src, rel_type, coalesce(b.canonical, dst) AS dst, a.canonical IS NOT NULL OR b.canonical IS NOT NULL AS moved FROM edges LEFT JOIN mapping a ON a.duplicate = src LEFT JOIN mapping b ON b.duplicate = dst
)
SELECT 'edge' AS part, src AS a, rel_type AS b, dst AS c FROM (SELECT DISTINCT src, rel_type, dst FROM moved WHERE src <> dst OR NOT moved)
UNION ALL SELECT 'entity', e.name, CASE WHEN m.canonical IS NOT NULL THEN 'Group' ELSE type END, NULL FROM entities e LEFT JOIN mapping m ON m.canonical = e.name WHERE e.name NOT IN (SELECT duplicate FROM mapping)""")
def manual_merge(spark, sf_dir):
    """Merges by hand, with a new type; rules whose canonical entity is missing do nothing."""
    rules = _supplier_mapping(spark, sf_dir).withColumn("new_type", F.lit("Group"))
    lost = rules.select(F.lit("Nobody").alias("canonical"), F.col("canonical").alias("duplicate"), "new_type")
    e, r = curation.manual_merge(demo.entities(spark, sf_dir), demo.edges(spark, sf_dir), rules.unionByName(lost))
    return r.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("rel_type").alias("b"), F.col("dst").alias("c")).unionByName(e.select(F.lit("entity").alias("part"), F.col("name").alias("a"), F.col("type").alias("b"), F.lit(None).cast("string").alias("c")))


@query("""
WITH v AS (
  SELECT name, min(type) AS type, count(*) AS connections FROM (
    SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') ELSE p_name END AS name,
           CASE WHEN p_size % 10 < 5 THEN 'Company' WHEN length(p_name) % 2 = 0 THEN 'Sector' ELSE 'Person' END AS type FROM part) GROUP BY name
), g AS (SELECT lower(name) AS key FROM v GROUP BY 1 HAVING count(*) > 1 AND (count(DISTINCT type) = 1 OR bool_and(type IN ('Company', 'Sector')))),
r AS (SELECT name, connections, lower(name) AS key, row_number() OVER w AS k FROM v WHERE lower(name) IN (SELECT key FROM g)
  WINDOW w AS (PARTITION BY lower(name) ORDER BY connections DESC, (name = array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(name, ' ')], ' ')) DESC, name))
SELECT count(DISTINCT key) AS groups, count(*) AS entities_to_merge, coalesce(sum(connections), 0)::BIGINT AS total_connections FROM r WHERE k > 1""")
def merge_report(spark, sf_dir):
    from .catalog import _variants

    return curation.merge_report(_variants(spark, sf_dir))


@query(G + "SELECT 'entities' AS part, type AS kind, count(*) AS n FROM entities GROUP BY type UNION ALL SELECT 'edges', rel_type, count(*) FROM edges GROUP BY rel_type UNION ALL SELECT 'mentions', NULL, count(*) FROM mentions")
def saved_graph(spark, sf_dir):
    """The graph's tables written, names checked to be unique, and read back by type."""
    path = f"{folder(spark)}/graphloom/graph-saved"
    upserts.save(demo.entities(spark, sf_dir), demo.edges(spark, sf_dir), demo.mentions(spark, sf_dir), path)
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    rows = read("entities").groupBy(F.lit("entities").alias("part"), F.col("type").alias("kind")).agg(F.count("*").alias("n"))
    rows = rows.unionByName(read("edges").groupBy(F.lit("edges").alias("part"), F.col("rel_type").alias("kind")).agg(F.count("*").alias("n")))
    return rows.unionByName(read("mentions").agg(F.count("*").alias("n")).select(F.lit("mentions").alias("part"), F.lit(None).cast("string").alias("kind"), "n"))


@query(G + "SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM mentions) AS mentions, 0 AS left_over")
def cleared_graph(spark, sf_dir):
    e, r, m, counts = upserts.cleared(demo.entities(spark, sf_dir), demo.edges(spark, sf_dir), demo.mentions(spark, sf_dir))
    left = e.select("name").unionByName(r.select(F.col("src").alias("name"))).unionByName(m.select(F.col("entity_name").alias("name")))
    return counts.join(F.broadcast(left.agg(F.count("*").cast("int").alias("left_over"))))


@query(G + OVERVIEW_SQL + """
SELECT (SELECT count(*) FROM view WHERE target IS NOT NULL) AS edge_count, (SELECT count(DISTINCT id) FROM (SELECT name AS id FROM view UNION ALL SELECT target FROM view WHERE target IS NOT NULL)) AS node_count""")
def view_stats(spark, sf_dir):
    return graph.view_stats(QUERIES["overview_edges"](spark, sf_dir))


# ---- registry


_SEED_ROWS = ", ".join("({}, '{}', '{}', [{}])".format(i + 1, n.replace("'", "''"), t, ", ".join("'" + x.replace("'", "''") + "'" for x in a)) for i, (n, t, a) in enumerate(registry.SEED))


@query(f"""
WITH s(id, name, type, aliases) AS (VALUES {_SEED_ROWS})
SELECT id::BIGINT AS id, name, type, 'entity' AS kind FROM s UNION ALL SELECT id, unnest(aliases), NULL, 'alias' FROM s""")
def registry_seed(spark, sf_dir):
    e, a = registry.seed(spark)
    rows = e.select("id", F.col("canonical_name").alias("name"), F.col("entity_type").alias("type"), F.lit("entity").alias("kind"))
    return rows.unionByName(a.select(F.col("entity_id").alias("id"), F.col("alias_name").alias("name"), F.lit(None).cast("string").alias("type"), F.lit("alias").alias("kind")))


@query(f"""
WITH {REGISTRY_SQL}
SELECT lower(canonical_name) || ':' || entity_type AS cache_key, canonical_name FROM (SELECT * FROM reg ORDER BY mention_count DESC, canonical_name LIMIT 1000)
UNION ALL SELECT lower('Part ' || p_name) || ':' || entity_type, canonical_name FROM reg""")
def registry_warm(spark, sf_dir):
    kept, names_ = registry.warm(*_registry(spark, sf_dir))
    return kept.select("cache_key", "canonical_name").unionByName(names_)


@query(f"WITH {REGISTRY_SQL} SELECT id, canonical_name FROM reg WHERE list_contains(string_split(lower(canonical_name), ' '), 'rod') AND entity_type = 'Company'")
def registry_full_text(spark, sf_dir):
    return registry.full_text(_registry(spark, sf_dir)[0], "rod company").select("id", "canonical_name")


@query(f"""
WITH {REGISTRY_SQL}, e AS (SELECT id, canonical_name, entity_type, CASE WHEN id % 7 = 0 THEN 1.5e0 ELSE 0.5e0 END AS confidence FROM reg UNION ALL SELECT id + 1000000000, canonical_name, entity_type, 0.5e0 FROM reg WHERE id % 3 = 0),
a AS (SELECT id AS entity_id, 'Part ' || p_name AS alias_name FROM reg UNION ALL SELECT id, 'Part ' || p_name FROM reg WHERE id % 5 = 0 UNION ALL SELECT -id, 'Part ' || p_name FROM reg WHERE id % 11 = 0)
SELECT 'confidence_range' AS rule, id::VARCHAR AS key FROM e WHERE NOT confidence BETWEEN 0 AND 1
UNION ALL SELECT 'unique_name', canonical_name || ':' || entity_type FROM e GROUP BY canonical_name, entity_type HAVING count(*) > 1
UNION ALL SELECT 'alias_without_entity', entity_id::VARCHAR FROM a WHERE entity_id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'unique_alias', entity_id::VARCHAR || ':' || alias_name FROM a GROUP BY entity_id, alias_name HAVING count(*) > 1""")
def registry_violations(spark, sf_dir):
    e, a = _registry(spark, sf_dir)
    e = e.withColumn("confidence", F.when(F.col("id") % 7 == 0, 1.5).otherwise(F.col("confidence")))
    e = e.unionByName(e.where("id % 3 = 0").withColumns({"id": F.col("id") + 1000000000, "confidence": F.lit(0.5)}))
    a = a.unionByName(a.where("entity_id % 5 = 0")).unionByName(a.where("entity_id % 11 = 0").withColumn("entity_id", -F.col("entity_id")))
    return registry.violations(e, a)


@query(f"""
WITH {REGISTRY_SQL}, n AS (SELECT o_orderkey AS ord, 'Brand new ' || (o_custkey % 30) AS name, o_orderstatus AS s FROM orders)
SELECT id, canonical_name, printf('{{"part":%d}}', id) AS metadata FROM reg
UNION ALL SELECT (SELECT max(id) FROM reg) + row_number() OVER (ORDER BY min(ord)), arg_min(name, ord), printf('{{"status":"%s"}}', arg_min(s, ord)) FROM n GROUP BY lower(name)""")
def registry_metadata(spark, sf_dir):
    """New entities have the metadata of their first mention and consecutive ids; known ones keep theirs."""
    e, _ = _registry(spark, sf_dir)
    e = e.withColumns({"first_doc": F.lit(None).cast("string"), "last_doc": F.lit(None).cast("string"), "metadata": F.to_json(F.struct(F.col("id").alias("part")))})
    o = _table(spark, sf_dir, "orders")
    m = o.select(F.concat(F.lit("Brand new "), F.col("o_custkey") % 30).alias("canonical_name"), F.lit("Company").alias("entity_type"), F.lit("d").alias("document"), F.col("o_orderkey").alias("ord"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("metadata"))
    return registry.registered(e, m).select("id", "canonical_name", "metadata")


#: Kinds that answers of relation providers may name; those of the vocabulary alone pass.
KINDS = (*ENTITY_TYPES, "Alien", "company", "")


@query("WITH k(i, kind) AS (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KINDS)) + f") SELECT c_custkey AS chunk_id, c_name AS name, kind AS type, 0.8e0 AS confidence FROM customer JOIN k ON i = c_custkey % {len(KINDS)} WHERE kind IN ({', '.join(repr(k) for k in ENTITY_TYPES)})")
def given_types(spark, sf_dir):
    """Answers with entities of all kinds, without a confidence."""
    c = _table(spark, sf_dir, "customer")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("c_custkey") % len(KINDS) + 1).cast("int"))
    r = c.select(F.col("c_custkey").alias("chunk_id"), F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("name"), kind.alias("type"))).alias("entities"))).alias("response"))
    return extraction.given_entities(extraction.parsed(r)).select("chunk_id", "name", "type", "confidence")
