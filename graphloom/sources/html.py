"""Articles and links out of HTML, with regular expressions in the JVM."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import slug, strip

#: Where sites keep title, content and date: (title, content, date pattern with one group).
SELECTORS = {
    "generic": (r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<article[^>]*>(.*?)</article>", r"(?is)<time[^>]*\bdatetime=[\"']([^\"']*)"),
    "tap": (r"(?is)<h1[^>]*\barticle-title\b[^>]*>(.*?)</h1>", r"(?is)<div[^>]*\barticle-content\b[^>]*>(.*?)</div>", r"(?is)<time[^>]*\barticle-date\b[^>]*\bdatetime=[\"']([^\"']*)"),
    "african_manager": (r"(?is)<h1[^>]*\bentry-title\b[^>]*>(.*?)</h1>", r"(?is)<div[^>]*\bentry-content\b[^>]*>(.*?)</div>", r"(?is)<time[^>]*\bentry-date\b[^>]*\bdatetime=[\"']([^\"']*)"),
    "ilboursa": (r"(?is)<h1[^>]*\barticle-title\b[^>]*>(.*?)</h1>", r"(?is)<div[^>]*\barticle-body\b[^>]*>(.*?)</div>", r"(?is)<span[^>]*\barticle-date\b[^>]*>(.*?)</span>"),
}
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def visible(html: Column, between: str) -> Column:
    """The text pieces of HTML, stripped, empty ones left out, joined by `between`."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    pieces = F.filter(F.transform(F.split(bare, r"<[^>]*>"), strip), lambda x: x != "")
    text = F.array_join(pieces, between)
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def fetched(addresses: DataFrame, fetch: Callable[[str], str | None], wait: float = 2.0) -> DataFrame:
    """addresses (page_id, url) with html, by a function that the caller gives (with its own time-out): null where it fails.
    Each task waits so many seconds between two requests; the number of tasks bounds the requests at one time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for batch in batches:
            found = []
            for url in batch["url"]:
                time.sleep(max(0.0, last + wait - time.monotonic()) if last else 0.0)
                last = time.monotonic()
                try:
                    found.append(fetch(url))
                except Exception:  # noqa: BLE001  a page that can't be had is left out by what reads it
                    found.append(None)
            yield batch.assign(html=pd.Series(found, dtype=object, index=batch.index))

    kind = dict(addresses.dtypes)["page_id"]
    return addresses.select("page_id", "url").mapInPandas(run, f"page_id {kind}, url string, html string")


def _found(html: Column, pattern: str) -> Column:
    """The first group of the first match; null: none. The page is searched once, and the group sought in what matched."""
    return F.regexp_extract(F.regexp_substr(html, F.lit(pattern)), pattern, 1)


def articles(pages: DataFrame, site: str = "generic") -> DataFrame:
    """(page_id, url, title, content, date, source) of pages (page_id, url, html); those without title or content are left out."""
    if site not in SELECTORS:
        raise ValueError(f"unknown site {site!r}; known: {', '.join(SELECTORS)}")
    title, content, date = SELECTORS[site]
    h = F.col("html")
    found = computed(pages, ["page_id", "url"], title=_found(h, title), content=_found(h, content), date=_found(h, date)).where(F.col("title").isNotNull() & F.col("content").isNotNull())
    return found.select("page_id", "url", visible(F.col("title"), "").alias("title"), visible(F.col("content"), "\n").alias("content"), "date", F.lit(site).alias("source"))


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however many expressions and filters then use them."""
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_made")
    return df.select(*keep, made).select(*keep, "_made.*")


def links(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """(page_id, pos, href, target): links in order, resolved against the page's address."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*\bhref=[\"']([^\"'#]+)"), F.lit(1))).alias("pos", "href"))
    root = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    base = F.regexp_extract("url", r"^(https?://[^?#]*/)", 1)
    target = F.when(F.col("href").rlike(r"^https?://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.regexp_extract("url", "^(https?:)", 1), "href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(F.when(base == "", F.concat(root, F.lit("/"))).otherwise(base), "href"))
    out = found.select("page_id", "pos", "href", target.alias("target"))
    return out if limit is None else out.where(F.col("pos") < limit)


def companies(pages: DataFrame, pattern: str) -> DataFrame:
    """(name, id, url) of anchors whose address matches: the id is the last step of its path."""
    a = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*\bhref=[\"'][^\"']+[\"'][^>]*>.*?</a>)"), F.lit(1))).alias("a"))
    href = F.regexp_extract("a", r"(?is)\bhref=[\"']([^\"']+)", 1)
    return a.select(visible(F.col("a"), "").alias("name"), F.element_at(F.split(F.regexp_replace(href, "/+$", ""), "/"), -1).alias("id"), href.alias("url")).where(F.col("url").rlike(pattern) & (F.col("name") != ""))


def article_files(articles_: DataFrame, today: Column) -> DataFrame:
    """(file_name, body): an article as a text file with head lines."""
    date = F.coalesce("date", today.cast("string"))
    name = F.concat_ws("_", date, "source", slug(F.col("title")))
    head = F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("URL: "), "url"), F.concat(F.lit("Date: "), date), F.concat(F.lit("Source: "), "source"))
    return articles_.select(F.concat(name, F.lit(".txt")).alias("file_name"), F.concat(head, F.lit("\n\n"), "content").alias("body"))


def source_counts(articles_: DataFrame, known: list[str] | None = None) -> DataFrame:
    """(source, n, total); sources that aren't known are an error."""
    if known is not None:
        articles_ = articles_.withColumn("source", F.when(F.col("source").isin(*known), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("unknown source "), "source"))))
    by = articles_.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return by.join(F.broadcast(articles_.agg(F.count(F.lit(1)).alias("total"))))
