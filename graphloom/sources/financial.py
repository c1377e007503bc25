"""Company records as entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPANY_CONFIDENCE, PERSON_CONFIDENCE, RELATION_CONFIDENCE = 0.95, 0.9, 0.9
SHAREHOLDERS = "array<struct<name:string,share_count:bigint,percentage:double,value_tnd:double,shareholder_type:string>>"
COMPANY = f"name string, ticker string, sector string, legal_form string, headquarters string, ipo_date string, market_cap_tnd double, ceo string, source_url string, shareholders {SHAREHOLDERS}"


def _number(c: Column) -> Column:
    return F.when(c.isNull() | (c == 0), "0").otherwise(c.cast("string"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def placeholders(ids: DataFrame, root: str) -> DataFrame:
    """Company records of which only the id (id string) is known: it is the name, and the last step of the address."""
    no = {c: F.lit(None) for c in ("ticker", "sector", "legal_form", "headquarters", "ipo_date", "ceo")}
    rows = ids.select(F.col("id").alias("name"), *[v.cast("string").alias(c) for c, v in no.items()], F.lit(None).cast("double").alias("market_cap_tnd"), F.concat(F.lit(root.rstrip("/") + "/"), "id").alias("source_url"), F.array().cast(SHAREHOLDERS).alias("shareholders"))
    return rows.select(*[c.split(" ")[0] for c in COMPANY.replace(SHAREHOLDERS, "array").split(", ")])


def company_graph(companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of companies, their shareholders and heads."""
    no = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    properties = F.create_map(*[x for k in ("ticker", "sector", "legal_form", "headquarters", "ipo_date") for x in (F.lit(k), _text(k))], F.lit("market_cap_tnd"), _number(F.col("market_cap_tnd")), F.lit("source"), _text("source_url"))
    firms = companies.select("name", F.lit("Company").alias("type"), F.lit(COMPANY_CONFIDENCE).alias("confidence"), properties.alias("properties"))
    held = companies.select("name", "source_url", F.explode("shareholders").alias("s"))
    heads = companies.where(F.coalesce("ceo", F.lit("")) != "")
    people = held.select(F.col("s.name").alias("name")).unionByName(heads.select(F.col("ceo").alias("name"))).select("name", F.lit("Person").alias("type"), F.lit(PERSON_CONFIDENCE).alias("confidence"), no.alias("properties"))
    share = F.create_map(F.lit("percentage"), _number(F.col("s.percentage")), F.lit("share_count"), _number(F.col("s.share_count")), F.lit("value_tnd"), _number(F.col("s.value_tnd")), F.lit("shareholder_type"), F.coalesce("s.shareholder_type", F.lit("")))
    owns = held.select(F.col("s.name").alias("source"), F.lit("OWNS_SHARES").alias("relation"), F.col("name").alias("target"), F.lit(RELATION_CONFIDENCE).alias("confidence"), F.concat(F.lit("Shareholder data from "), F.coalesce("source_url", F.lit("None"))).alias("evidence"), share.alias("properties"))
    runs = heads.select(F.col("ceo").alias("source"), F.lit("DIRECTOR_OF").alias("relation"), F.col("name").alias("target"), F.lit(RELATION_CONFIDENCE).alias("confidence"), F.lit(None).cast("string").alias("evidence"), F.create_map(F.lit("title"), F.lit("CEO")).alias("properties"))
    return firms.unionByName(people), owns.unionByName(runs)
