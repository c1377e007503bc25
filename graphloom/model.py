"""Vocabulary and row types of the property graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed vocabularies, and names that stand for a relation type.
ENTITY_TYPES = ("Person", "Company", "Group", "Bank", "Organization", "GovernmentEntity", "Sector", "Location", "Stock", "StockExchange", "Document", "Article", "Contract", "Event")
RELATION_TYPES = ("OWNS", "OWNS_SHARES", "DIRECTOR_OF", "MEMBER_OF_BOARD", "SUBSIDIARY_OF", "PART_OF_GROUP", "PARTNER_OF", "ACQUIRED", "INVESTED_IN", "FOUNDED", "LISTED_ON", "TRADES_AS", "OPERATES_IN", "MENTIONED_IN", "MENTIONED_WITH", "RELATED_TO")
RELATION_ALIASES = {
    "OWNED_BY": "OWNS",
    "SHAREHOLDER_OF": "OWNS_SHARES", "HOLDS_SHARES_IN": "OWNS_SHARES", "HAS_STAKE_IN": "OWNS_SHARES",
    "IS_DIRECTOR_OF": "DIRECTOR_OF", "HAS_DIRECTOR": "DIRECTOR_OF",
    "IS_MEMBER_OF_BOARD": "MEMBER_OF_BOARD", "HAS_BOARD_MEMBER": "MEMBER_OF_BOARD", "HAS_MEMBER_OF_BOARD": "MEMBER_OF_BOARD",
    "IS_SUBSIDIARY_OF": "SUBSIDIARY_OF", "HAS_SUBSIDIARY": "SUBSIDIARY_OF",
    "IS_PARTNER_OF": "PARTNER_OF", "PARTNERS_WITH": "PARTNER_OF",
    "ACQUIRING": "ACQUIRED", "ACQUIRED_BY": "ACQUIRED",
    "FOUNDED_BY": "FOUNDED", "IS_FOUNDED_BY": "FOUNDED", "FOUNDERS_OF": "FOUNDED", "IS_FOUNDER_OF": "FOUNDED",
    "INVESTS_IN": "INVESTED_IN", "IS_INVESTOR_IN": "INVESTED_IN",
    "OPERATES_IN_SECTOR": "OPERATES_IN", "WORKS_IN": "OPERATES_IN",
    "MENTIONED_BY": "MENTIONED_IN", "MENTIONS": "MENTIONED_IN", "IS_MENTIONED_IN": "MENTIONED_IN", "APPEARS_IN": "MENTIONED_IN",
    "MEMBER_OF_GROUP": "PART_OF_GROUP", "BELONGS_TO_GROUP": "PART_OF_GROUP", "PART_OF": "PART_OF_GROUP",
    "LISTED_IN": "LISTED_ON", "TRADED_ON": "LISTED_ON",
    "TICKER_SYMBOL": "TRADES_AS",
    "ASSOCIATED_WITH": "RELATED_TO", "CONNECTED_TO": "RELATED_TO", "LINKED_TO": "RELATED_TO",
}
#: Names of the passive or possessive side: with direction="intended" their ends change places.
INVERSE_ALIASES = ("OWNED_BY", "HAS_DIRECTOR", "HAS_BOARD_MEMBER", "HAS_MEMBER_OF_BOARD", "HAS_SUBSIDIARY", "ACQUIRED_BY", "FOUNDED_BY", "IS_FOUNDED_BY", "MENTIONS")

ENTITY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("confidence", T.DoubleType()),
    ]
)
RELATION = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("relation", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence", T.StringType()),
    ]
)


def canonical_relation(name: Column) -> Column:
    """The relation type that a name is or stands for, else null. Names hold no space, are upper case and at most 50 long."""
    aliases = F.create_map(*[F.lit(x) for kv in RELATION_ALIASES.items() for x in kv])
    shaped = ~name.contains(" ") & (F.upper(name) == name) & (F.lower(name) != name) & (F.length(name) <= 50)
    return F.when(shaped, F.when(name.isin(*RELATION_TYPES), name).otherwise(F.try_element_at(aliases, name)))
