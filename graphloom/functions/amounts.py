"""Column functions that read shares, amounts and counts out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(\d+\.?\d*)"


def _number(c: Column) -> Column:
    found = F.regexp_extract(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), NUMBER, 1)
    return F.when(found != "", found.try_cast("double"))


def percentage(c: Column) -> Column:
    return _number(c)


def amount(c: Column, strict: bool = False) -> Column:
    """Amount in dinars. strict also reads MTND and KTND, and commas before three digits as thousands."""
    up = F.upper(c)
    if strict:
        up = F.regexp_replace(up, r"(?<=\d),(?=\d{3}(\D|$))", "")
        million, thousand = up.rlike("MTND|MDT|MD|MILLION"), up.rlike("KTND|KDT|MILLE")
    else:
        for word in ("TND", "DT", "DINARS"):
            up = F.replace(up, F.lit(word), F.lit(""))
        million, thousand = up.rlike("MTND|MD|MILLION"), up.rlike("KTND|MILLE")
    return _number(up) * F.when(million, 1e6).when(thousand, 1e3).otherwise(1.0)


def share_count(c: Column) -> Column:
    low = F.lower(c)
    for word in ("actions", "parts", "titres", " ", ",", "."):
        low = F.replace(low, F.lit(word), F.lit(""))
    found = F.regexp_extract(low, r"(\d+)", 1)
    return F.when(found != "", found.try_cast("long"))
