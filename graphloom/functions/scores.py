"""Confidence of registered entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def boost(mentions: Column, relations: Column) -> Column:
    by_mentions = F.least(F.lit(0.25), F.log(mentions + 1) * 0.05)
    return by_mentions + F.when(relations > 0, F.least(F.lit(0.15), F.log(relations + 1) * 0.03)).otherwise(0.0)


def confidence(base: Column, mentions: Column, relations: Column, validated: Column) -> Column:
    """One step: the base with boosts by mentions and relations, at least 0.95 if validated, at most 1."""
    c = base + boost(mentions, relations)
    return F.least(F.lit(1.0), F.when(validated, F.greatest(c, F.lit(0.95))).otherwise(c))


def confidence_after(base: Column, mentions: Column, relations: Column, validated: Column) -> Column:
    """The confidence that `mentions` mentions one after another leave: each step starts from the last."""
    steps = F.when(mentions >= 2, F.sequence(F.lit(2), mentions.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, base.cast("double"), lambda c, n: confidence(c, n, relations, validated))
