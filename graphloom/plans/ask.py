"""Questions in words: the first pattern that fits names a plan, which a DataFrame answers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import graph, traversal

_STOP = re.compile(r"^(?:the|a|an)\s+|\s*\?+\s*$", re.IGNORECASE)
MAX_WORDS, PATH_HOPS = 5, 3


@dataclass(frozen=True)
class Plan:
    kind: str
    args: tuple[str, ...]
    interpretation: str


def _name(s: str) -> str:
    while (t := _STOP.sub("", s).strip(" ?.")) != s:
        s = t
    return s


#: (pattern, kind, what it means); groups are the arguments.
PATTERNS = (
    (r"\bwho owns? (.+)", "owners", "owners of {0}"),
    (r"\bwhat companies\b.*?\blinked to (.+)", "linked_companies", "companies linked to {0}"),
    (r"\bwhat groups\b.*?\boperate in (.+)", "operating_in", "what operates in {0}"),
    (r"\bshared? directors\b", "shared_directors", "companies with a common director"),
    (r"\brelationships?\b(?:\s+(?:between|of|from))? (.+?) and (.+)", "path", "how {0} and {1} are related"),
)


def plan_question(text: str) -> Plan:
    for pattern, kind, means in PATTERNS:
        if m := re.search(pattern, text, re.IGNORECASE):
            args = tuple(_name(g) for g in m.groups())
            return Plan(kind, args, means.format(*args))
    name = _name(text)
    if name and len(text.split()) <= MAX_WORDS:
        return Plan("search", (name,), f"entities named {name}")
    raise ValueError(f"no pattern fits the question {text!r}")


def answer(plan: Plan, entities: DataFrame, edges: DataFrame) -> DataFrame:
    if plan.kind == "owners":
        return graph.owners(entities, edges, *plan.args)
    if plan.kind == "linked_companies":
        return graph.linked_companies(entities, edges, *plan.args)
    if plan.kind == "operating_in":
        return graph.operating_in(entities, edges, *plan.args)
    if plan.kind == "shared_directors":
        return graph.shared_directors(edges)
    if plan.kind == "search":
        return graph.search(entities, *plan.args)
    ends = [graph.named(entities, a).select("name").first() for a in plan.args]
    missing = [a for a, e in zip(plan.args, ends, strict=True) if e is None]
    if missing:
        raise ValueError(f"no entity named {' or '.join(missing)}")
    return traversal.shortest_path(edges, ends[0]["name"], ends[1]["name"], PATH_HOPS)


def ask(text: str, entities: DataFrame, edges: DataFrame) -> tuple[Plan, DataFrame]:
    plan = plan_question(text)
    return plan, answer(plan, entities, edges)
