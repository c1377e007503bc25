"""From chunks to entities and relations: mention and relation providers, their JSON, and merging."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import entity_type, strip, valid_extracted_name, valid_mention
from ..model import ENTITY_TYPES, RELATION_TYPES, canonical_relation
from ..storage import written
from .chunks import low_quality, prompt

MENTION_CONFIDENCE, GIVEN_CONFIDENCE, MIN_CONFIDENCE = 0.8, 0.8, 0.7
JSON_SCHEMA = "entities array<struct<name:string,type:string,confidence:double,aliases:array<string>>>, relations array<struct<source:string,relation:string,target:string,confidence:double,evidence:string>>"
#: chunks (chunk_id, text) -> (chunk_id, pos, mention, label)
MentionProvider = Callable[[DataFrame], DataFrame]
#: chunks (chunk_id, text, ...) -> (chunk_id, response): JSON of JSON_SCHEMA; null where the provider failed
RelationProvider = Callable[[DataFrame], DataFrame]

#: Verbs between two names and the relation that they tell.
VERBS = {"owns": "OWNS", "détient": "OWNS_SHARES", "acquired": "ACQUIRED", "founded": "FOUNDED", "directs": "DIRECTOR_OF", "invested in": "INVESTED_IN"}
#: Possessive, as nothing that may follow begins within a run: a word goes as far as it can, and verbs begin with small letters.
NAME = r"\p{Lu}[\p{L}\p{N}'#_-]*+(?: \p{Lu}[\p{L}\p{N}'#_-]*+)*+"


def capitalized_mentions(chunks: DataFrame) -> DataFrame:
    """A provider without a model: runs of capitalized words."""
    found = chunks.select("chunk_id", F.posexplode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("pos", "mention"))
    return found.withColumn("label", F.when(F.col("mention").rlike(r"^\p{Lu}{2,}$"), "ORG").when(F.size(F.split("mention", " ")) == 2, "PER").otherwise("LOC"))


def gazetteer_mentions(names: DataFrame) -> MentionProvider:
    """A provider from a table (name, label): words of the texts are joined with the names' first words."""

    def provide(chunks: DataFrame) -> DataFrame:
        first = names.select("name", "label", F.element_at(F.split("name", " "), 1).alias("word"))
        words = chunks.select("chunk_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}'#_-]+"), F.lit(0)))).alias("word"))
        hit = words.join(first, "word").select("chunk_id", F.instr("text", F.col("name")).alias("pos"), F.col("name").alias("mention"), "label")
        return hit.where("pos > 0")

    return provide


def verb_relations(chunks: DataFrame) -> DataFrame:
    """A provider without a model: NAME verb NAME becomes the JSON that a language model would give."""
    def told(verb: str, kind: str) -> Column:
        def one(m: Column) -> Column:
            return F.struct(F.split_part(m, F.lit(f" {verb} "), F.lit(1)).alias("source"), F.lit(kind).alias("relation"), F.split_part(m, F.lit(f" {verb} "), F.lit(2)).alias("target"), F.lit(0.9).alias("confidence"), m.alias("evidence"))

        found = F.regexp_extract_all("text", F.lit(f"({NAME}) {verb} ({NAME})"), F.lit(0))
        # most texts hold no such verb; a null text has null relations
        held = F.when(F.col("text").contains(f" {verb} "), found).when(F.col("text").isNotNull(), F.array().cast("array<string>"))
        return F.transform(held, one)

    rows = F.concat(*[told(verb, kind) for verb, kind in VERBS.items()])
    ends = F.flatten(F.transform("relations", lambda r: F.array(r["source"], r["target"])))
    entities = F.transform(F.array_distinct(ends), lambda n: F.struct(n.alias("name"), F.lit("Company").alias("type"), F.lit(0.8).alias("confidence")))
    return chunks.withColumn("relations", rows).select("chunk_id", F.to_json(F.struct(entities.alias("entities"), "relations")).alias("response"))


def by_language(providers: dict[str, MentionProvider], language: str, default: str = "fr") -> MentionProvider:
    """The provider for a language by the first two letters of its code, else the default's, else any; without any, no mentions."""
    chosen = providers.get(language[:2].lower()) or providers.get(default) or next(iter(providers.values()), None)
    if chosen is not None:
        return chosen
    return lambda chunks: chunks.select("chunk_id", F.lit(0).alias("pos"), F.col("text").alias("mention"), F.lit("").alias("label")).where("false")


def model_relations(complete: Callable[[str], str], retries: int = 3, wait: float = 1.0) -> RelationProvider:
    """A provider from a function that completes a prompt, such as a client of a language model: time-outs and broken
    connections are tried again after 1, 2, 4 ... times `wait` seconds; other errors leave the response null."""

    def provide(chunks: DataFrame) -> DataFrame:
        have = set(chunks.columns)
        column = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
        names = F.col("names") if "names" in have else F.array().cast("array<string>")
        asked = chunks.select("chunk_id", prompt(F.col("text"), column("before"), column("after"), names).alias("prompt"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"chunk_id": batch["chunk_id"], "response": [_completed(complete, p, retries, wait) for p in batch["prompt"]]})

        return asked.mapInPandas(run, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, response string")

    return provide


def _completed(complete: Callable[[str], str], text: str, retries: int, wait: float) -> str | None:
    for k in range(retries + 1):
        try:
            return complete(text)
        except (TimeoutError, ConnectionError):
            time.sleep(wait * 2**k if k < retries else 0)
        except Exception:  # noqa: BLE001  the provider's own failure: the chunk keeps its recognized entities
            return None
    return None


def system_prompt() -> str:
    """What a language model is told before the chunks: the vocabularies, the rules and the form of its answer."""
    return "\n".join(
        [
            "You read business news and reports and answer with JSON alone.",
            "Kinds of entities: " + ", ".join(ENTITY_TYPES) + ".",
            "Kinds of relations: " + ", ".join(RELATION_TYPES) + ".",
            "Name only entities with proper names; job titles, dates, page numbers and lines of a table of contents are none.",
            "Tell only relations that the text states, by the kinds above; where there are none, give empty lists.",
            'Form: {"entities": [{"name": "", "type": "", "confidence": 0.0, "aliases": []}], "relations": [{"source": "", "relation": "", "target": "", "confidence": 0.0, "evidence": ""}]}',
        ]
    )


class RateLimited(Exception):
    """The service takes no more requests until `reset` (seconds since 1970; null: unknown)."""

    def __init__(self, message: str, reset: float | None):
        super().__init__(message)
        self.reset = reset


#: (method, path, JSON body or null) -> (status, headers, JSON); raises TimeoutError or ConnectionError
Transport = Callable[[str, str, dict | None], tuple[int, dict[str, str], Any]]


@dataclass
class HostedModel:
    """A hosted language model behind a transport that the caller gives: completion, state of the rate limit, what there is.

    An instance called with a prompt completes it, as model_relations wants it."""

    transport: Transport
    model: str
    system: str = field(default_factory=system_prompt)
    remaining: int | None = None
    reset: float | None = None

    def _ask(self, method: str, path: str, body: dict | None = None) -> tuple[int, Any]:
        status, headers, answer = self.transport(method, path, body)
        low = {k.lower(): v for k, v in headers.items()}
        try:
            self.remaining = int(low.get("x-ratelimit-remaining", self.remaining)) if "x-ratelimit-remaining" in low else self.remaining
            self.reset = int(low["x-ratelimit-reset"]) / 1000 if "x-ratelimit-reset" in low else self.reset  # given in milliseconds
        except ValueError:
            pass  # headers that can't be read tell nothing
        return status, answer

    def __call__(self, prompt_: str) -> str:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt_}]
        status, answer = self._ask("POST", "/chat/completions", {"model": self.model, "messages": messages})
        if status == 429:
            raise RateLimited("too many requests", self.reset)
        if status != 200:
            raise ValueError(f"the model's service answered {status}")
        return answer["choices"][0]["message"]["content"]

    def available(self) -> bool:
        try:
            return self._ask("GET", "/models")[0] == 200
        except (TimeoutError, ConnectionError):
            return False

    def models(self) -> list[str]:
        """Names of the service's models; none where it doesn't answer."""
        try:
            status, answer = self._ask("GET", "/models")
        except (TimeoutError, ConnectionError):
            return []
        return [m["id"] for m in answer.get("data", [])] if status == 200 else []

    def rate_limit(self) -> dict[str, float | None]:
        return {"remaining": self.remaining, "reset": self.reset}


def recognized(mentions: DataFrame, language: Column | None = None) -> DataFrame:
    """(chunk_id, pos, name, type, confidence, properties): each surface form once, at its first place, if valid and typed."""
    first = mentions.groupBy("chunk_id", "mention").agg(F.min(F.struct("pos", "label")).alias("first"))
    once = first.select("chunk_id", "mention", "first.pos", "first.label").where(valid_mention(F.col("mention")))
    typed = once.withColumn("type", entity_type(F.col("mention"), F.col("label"))).where(F.col("type").isNotNull())
    properties = F.create_map(F.lit("label"), F.col("label"), F.lit("language"), language if language is not None else F.lit("fr"))
    return typed.select("chunk_id", "pos", strip(F.col("mention")).alias("name"), "type", F.lit(MENTION_CONFIDENCE).alias("confidence"), properties.alias("properties"))


def unfenced(response: Column) -> Column:
    """The JSON in a markdown block."""
    return F.trim(F.regexp_replace(strip(response), r"^```(?:json)?\s*|\s*```$", ""))


def parsed(responses: DataFrame) -> DataFrame:
    """responses (chunk_id, response) with p: entities and relations, null where the JSON can't be read."""
    p = F.from_json(unfenced(F.col("response")), JSON_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    readable = F.col("p.entities").isNotNull() | F.col("p.relations").isNotNull()
    return responses.withColumn("p", p).withColumn("p", F.when(readable, F.col("p")))


def given_entities(responses: DataFrame) -> DataFrame:
    """(chunk_id, pos, name, type, confidence, aliases) of parsed responses: valid names of known types."""
    e = responses.select("chunk_id", F.posexplode("p.entities").alias("pos", "e")).select("chunk_id", "pos", strip(F.col("e.name")).alias("name"), "e.type", F.coalesce("e.confidence", F.lit(GIVEN_CONFIDENCE)).alias("confidence"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"))
    return e.where(valid_extracted_name(F.col("name")) & F.col("type").isin(*ENTITY_TYPES) & F.col("confidence").between(0, 1))


def given_relations(responses: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(chunk_id, pos, source, relation, target, confidence, evidence) of parsed responses, in canonical types."""
    r = responses.select("chunk_id", F.posexplode("p.relations").alias("pos", "r"))
    r = r.select("chunk_id", "pos", "r.source", canonical_relation(F.col("r.relation")).alias("relation"), "r.target", F.coalesce("r.confidence", F.lit(GIVEN_CONFIDENCE)).alias("confidence"), F.coalesce("r.evidence", F.lit("")).alias("evidence"))
    return r.where(F.col("relation").isNotNull() & F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("confidence").between(0, 1) & (F.col("confidence") >= min_confidence))


#: Place of an entity among those of its chunk: recognized ones come first, each kind in its order.
GIVEN_AFTER = 1 << 32


def merged(recognized_: DataFrame, given: DataFrame, min_confidence: float | None = MIN_CONFIDENCE) -> DataFrame:
    """(chunk_id, pos, name, type, confidence, aliases): entities of both kinds by lower-case name; the first type stays,
    the highest confidence counts, aliases are joined in order; pos is the order of first places."""
    none = F.array().cast("array<string>")
    both = recognized_.select("chunk_id", F.col("pos").cast("long").alias("pos"), "name", "type", "confidence", none.alias("aliases")).unionByName(
        given.select("chunk_id", (F.col("pos") + F.lit(GIVEN_AFTER)).cast("long").alias("pos"), "name", "type", "confidence", "aliases")
    )
    out = both.groupBy("chunk_id", F.lower("name").alias("key")).agg(
        F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"), F.min_by("type", "pos").alias("type"), F.max("confidence").alias("confidence"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "aliases"))), lambda x: x["aliases"]))).alias("aliases"),
    )
    out = out.select("chunk_id", "pos", "name", "type", "confidence", "aliases")
    return out if min_confidence is None else out.where(F.col("confidence") >= min_confidence)


def extracted(chunks: DataFrame, mentions: MentionProvider, primary: RelationProvider, fallback: RelationProvider | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of chunks (chunk_id, text, and before and after, if there are). Relation providers also get the
    names recognized in a chunk. Chunks of low quality, and those that no provider could read, have recognized entities alone;
    the fallback sees only what the primary provider left.

    What the providers find is read several times, so it is written: texts are searched once."""
    found = written(recognized(mentions(chunks)), "found")
    names = found.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    worth = chunks.where(~low_quality(F.col("text"))).join(names, "chunk_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    answers = parsed(primary(worth))
    if fallback is not None:
        left = worth.join(answers.where(F.col("p").isNotNull()).select("chunk_id"), "chunk_id", "left_anti")
        answers = answers.where(F.col("p").isNotNull()).unionByName(parsed(fallback(left)))
    answers = written(answers.where(F.col("p").isNotNull()).select("chunk_id", "p"), "answers")
    given = given_entities(answers)
    both = merged(found, given, None).join(answers.select("chunk_id").distinct().withColumn("read", F.lit(True)), "chunk_id", "left")
    # what a provider has read must be certain enough
    return both.where(F.col("read").isNull() | (F.col("confidence") >= MIN_CONFIDENCE)).drop("read"), given_relations(answers)
