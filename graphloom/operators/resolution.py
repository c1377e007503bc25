"""Resolving and linking entity names, and finding duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import LINKER_SUFFIXES, MERGER_SUFFIXES, compound_parts, normalized
from ..functions.similarity import sorted_tokens, token_sort_ratio
from ..storage import written

FUZZY, EMBEDDED = 85.0, 0.85
SPLIT_PENALTY = 0.9
#: What str.split() takes for white space.
SPACES = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Short names and what they stand for.
ACRONYMS = {
    "STB": "Société Tunisienne de Banque", "BNA": "Banque Nationale Agricole", "BIAT": "Banque Internationale Arabe de Tunisie", "BH": "Banque de l'Habitat", "ATB": "Arab Tunisian Bank",
    "UIB": "Union Internationale de Banques", "BT": "Banque de Tunisie", "PGH": "Poulina Group Holding", "SFBT": "Société de Fabrication des Boissons de Tunisie", "STIL": "Société Tunisienne des Industries de Lait",
}


#: Names as vectors, one a row: a model that a caller passes in.
Embedding = Callable[[list[str]], np.ndarray]


#: Up to so many forms of names each is compared; beyond, they are sought by what is left when one or two letters are taken out.
FEW = 48
#: Entries at most of the forms with two letters taken out; lengths beyond that are compared form by form, on vectors.
TWICE_TAKEN = 4_000_000
_ALL = np.uint64(2**64 - 1)


def _letters(s: str) -> int:
    """A bit for each letter, modulo 64: forms whose bits differ in n places are n insertions and deletions apart at least."""
    out = 0
    for c in set(s):
        out |= 1 << (ord(c) & 63)
    return out


def _without(s: str) -> set[str]:
    return {s[:k] + s[k + 1 :] for k in range(len(s))}


def _without_two(s: str) -> set[str]:
    return {s[:k] + s[k + 1 : j] + s[j + 1 :] for k in range(len(s)) for j in range(k + 1, len(s))}


class _Forms:
    """The forms (words in order) of the names so far, each with the first entity that has it, and the best score among them.

    With d insertions and deletions between forms as long as a and b, the score is 100 (1 - d / (a + b)). Those up to d = 2 are
    found by their common subsequence, whatever their number: an entry keeps the first entity alone, as all that meet there
    score the same. Only where these don't settle it, forms whose lengths and letters fit are compared, all at once."""

    def __init__(self, threshold: float):
        self.threshold, self.first, self.lengths = threshold, {}, {}
        self.one: dict[int, dict[str, int]] | None = None
        self.two: dict[int, dict[str, int]] = {}
        self.taken = 0

    def add(self, form: str, i: int) -> None:
        old = self.first.get(form)
        if old is not None and old <= i:
            return
        self.first[form] = i
        if self.one is not None:
            self._index(form, i, old is None)
        elif len(self.first) > FEW:
            self.one = {}
            for f, k in self.first.items():
                self._index(f, k, True)

    def _index(self, form: str, i: int, new: bool) -> None:
        n = len(form)
        if new:
            self.lengths.setdefault(n, _Column(n)).add(form)
        at = self.one.setdefault(n, {})
        for key in _without(form):
            if at.get(key, i) >= i:
                at[key] = i
        if n in self.two:
            self._two(form, i)

    def _two(self, form: str, i: int) -> None:
        n = len(form)
        if self.taken > TWICE_TAKEN:
            del self.two[n]
            return
        at = self.two[n]
        before = len(at)
        for key in _without_two(form):
            if at.get(key, i) >= i:
                at[key] = i
        self.taken += len(at) - before

    def _has_two(self, n: int) -> bool:
        if n not in self.two and self.taken + len(self.lengths[n].forms) * n * (n - 1) // 2 <= TWICE_TAKEN:
            self.two[n] = {}
            for form in self.lengths[n].forms:
                if n in self.two:
                    self._two(form, self.first[form])
        return n in self.two

    def best(self, s: str) -> int | None:
        """The first entity of those with the best score, if that reaches the threshold."""
        if s in self.first:
            return self.first[s] if self.threshold <= 100.0 else None
        found = self._scan(s) if self.one is None else self._sought(s)
        return found[1] if found is not None and found[0] >= self.threshold else None

    def _scan(self, s: str) -> tuple[float, int] | None:
        a, mine, where = len(s), _letters(s), _places(s)
        best, at = self.threshold, None
        for form, i in self.first.items():
            b = len(form)
            if 200.0 * min(a, b) < best * (a + b) - 1e-6 or (mine ^ _letters(form)).bit_count() > (1.0 - best / 100.0) * (a + b) + 1e-6:
                continue
            score = 200.0 * _common(where, a, form) / (a + b) if a or b else 100.0
            if score > best or (score == best and (at is None or i < at)):
                best, at = score, i
        return None if at is None else (best, at)

    def _sought(self, s: str) -> tuple[float, int] | None:
        a, best, at = len(s), -1.0, -1

        def met(common: int, b: int, i: int | None) -> None:
            nonlocal best, at
            if i is not None:
                score = 200.0 * common / (a + b)
                if score > best or (score == best and i < at):
                    best, at = score, i

        have, missed = self.lengths, None
        if a + 1 in have:
            met(a, a + 1, self.one[a + 1].get(s))
        if a - 1 in have or a in have:
            less, same = a - 1 in have, self.one.get(a, {})
            for key in _without(s):
                if less:
                    met(a - 1, a - 1, self.first.get(key))
                met(a - 1, a, same.get(key))
        if a - 2 in have and 200.0 * (a - 2) / (2 * a - 2) >= max(best, self.threshold):
            for key in _without_two(s):
                met(a - 2, a - 2, self.first.get(key))
        if a + 2 in have and 200.0 * a / (2 * a + 2) >= max(best, self.threshold):
            if self._has_two(a + 2):
                met(a, a + 2, self.two[a + 2].get(s))
            else:
                missed = a + 2
        # others are three or more apart
        rest = 200.0 * a / (2 * a + 3)
        lengths = [b for b in have if b == missed or (rest >= max(best, self.threshold) and 200.0 * min(a, b) >= max(best, self.threshold) * (a + b) - 1e-6)]
        if lengths:
            mine, where = _letters(s), _places(s)
            for b in sorted(lengths, key=lambda b: abs(a - b)):
                least = max(best, self.threshold)
                if 200.0 * min(a, b) < least * (a + b) - 1e-6:
                    continue
                common, forms = have[b].compared(a, mine, where, (1.0 - least / 100.0) * (a + b) + 1e-6)
                if len(common):
                    top = int(common.max())
                    met(top, b, min(self.first[forms[k]] for k in np.flatnonzero(common == top)))
        return None if at < 0 else (best, at)


class _Column:
    """Forms of one length as rows of numbers."""

    def __init__(self, length: int):
        self.length, self.forms = length, []
        self.codes, self.letters = np.zeros((16, length), np.uint32), np.zeros(16, np.uint64)

    def add(self, form: str) -> None:
        k = len(self.forms)
        if k == len(self.letters):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.codes[k] = np.fromiter(map(ord, form), np.uint32, self.length)
        self.letters[k] = _letters(form)
        self.forms.append(form)

    def compared(self, a: int, letters: int, where: dict[str, int], apart: float) -> tuple[np.ndarray, list[str]]:
        """Lengths of the common subsequences with the forms whose letters fit, and these forms."""
        near = np.flatnonzero(np.bitwise_count(self.letters[: len(self.forms)] ^ np.uint64(letters)) <= apart)
        forms = [self.forms[k] for k in near]
        if a > 64 or len(near) < 8:
            return np.array([_common(where, a, f) for f in forms], np.int64), forms
        known = np.array(sorted(map(ord, where)), np.uint32)
        bits = np.array([where[chr(c)] for c in known] + [0], np.uint64)
        v = np.full(len(near), _ALL)
        for j in range(self.length):
            c = self.codes[near, j]
            k = np.searchsorted(known, c)
            k[(k == len(known)) | (known[np.minimum(k, len(known) - 1)] != c)] = len(known)
            u = v & bits[k]
            v = (v + u) | (v - u)
        own = np.uint64(2**a - 1)
        return a - np.bitwise_count(v & own).astype(np.int64), forms


def _places(s: str) -> dict[str, int]:
    where: dict[str, int] = {}
    for i, c in enumerate(s):
        where[c] = where.get(c, 0) | 1 << i
    return where


def _common(where: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of b and what is n long and has its letters at these places."""
    full = (1 << n) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return n - v.bit_count()


def resolve_group(
    rows: list[dict], threshold: float = FUZZY, known: dict[str, str] | None = None, normal: dict[str, str] | None = None, embed: Embedding | None = None, similarity: float = EMBEDDED
) -> list[dict]:
    """Entities of one group in order, each joined to the first earlier one that is the same: by name, known alias, normal form
    (not empty), the best score, or, with embed, the most similar vector. A row has name, type, aliases, confidence."""
    known, normal, out = known or {}, normal or {}, []
    by_name: dict[str, int] = {}
    by_norm: dict[str, int] = {}
    have: dict[int, set[str]] = {}
    forms = _Forms(threshold)
    vectors: dict[str, np.ndarray] = {}

    def vector(name: str) -> np.ndarray:
        if name not in vectors:
            v = np.asarray(embed([name])[0], np.float64)
            vectors[name] = v / max(float(np.linalg.norm(v)), 1e-300)
        return vectors[name]

    def norm(name: str) -> str:
        return normal[name] if name in normal else name.lower().strip()

    def named(i: int, name: str) -> None:
        n = norm(name)
        if by_norm.get(n, i) >= i:
            by_norm[n] = i
        forms.add(sorted_tokens(name), i)

    for row in rows:
        low = row["name"].lower()
        hit = by_name.get(low)
        if hit is None and low in known:
            hit = by_name.get(known[low].lower())
        if hit is None and (n := norm(row["name"])):
            hit = by_norm.get(n)
        if hit is None and out:
            hit = forms.best(sorted_tokens(row["name"]))
        if hit is None and embed is not None and out:
            near = [float(vector(row["name"]) @ vector(e["name"])) for e in out]
            hit = int(np.argmax(near)) if max(near) >= similarity else None
        if hit is None:
            i = len(out)
            out.append({**row, "aliases": list(row["aliases"] if row["aliases"] is not None else [])})
            by_name[low] = i
            for name in (row["name"], *out[i]["aliases"]):
                named(i, name)
            continue
        e = out[hit]
        if hit not in have:
            have[hit] = {e["name"].lower(), *(a.lower() for a in e["aliases"])}
        for name in (row["name"], *(row["aliases"] if row["aliases"] is not None else [])):
            if name.lower() not in have[hit]:
                e["aliases"].append(name)
                have[hit].add(name.lower())
                named(hit, name)
        e["confidence"] = max(e["confidence"], row["confidence"])
    return out


#: Rows that a fold gives back at once.
FOLDED_ROWS = 10_000


def resolved(entities: DataFrame, threshold: float = FUZZY, known: dict[str, str] | None = None, embed: Embedding | None = None, similarity: float = EMBEDDED) -> DataFrame:
    """entities (chunk_id, pos, name, type, aliases, confidence), chunk by chunk; order matters, so a chunk is one fold.

    known maps lower-case names to the canonical ones of an alias table; embed is the embedding tier's model. Chunks come sorted
    and are folded one after the other; their partitions aren't joined by size, as folds take long over few bytes."""
    columns = ("name", "type", "aliases", "confidence")
    kind = dict(entities.dtypes)["chunk_id"]
    rows = entities.select("chunk_id", "pos", *columns, normalized(F.col("name")).alias("norm"))
    rows = rows.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id").sortWithinPartitions("chunk_id", "pos")
    schema = f"chunk_id {kind}, name string, type string, aliases array<string>, confidence double"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, group, normal, out, shape = None, [], {}, [], None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[c] for e in out], t) for c, t in shape], [c for c, _ in shape])

        def end() -> None:
            for e in resolve_group(group, threshold, known, normal, embed, similarity) if len(group) > 1 else group:
                out.append({"chunk_id": chunk, **e, "aliases": e["aliases"] if e["aliases"] is not None else []})

        for b in batches:
            shape = [(c, b.schema.field(c).type) for c in ("chunk_id", *columns)]
            ids, norms, *values = (b.column(c).to_pylist() for c in ("chunk_id", "norm", *columns))
            for i, norm, *v in zip(ids, norms, *values, strict=True):
                if group and i != chunk:
                    end()
                    group, normal = [], {}
                    if len(out) >= FOLDED_ROWS:
                        yield batch()
                        out = []
                chunk = i
                group.append(dict(zip(columns, v, strict=True)))
                normal[v[0]] = norm
        if group:
            end()
        if out:
            yield batch()

    return rows.mapInArrow(fold, schema)


def scored_pairs(left: DataFrame, right: DataFrame, block: list[str], threshold: float = FUZZY) -> DataFrame:
    """Pairs within a block with token_sort_ratio >= threshold, each pair of names scored once.

    Names with words in order, a and b long, differ by d = a + b - 2 LCS insertions and deletions, and (1 - t)(a + b) >= d.
    A deletion breaks two pairs of neighbouring letters, an insertion one, so the names share (1.5 t - 1)(a + b) - 1 pairs at
    least. Each name therefore offers its rarest pairs, as many as must hold a shared one; only names that meet there, and
    whose lengths fit, are scored. Names too short for that bound meet all those of lengths that fit."""
    t = threshold / 100.0

    def names_of(df: DataFrame) -> DataFrame:
        low = F.regexp_replace(F.regexp_replace(F.lower("name"), f"^{SPACES}|{SPACES}$", ""), SPACES, " ")
        rows = df.select(*block, "name").distinct().withColumn("form", F.array_join(F.array_sort(F.split(low, " ")), " ")).withColumn("len", F.length("form"))
        two = F.transform(F.when(F.col("len") > 1, F.sequence(F.lit(1), F.col("len") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.col("form").substr(i, F.lit(2)))
        rows = rows.withColumn("two", two)
        # the second of two equal pairs is another one
        numbered = F.transform("two", lambda g, i: F.concat(g, F.size(F.filter(F.slice("two", 1, i), lambda x: x == g)).cast("string")))
        least = F.ceil(2 * F.col("len") / (2 - t) * (1.5 * t - 1) - 1 - 1e-9).cast("int")
        return rows.select(*block, "name", "len", numbered.alias("grams"), least.alias("least"))

    def by_length(a: DataFrame, b: DataFrame) -> DataFrame:
        n = F.col("len")
        spread = a.select(*block, "name", F.explode(F.sequence(F.ceil(n * t / (2 - t) - 1e-9).cast("int"), F.floor(n * (2 - t) / t + 1e-9).cast("int"))).alias("len"))
        return spread.join(b.select(*block, F.col("name").alias("other_name"), "len"), [*block, "len"]).select(*block, "name", "other_name")

    # both are read several times: as written tables, whatever it took to make them
    a, b = written(names_of(left), "names"), written(names_of(right), "names")
    often = a.unionByName(b).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))

    def offered(of: DataFrame) -> DataFrame:
        rows = of.where("least >= 1").select(*block, "name", "len", (F.size("grams") - F.col("least") + 1).alias("first"), F.explode("grams").alias("gram")).join(often, "gram")
        rank = F.row_number().over(Window.partitionBy(*block, "name").orderBy("often", "gram"))
        return rows.withColumn("rank", rank).where("rank <= first").select(*block, "gram", "name", "len")

    x, y = offered(a), offered(b).withColumnsRenamed({"name": "other_name", "len": "other_len"})
    fits = 2 * F.least("len", "other_len") >= (t - 1e-9) * (F.col("len") + F.col("other_len"))
    met = x.join(y, [*block, "gram"]).where(fits).select(*block, "name", "other_name").distinct()
    met = met.unionByName(by_length(a.where("least < 1"), b)).unionByName(by_length(a.where("least >= 1"), b.where("least < 1")))
    scored = met.withColumn("score", token_sort_ratio(F.lower("name"), F.lower("other_name"))).where(F.col("score") >= threshold)
    others = right.withColumnsRenamed({c: f"other_{c}" for c in right.columns if c not in block})
    return left.join(scored, [*block, "name"]).join(others, [*block, "other_name"])


#: Vectors of a block that are multiplied at once.
TOGETHER = 2048


def best_by_vector(queries: DataFrame, candidates: DataFrame, threshold: float = EMBEDDED, together: int = TOGETHER) -> DataFrame:
    """(id, best_id, similarity): the most similar candidate of each query, the smallest id of equal ones; both (id, block, vector).

    A block's queries and candidates are dealt into parts, and parts are multiplied as matrices: what leaves a product is one
    row a query. A null or zero vector is like nothing."""
    sizes = written(candidates.groupBy("block").agg(F.ceil(F.count("*") / together).cast("int").alias("parts")), "sizes")
    rows = queries.select("id", "block", "vector").join(sizes.withColumnRenamed("parts", "shares"), "block")
    asked = queries.groupBy("block").agg(F.ceil(F.count("*") / together).cast("int").alias("asked"))
    q = rows.join(asked, "block").select("id", "block", "vector", F.pmod(F.xxhash64("id"), "asked").alias("of"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"))
    c = candidates.select("id", "block", "vector").join(sizes, "block").join(asked, "block").select(*[F.col(x).alias(x) for x in ("id", "block", "vector")], F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("of"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    kind = dict(queries.dtypes)["id"]

    def unit(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        whole = pdf[pdf["vector"].notna()]
        v = np.stack([np.asarray(x, np.float64) for x in whole["vector"]]) if len(whole) else np.zeros((0, 1))
        length = np.sqrt((v * v).sum(1))
        return whole["id"].to_numpy()[length > 0], v[length > 0] / length[length > 0, None]

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        (ids, v), (others, w) = unit(x), unit(y)
        order = np.argsort(others, kind="stable")  # of equal ones argmax takes the first
        others, w = others[order], w[order]
        if not len(ids) or not len(others):
            return pd.DataFrame({"id": [], "best_id": [], "similarity": []})
        near = np.round(v @ w.T, 9)
        near[ids[:, None] == others[None, :]] = -np.inf
        at = near.argmax(1)
        out = pd.DataFrame({"id": ids, "best_id": others[at], "similarity": near[np.arange(len(ids)), at]})
        return out[out["similarity"] > -np.inf]

    key = ["block", "of", "part"]
    found = q.withColumn("of", F.col("of").cast("int")).groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(best, f"id {kind}, best_id {kind}, similarity double")
    top = found.groupBy("id").agg(F.max_by(F.struct("best_id", "similarity"), F.struct("similarity", -F.col("best_id"))).alias("b"))
    return top.select("id", "b.*").where(F.col("similarity") >= threshold)


def lookup_table(entities: DataFrame) -> DataFrame:
    """(key, name): lower-case names and aliases of graph entities (name, aliases, ord); later ones take a key over, aliases names."""
    by_name = entities.select(F.lower("name").alias("key"), "name", "ord", F.lit(0).alias("kind"))
    by_alias = entities.select(F.explode("aliases").alias("key"), "name", "ord").select(F.lower("key").alias("key"), "name", "ord", F.lit(1).alias("kind"))
    return by_name.unionByName(by_alias).groupBy("key").agg(F.max_by("name", F.struct("ord", "kind")).alias("name"), F.max("ord").alias("ord"))


def split_compounds(entities: DataFrame) -> DataFrame:
    """entities (name, confidence, ...) with compound names as one row a part, each a little less certain."""
    rows = entities.withColumn("name", compound_parts(F.col("name"), tuple(ACRONYMS)))
    split = F.col("confidence") * F.when(F.size("name") > 1, SPLIT_PENALTY).otherwise(1.0)
    return rows.withColumn("confidence", split).withColumn("name", F.explode("name")).select(*entities.columns)


def linked(entities: DataFrame, graph: DataFrame, threshold: float = FUZZY, parity: bool = False) -> DataFrame:
    """entities (id, name) with canonical and tier: 1 name or alias, 2 acronym, 3 normal form, 4 score; null: none.

    Each tier sees only what the ones before left, so the costly one meets the fewest names, and each of them once."""
    keys = lookup_table(graph).withColumnRenamed("name", "canonical")
    names = entities.select("name").distinct()
    acronyms = F.create_map(*[F.lit(x) for kv in ACRONYMS.items() for x in kv])
    full = F.when((F.upper("name") == F.col("name")) & (F.length("name") <= 5), F.try_element_at(acronyms, F.col("name")))
    normal = keys.withColumn("norm", normalized(F.col("key"), LINKER_SUFFIXES)).groupBy("norm").agg(F.min_by("canonical", F.struct("ord", "key")).alias("by_form"))
    normal = normal if parity else normal.where("norm <> ''")
    by = names.withColumns({"low": F.lower("name"), "full": F.lower(full), "form": normalized(F.col("name"), LINKER_SUFFIXES)})
    by = by.join(keys.select(F.col("key").alias("low"), F.col("canonical").alias("by_name")), "low", "left")
    by = by.join(keys.select(F.col("key").alias("full"), F.col("canonical").alias("by_acronym")), "full", "left")
    by = by.join(normal.withColumnRenamed("norm", "form"), "form", "left")
    tier = F.when(F.col("by_name").isNotNull(), 1).when(F.col("by_acronym").isNotNull(), 2).when(F.col("by_form").isNotNull(), 3)
    found = written(by.select("name", F.coalesce("by_name", "by_acronym", "by_form").alias("canonical"), tier.alias("tier")), "tiers")
    rest = found.where("tier IS NULL").select("name").withColumn("block", F.lit(0))
    pairs = scored_pairs(rest, keys.select(F.col("key").alias("name"), "canonical", "ord").withColumn("block", F.lit(0)), ["block"], threshold)
    best = pairs.groupBy("name").agg(F.min_by("other_canonical", F.struct(-F.col("score"), "other_ord", "other_name")).alias("alike"))
    hits = found.join(best, "name", "left").select("name", F.coalesce("canonical", "alike").alias("canonical"), F.coalesce("tier", F.when(F.col("alike").isNotNull(), 4)).alias("tier"))
    return entities.select("id", "name").join(hits, "name", "left").select("id", "name", "canonical", "tier")


def duplicate_pairs(entities: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(name, other, score) of entities (name, rank) whose normal forms are equal, alike, or one the acronym of a word of the other."""
    e = entities.withColumn("norm", normalized(F.col("name"), MERGER_SUFFIXES, dotted=False)).where("norm <> ''")
    side = e.select(F.col("norm").alias("name"), F.col("name").alias("full"), "rank").withColumn("block", F.lit(0))
    alike = scored_pairs(side, side, ["block"], threshold).where("rank < other_rank").select(F.col("full").alias("name"), F.col("other_full").alias("other"), "score")
    short = e.where((F.upper("name") == F.col("name")) & (F.length("name") <= 5)).select(F.lower("name").alias("word"), F.col("name").alias("short"), F.col("rank").alias("short_rank"))
    words = e.select("name", "rank", F.explode(F.array_distinct(F.split("norm", " "))).alias("word"))
    hit = words.join(short, "word").where("name <> short")
    first = F.col("rank") < F.col("short_rank")
    named = hit.select(F.when(first, F.col("name")).otherwise(F.col("short")).alias("name"), F.when(first, F.col("short")).otherwise(F.col("name")).alias("other"), F.lit(100.0).alias("score"))
    return alike.unionByName(named).groupBy("name", "other").agg(F.max("score").alias("score"))


def stars(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(canonical, duplicate): in the order of ranks a head takes the later ones like it that are still free.

    In rounds: a name heads its star as soon as none of its earlier likes may still head one, and takes those that no earlier
    undecided name could take."""
    r = ranks.select("name", "rank")
    edge = pairs.select("name", "other").join(r.withColumnsRenamed({"rank": "head_rank"}), "name").join(r.select(F.col("name").alias("other")), "other")
    edge = written(edge.select("name", "other", "head_rank"), "likes")
    taken = None
    while edge.limit(1).count():
        waiting = edge.select(F.col("other").alias("name")).distinct()  # these may yet be taken
        heads = edge.join(waiting, "name", "left_anti").groupBy("other").agg(F.min_by("name", "head_rank").alias("canonical"), F.min("head_rank").alias("by"))
        open_ = edge.join(waiting, "name", "left_semi").groupBy("other").agg(F.min("head_rank").alias("open_rank"))
        # one that an earlier undecided name could take waits, too
        sure = written(heads.join(open_, "other", "left").where("open_rank IS NULL OR by < open_rank").select("canonical", F.col("other").alias("duplicate")), "stars")
        taken = sure if taken is None else taken.unionByName(sure)
        gone = sure.select(F.col("duplicate").alias("n"))
        edge = written(edge.join(gone.withColumnRenamed("n", "name"), "name", "left_anti").join(gone.withColumnRenamed("n", "other"), "other", "left_anti"), "likes")
    return taken if taken is not None else pairs.select(F.col("name").alias("canonical"), F.col("other").alias("duplicate")).where("false")


def decision_pairs(decisions: DataFrame) -> DataFrame:
    """(a, b, decision): unordered lower-case pairs, each with its last decision by ord."""
    a, b = F.lower("entity1"), F.lower("entity2")
    return decisions.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "decision", "ord").groupBy("a", "b").agg(F.max_by("decision", "ord").alias("decision"))


def undecided(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The pairs (entity1, entity2) that no decision names."""
    p = pairs.withColumns({"a": F.least(F.lower("entity1"), F.lower("entity2")), "b": F.greatest(F.lower("entity1"), F.lower("entity2"))})
    return p.join(decision_pairs(decisions), ["a", "b"], "left_anti").select(*pairs.columns)
