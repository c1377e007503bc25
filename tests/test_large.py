"""Steps whose work must not grow faster than their input, and that they give what plainer code gives."""

import random
import time

import pytest

from graphloom.functions.similarity import token_sort_score
from graphloom.operators import resolution


def plain_fold(rows, threshold):
    """resolve_group by looking at all entities for each row."""
    out = []
    norm = lambda s: s.lower().strip()
    for row in rows:
        hit = next((e for e in out if e["name"].lower() == row["name"].lower()), None)
        if hit is None and norm(row["name"]):
            hit = next((e for e in out if any(norm(x) == norm(row["name"]) for x in (e["name"], *e["aliases"]))), None)
        if hit is None and out:
            score, i = max((token_sort_score(row["name"], x), -i) for i, e in enumerate(out) for x in (e["name"], *e["aliases"]))
            hit = out[-i] if score >= threshold else None
        if hit is None:
            out.append({**row, "aliases": list(row["aliases"])})
            continue
        for name in (row["name"], *row["aliases"]):
            if name.lower() not in {x.lower() for x in (hit["name"], *hit["aliases"])}:
                hit["aliases"].append(name)
        hit["confidence"] = max(hit["confidence"], row["confidence"])
    return out


@pytest.mark.parametrize("few, taken", [(0, 4_000_000), (0, 0), (3, 200), (48, 4_000_000)])
def test_fold_of_names_equals_plain_fold(monkeypatch, few, taken):
    monkeypatch.setattr(resolution, "FEW", few)
    monkeypatch.setattr(resolution, "TWICE_TAKEN", taken)
    rng = random.Random(few + taken)
    name = (
        lambda: "".join(rng.choice("abA ") for _ in range(rng.randrange(1, 9))),
        lambda: rng.choice(("company ", "x", "Big company of ")) + str(rng.randrange(10 ** rng.randrange(1, 7))),
        lambda: "".join(rng.choice("bcé ") if rng.random() < 0.1 else c for c in "International trade house Ben Ali " * rng.choice((1, 1, 3))),
    )
    for k in range(9):
        rows = [{"name": name[k % 3](), "type": "T", "aliases": [name[k % 3]() for _ in range(rng.choice((0, 0, 2)))], "confidence": rng.random()} for _ in range(50)]
        for threshold in (60.0, 85.0):
            assert resolution.resolve_group([dict(r) for r in rows], threshold) == plain_fold(rows, threshold)


def test_many_numbered_names_fold_in_time_that_grows_with_them():
    rows = [{"name": f"company {600 * k + 6}", "type": "Company", "aliases": [], "confidence": 0.8} for k in range(4000)]
    begun = time.monotonic()
    out = resolution.resolve_group(rows)
    assert time.monotonic() - begun < 20  # a hundred times as long when each row met all before
    assert sum(1 + len(e["aliases"]) for e in out) == 4000


def test_folds_are_not_joined_into_few_tasks(spark):
    rows = [(c, p, f"name {c} {p}", "Company", [], 0.8, ) for c in range(40) for p in (1, 0)]
    df = spark.createDataFrame(rows, "chunk_id long, pos long, name string, type string, aliases array<string>, confidence double")
    out = resolution.resolved(df)
    tasks = {r["t"] for r in out.selectExpr("spark_partition_id() AS t").collect()}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r["chunk_id"], r["name"], tuple(r["aliases"])) for r in out.collect()} == {(c, f"name {c} 0", (f"name {c} 1",)) for c in range(40)}


def test_name_checks_are_computed_once(spark):
    """Stripping and lower case stood in the expressions once a condition."""
    from pyspark.sql import functions as F

    from graphloom.functions import names
    from graphloom.operators import chunks

    df = spark.createDataFrame([("Acme Group SA",), ("Ben Ali 1999",), ("M. x",), ("",), (None,), ("  CEO ",), ("hol-sa-ding s.a.x",)], "name string")
    out = df.select("name", names.valid_mention(F.col("name")).alias("valid"), names.entity_type(F.col("name"), F.lit("LOC")).alias("type"), names.normalized(F.col("name")).alias("norm"))
    for check in (names.valid_mention(F.col("name")), names.entity_type(F.col("name"), F.lit("LOC")), chunks.low_quality(F.col("name"))):
        assert str(check).count("lower(") <= 2
    assert [tuple(r) for r in out.collect()] == [
        ("Acme Group SA", True, "Group", "acme"), ("Ben Ali 1999", False, "Location", "ben ali 1999"), ("M. x", True, "Person", "m x"), ("", False, "Location", ""),
        (None, False, "Location", None), ("  CEO ", False, "Person", "ceo"), ("hol-sa-ding s.a.x", True, "Company", "holding x"),
    ]
