"""Operators in DataFrame functions alone, against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import licenses, linededup, mixing, sharding
from graphloom.llm.shared import ORDERED, settings

TABLES = ("odd", "none")


def strip_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def test_line_dedup(odd, odd_rows, none):
    keys = defaultdict(set)
    for r in odd_rows:
        for line in (r[1] or "").split("\n"):
            keys[strip_key(line)].add(r[0])
    often = {k: max((d for d in v if d is not None), default=None) for k, v in keys.items() if len(k) >= 40 and len(v) >= 5}
    want = Counter()
    for r in odd_rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if strip_key(x) not in often or often[strip_key(x)] == r[0]]
        want[r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    out = linededup.drop_repeated_lines(odd.select("doc_id", "text"))
    clash = linededup.drop_repeated_lines(odd).columns
    assert len(set(clash)) == len(clash) and {"n_lines", "_n_lines", "n_dropped"} <= set(clash)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["h"]) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect())
    assert got == want and often
    kept = linededup.drop_repeated_lines(odd, counts=False)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert linededup.drop_repeated_lines(none).count() == 0


def test_runs_are_compacted(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for i in range(4, -1, -1):  # batches by descending doc_id
        runs.add(spark.createDataFrame([(i, bytearray(b"a")), (i, bytearray(b"a")), (i, bytearray([i]))], "doc_id long, key binary"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {bytes(r["key"]): (r["n_docs"], r["last_doc"]) for r in runs.statistics().collect()}[b"a"] == (5, 4)
    # the last batch's key was no news: only its count was added
    assert {bytes(r["key"]): (r["n_docs"], r["last_doc"]) for r in runs.levels[0][0].collect()} == {b"a": (1, None), bytes([0]): (1, 0)}
    new = spark.createDataFrame([(9, bytearray(b"a")), (9, bytearray(b"z")), (9, None)], "doc_id long, key binary")
    assert sorted(bytes(r["key"] or b"") for r in runs.unseen(new).collect()) == [b"", b"z"]
    with settings(spark, **{ORDERED.replace(".", "__"): "true", "spark__sql__autoBroadcastJoinThreshold": "-1"}):
        a, b = runs.runs
        plan = a.join(b, "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        merged = linededup._merged([a, b])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in merged and "Exchange" not in merged and "Sort [" not in merged
    runs.drop()
    assert linededup.LineRuns(spark).statistics().count() == 0


@pytest.mark.parametrize("limit", [300, 5000, 1 << 20])
def test_shards_fit(odd, limit):
    rows = sharding.hashed(odd)
    got = sharding.shards(rows, limit).collect()
    assert len(got) == rows.count()
    total = defaultdict(int)
    for r in got:
        total[r["shard_depth"], r["shard_prefix"], r["shard_page"]] += r["n_bytes"]
        assert r["h"] >> (60 - r["shard_depth"]) == r["shard_prefix"]
    most = defaultdict(int)
    for r in got:
        most[r["shard_depth"], r["shard_prefix"], r["shard_page"]] = max(most[r["shard_depth"], r["shard_prefix"], r["shard_page"]], r["n_bytes"])
    assert all(v <= limit or v == most[k] for k, v in total.items())
    h = {(r["h"], r["n_bytes"], i) for i, r in enumerate(got)}
    for r in got:  # no bucket was split without need
        if r["shard_depth"]:
            up = r["shard_prefix"] >> 1
            assert sum(b for x, b, _ in h if x >> (61 - r["shard_depth"]) == up) > limit


def test_shards_of_equal_rows(spark, none):
    rows = spark.createDataFrame([(1, 7, 60)] * 5 + [(2, 1 << 59, 10)], "doc_id long, h long, n_bytes long")
    pages = Counter(r["shard_page"] for r in sharding.shards(rows, 100).where("h = 7").collect())
    assert all(60 * n <= 100 for n in pages.values()) and sum(pages.values()) == 5
    assert sharding.shards(sharding.hashed(none)).count() == 0


def test_periods_keep_less_than_a_block(spark):
    q = {"a": 5, "b": 3, "c": 1, "d": 1}
    slots = mixing.period(spark.createDataFrame(list(q.items()), "source_key string, q long")).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(10))
    n = Counter()
    for t, r in enumerate(slots, 1):
        assert r["j"] == n[r["source_key"]]
        n[r["source_key"]] += 1
        assert all(abs(n[s] - w * t / 10) < 1 for s, w in q.items())
        k = r["j"]
        assert k * 10 // q[r["source_key"]] <= r["slot"] < math.ceil((k + 1) * 10 / q[r["source_key"]])


def test_mixing(odd, none):
    got = mixing.mixed(odd, block_chars=50).collect()
    assert len(got) == odd.count()
    assert len({(r["source_key"], r["block"], r["slot"]) for r in got}) == len({(r["source_key"], r["block"]) for r in got}) == len({r["slot"] for r in got})
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    spans = defaultdict(list)
    for r in got:
        spans[r["source_key"]].append((r["start"], r["n"]))
    for s in spans.values():  # the rows of a source lie one after another
        at = 0
        for start, n in sorted(s):
            assert start == at
            at += n
    out = mixing.in_mixed_order(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert mixing.mixed(none).count() == 0
    finer = mixing.mixed(odd, block_chars=50, bucket_chars=100_000)
    assert {(r["source_key"], r["start"], r["n"], r["slot"]) for r in finer.collect()} == {(r["source_key"], r["start"], r["n"], r["slot"]) for r in got}
    assert mixing.mixed(odd, weights={"s0": 2, "s1": 1}).count() == odd.count()


def test_licences(spark, odd, none):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [("r/LICENSE", apache), ("r/a/x.py", "code here"), ("r/a/b/y.py", "# " + mit + "\ncode"), ("r/a/c/COPYING", mit), ("r/a/c/d/z", "more code"), ("q/w", "code"), (None, mit), ("top", None)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)] + [(2, *files[2])], "doc_id long, path string, text string")
    got = {(r["path"], r["licence"], r["how"]) for r in licenses.scanned(df, F.col("path")).collect()}
    assert {("r/a/x.py", "Apache-2.0", "inherited"), ("r/a/b/y.py", "MIT", "header"), ("r/a/c/d/z", "MIT", "inherited"), ("q/w", None, "none"), (None, "MIT", "header"), ("top", None, "none")} <= got
    assert licenses.scanned(df, F.col("path")).count() == len(files) + 1
    assert licenses.scanned(odd, licenses.document_path()).count() == odd.count()
    assert licenses.scanned(none, licenses.document_path()).count() == 0


def test_licence_files(spark):
    """Whole licence texts, with names, years and wrapped lines as files have them, and a file that is none of them."""
    import textwrap

    rows = [(f"r{i}/LICENSE.txt", "Copyright (c) 2021 Some One\n\n" + textwrap.fill(text, 70)) for i, (_, text) in enumerate(licenses.FILES)]
    rows += [(f"plain{i}/readme", textwrap.fill(text, 60)) for i, (_, text) in enumerate(licenses.FILES)]
    rows += [(f"r{i}/src/a.c", "int main() { return 0; }") for i in range(len(licenses.FILES))] + [("x/LICENSE", "recipes for soup and bread")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["path"]: (r["licence"], r["how"]) for r in licenses.scanned(df, F.col("path")).collect()}
    for i, (name, _) in enumerate(licenses.FILES):
        assert got[f"r{i}/LICENSE.txt"][0] == got[f"plain{i}/readme"][0] == name
        if got[f"r{i}/LICENSE.txt"][1] == "file":
            assert got[f"r{i}/src/a.c"] == (name, "inherited")
    assert sum(how == "file" for _, how in got.values()) >= 8
    assert got["x/LICENSE"] == (None, "none")


def test_usual_notices(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    grant = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:'
    want = {
        "All rights reserved.": "proprietary",
        "Copyright (c) 2020 Foo Inc. All rights reserved.": "proprietary",
        "All rights reserved.\nThis work is licensed under the GNU General Public License, version 3!": "GPL-3.0",
        "// SPDX-License-Identifier: MIT": "MIT",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
        "# SPDX-License-Identifier: Zlib": None,
        grant: "MIT",
        grant.replace("\n", " "): "MIT",
        gpl: "GPL",  # its lines name the licence and the version apart
        gpl.replace("\n", " "): "GPL-3.0",
        gpl.replace("\n", " ").replace("version 3", "version 2"): "GPL-2.0",
        gpl.replace("\n", " ").replace("General", "Affero General"): "AGPL-3.0",
        "the right of all and the use of this": None,
    }
    prose = "Words of a text that has no licence, and more of them.\n"
    df = spark.createDataFrame([(i, f"d{i}/x", prose * 30 + t + "\n" + prose * 30) for i, t in enumerate(want)] + [(100 + i, f"d{100 + i}/x", prose * 60) for i in range(40)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["licence"] for r in licenses.scanned(df, F.col("path")).collect()}
    assert {t: got[i] for i, t in enumerate(want)} == want
    assert {got[100 + i] for i in range(40)} == {None}


def test_templates_are_statements_and_marks_miss_nothing():
    import re

    assert all(len(re.split(licenses.SPLITTER, t)) == 1 for _, t in licenses.TEMPLATES)
    units = [(0, "a", 0.7, 1.0), (0, "b", 0.6, 3.0), (0, "c", 0.3, 2.0), (0, "d", (1 - 0.7**2 - 0.6**2 - 0.3**2) ** 0.5, 0.5)]
    marks = licenses._marks(units, 0.6)  # d and a are the commonest, and too much together
    assert marks == ["a", "b", "c"] and sum(u * u for _, t, u, _ in units if t not in marks) < 0.36
    assert licenses._marks(units, 0.9) == ["b"] and sum(u * u for _, t, u, _ in units if t != "b") < 0.81
    words = ["a", "ab", "abc", "apache", "bsd-3-clause", "2.0", "b", "cc"]
    pattern = re.compile(licenses._holds(words))
    for text in [*words, "x", "abd", "ab c", "an apache.", "apaches", "bsd-3", "2.01", "v2.0", "(2.0)", "abcd", "cca", "a-b"]:
        found = {m for m in words if re.search(rf"(?<![a-z0-9]){re.escape(m)}(?![a-z0-9])", text)}
        assert bool(pattern.search(text)) == bool(found), text


def test_weights_follow_random_quanta(spark):
    rng = random.Random(2)
    q = {f"s{i}": rng.randrange(1, 9) for i in range(6)}
    slots = mixing.period(spark.createDataFrame(list(q.items()), "source_key string, q long")).collect()
    assert Counter(r["source_key"] for r in slots) == q
